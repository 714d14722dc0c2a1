import pytest
from pyspark.sql import functions as F

from setwise import errors as E
from setwise.functions import values as V
from setwise.operators import projection as P
from setwise.operators import tables as T


@pytest.fixture(scope="module")
def ab(spark):
    a = spark.sql("select * from values (1, 'a'), (2, 'b'), (2, 'c'), (4, null) as t(k, x)")
    b = spark.sql("select * from values (2, 10), (4, 20), (5, 30) as t(k, y)")
    return a, b


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_joins(ab):
    a, b = ab
    assert rows(T.join(a, b, ["k"])) == [(2, "b", 10), (2, "c", 10), (4, None, 20)]
    got = T.cogroup(a, b, ["k"], lambda: F.lit("left"), lambda: F.lit("right"), lambda: F.lit("both"))
    assert rows(got) == [(1, "left"), (2, "both"), (2, "both"), (4, "both"), (5, "right")]
    x, y = T.align(a, b, ["k"])
    assert x.count() == 3 and rows(y) == [(2, 10), (4, 20)]
    assert T.cross(a, b).count() == 12
    with pytest.raises(E.EnormousCross):
        T.cross(a, b, most=11)


def test_order_and_shape(spark, ab):
    a, b = ab
    assert rows(T.compact(a, ["x"])) == [(1, "a"), (2, "b"), (2, "c")]
    assert [r.k for r in T.sort(a, [F.col("k").desc()], ids=["x"]).collect()] == [4, 2, 2, 1]
    assert [tuple(r) for r in T.sort(a, [F.col("k")], unique=True, ids=["x"]).collect()] == [(1, "a"), (2, "b"), (4, None)]
    assert [len(d.collect()) for d in T.group_by_n(a, [[F.col("k")], [F.col("x")]])] == [4, 4]
    assert rows(T.take_range(b, [F.col("k")], 1, 5)) == [(4, 20), (5, 30)]
    assert rows(T.partition_merge(a, ["k"], F.count("x").alias("n"))) == [(1, 1), (2, 2), (4, 0)]
    assert T.concat(a, b).columns == ["k", "x", "y"] and T.concat(a, b).count() == 7
    assert rows(T.zip_rows(a.select("x"), b.select("y"), [F.col("x")], [F.col("y")])) == [("a", 20), ("b", 30), (None, 10)]
    assert rows(T.scan(b, [F.col("k")], "s", "sum", F.col("y"))) == [(2, 10, 10), (4, 20, 30), (5, 30, 60)]
    assert rows(T.transform(b, z=F.col("y") + 1)) == [(11,), (21,), (31,)]
    assert T.force(a).count() == 4 and T.distinct(a, ["k"]).count() == 3
    assert rows(T.map_batches(b, lambda p: p.assign(y=p.y * 2), "k int, y int")) == [(2, 20), (4, 40), (5, 60)]


def test_sample_and_schemas(spark):
    df = spark.range(1000)
    s = T.sample(df, 50, seed=3)
    assert s.count() == 50 and rows(s) == rows(T.sample(df.repartition(7), 50, seed=3)) and rows(s) != rows(T.sample(df, 50, seed=4))
    js = spark.sql("select parse_json(x) as value from values ('{\"a\": 1}'), ('{\"a\": 2}'), ('{\"a\": \"s\"}'), ('5'), (null) as t(x)")
    assert T.schemas(js).count() == 3


def test_projections(spark):
    df = spark.sql("select 1 as a, cast(null as int) as b, 's' as c, parse_json('[1, \"x\"]') as v")
    a, b, c, v = V.num(F.col("a"), True), V.num(F.col("b"), True), V.text(F.col("c")), V.Val("variant", F.col("v"))
    one = lambda x: df.select(V.column(x).alias("r")).collect()[0].r
    assert one(P.filter_value(a, V.boolean(F.lit(True)))) == 1 and one(P.filter_value(a, V.boolean(F.lit(False)))) is None
    assert one(P.inner_object_concat(V.obj({"x": a}), V.obj({"y": b}))) is None
    assert one(P.outer_object_concat(V.obj({"x": a, "z": a}), V.obj({"x": b, "y": b}))).asDict() == {"x": 1, "z": 1, "y": None}
    assert one(P.inner_array_concat(P.wrap_array(a), P.wrap_array(a))) == [1, 1]
    assert one(P.outer_array_concat(P.wrap_array(a), P.wrap_array(b))) == [1.0]
    assert one(P.object_delete(V.obj({"x": a, "y": a}), "y")).asDict() == {"x": 1}
    assert one(P.array_swap(V.Val("arr", items=[a, V.constant(5)], inner=True), 1)) == [5, 1]
    assert one(P.wrap_object_dynamic(a, c)).toPython() == {"s": 1}
    assert one(P.typed(a, "str")) is None and one(P.typed(V.index(v, V.constant(1)), "str")).toPython() == "x"
    assert df.select(P.is_type(a, "num"), P.is_type(v, "array"), P.is_type(b, "num")).collect()[0][:] == (True, True, False)
    assert one(P.const_literal(7, a)) == 7 and one(P.const_literal(7, b)) is None
    assert df.select(P.equal_literal(a, 1.0), P.equal_literal(c, "s", invert=True)).collect()[0][:] == (True, False)
    assert one(P.filter_defined(a, V.obj({"x": a, "y": b}))) == 1 and one(P.filter_defined(a, V.obj({"x": a, "y": b}), "all")) is None
    assert one(P.deep_map(V.obj({"x": a, "y": P.wrap_array(a)}), lambda m: V.num(m.col + 1, True))).asDict() == {"x": 2, "y": [2]}
