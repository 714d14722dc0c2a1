import json

import pytest
from pyspark.sql import functions as F

from setwise.errors import SetwiseError
from setwise.lang.compiler import query
from setwise.sources import enrichment, readers, sinks
from setwise.sources.catalog import Catalog
from setwise.streaming import ingest as streams


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_json_styles(spark, tmp_path):
    f = put(tmp_path, "a.json", '{"a": 1}\n{"a": "x", "b": null}\nnot json\n[1, 2]\n')
    good, bad = readers.read_json(spark, f)
    assert good.count() == 3 and [r.raw for r in bad.collect()] == ["not json"]
    g = put(tmp_path, "b.json", '[{"a": 1},\n {"a": 2}]')
    assert readers.read_json(spark, g, style="value")[0].count() == 2
    assert readers.read_json(spark, f, style="value")[0].count() == 4
    assert readers.read_json(spark, f, mode="all_or_nothing")[0].count() == 0
    assert readers.read_json(spark, f, mode="stop_on_first_error")[0].count() == 2
    assert readers.read_json(spark, f, schema="a string")[0].columns == ["a"]


def test_csv_inference_and_duplicate_headers(spark, tmp_path):
    f = put(tmp_path, "a.csv", 'n,s,x,x,e\n1,a,1,2,\n2.5,"b,c",3,,\nbad\n,d,5,6,\n')
    good, bad = readers.read_csv(spark, f)
    assert dict(good.dtypes) == {"n": "double", "s": "string", "x": "array<double>", "e": "string"}
    assert [tuple(r) for r in good.collect()] == [(1.0, "a", [1.0, 2.0], None), (2.5, "b,c", [3.0, None], None), (None, "d", [5.0, 6.0], None)]
    assert bad.count() == 1
    assert readers.csv_type(good.select("s"), "s") == "string"
    with pytest.raises(SetwiseError):
        readers.read_csv(spark, f, delimiter="||")


def test_sniff(spark, tmp_path):
    assert readers.sniff(spark, put(tmp_path, "x", ' {"a":1}')) == "json"
    assert readers.sniff(spark, put(tmp_path, "y", "a,b\n1,2")) == "csv"
    assert readers.sniff(spark, "", "text/csv; charset=utf-8") == "csv"
    with pytest.raises(SetwiseError):
        readers.sniff(spark, "", "image/png")


def test_catalog_modes_globs_and_queries(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.write("/a/x", spark.range(3).withColumnRenamed("id", "v"), "create")
    c.write("/a/y", spark.range(2).withColumnRenamed("id", "v"), "create")
    with pytest.raises(SetwiseError):
        c.write("/a/x", spark.range(1), "create")
    c.write("/a/x", spark.range(1).withColumnRenamed("id", "v"), stream="s1")
    c.write("/a/x", spark.range(1).withColumnRenamed("id", "v"), stream="s1")  # delivered again
    assert c.read("/a/x").count() == 4
    assert c.expand("/a/*") == ["/a/x", "/a/y"] and c.read("/*/*").count() == 6
    assert query(spark, "count(//a/*)", {}, resolve=c.resolve).collect()[0].value == 6
    assert query(spark, "sum((./x).v)", {}, base="/a", resolve=c.resolve).collect()[0].value == 3
    c.write("/a/x", spark.range(5).withColumnRenamed("id", "v"), "replace")
    assert c.read("/a/x").count() == 5
    c.archive("/a/x")
    with pytest.raises(SetwiseError):
        c.read("/a/x")


def test_result_cache(spark, tmp_path):
    cache, calls = sinks.ResultCache(Catalog(spark, f"file://{tmp_path}/c2")), []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    assert cache.get("q", make, max_age=60, now=1000.0).count() == 1
    assert cache.get("q", make, max_age=60, now=1030.0).count() == 1
    assert cache.get("q", make, max_age=60, now=1100.0).count() == 2
    assert cache.get("q", make, now=1101.0).count() == 3
    assert cache.get("q", make, max_age=60, now=1150.0, recache_after=30).count() == 3
    cache.renewal.join()
    assert cache.get("q", make, max_age=60, now=1155.0, recache_after=30).count() == 4


def test_renderings(spark, tmp_path):
    df = spark.sql("select 1 as a, named_struct('x', 2, 'y', array(1, 2)) as b")
    assert json.loads(sinks.json_lines(df).collect()[0].value) == {"a": 1, "b": {"x": 2, "y": [1, 2]}}
    assert sinks.json_lines(spark.sql("select 'q' as value")).collect()[0].value == '"q"'
    sinks.write_csv(df, f"file://{tmp_path}/o")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/o").columns == ["a", "b.x", "b.y"]
    with pytest.raises(SetwiseError):
        sinks.page(df, skip=3)


def test_jdbc_needs_a_driver_and_connectors_say_so(spark):
    for f in (lambda: readers.read_kafka(spark, "h:1", "t"), lambda: readers.read_mongo(spark, "mongodb://h", "d", "c")):
        with pytest.raises(SetwiseError):
            f()


def test_enrichment(spark):
    df = spark.range(10).withColumn("b", F.lit("x"))
    got = enrichment.enrich(df, lambda rows: [{"sq": r["id"] ** 2} if r["id"] % 2 else None for r in rows], "sq bigint", batch=3)
    assert {r.id: r.sq for r in got.collect()} == {i: i * i for i in (1, 3, 5, 7, 9)}


def test_stream_ingest_resumes(spark, tmp_path):
    src, chk = f"{tmp_path}/in", f"{tmp_path}/chk"
    spark.range(5).write.parquet(f"{src}/p1")
    c = Catalog(spark, f"file://{tmp_path}/cat3")
    run = lambda: streams.ingest(streams.stream_files(spark, f"{src}/*", "id bigint"), c, "/s", chk).awaitTermination()
    run()
    run()
    assert c.read("/s").count() == 5
    spark.range(5, 8).write.parquet(f"{src}/p2")
    run()
    assert sorted(r.id for r in c.read("/s").collect()) == list(range(8))


def test_two_ingests_into_one_dataset(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat5")
    spark.range(10, 15).write.parquet(f"{tmp_path}/a/p")
    spark.range(20, 25).write.parquet(f"{tmp_path}/b/p")
    run = lambda s, chk: streams.ingest(streams.stream_files(spark, f"{tmp_path}/{s}/*", "id bigint"), c, "/t", f"{tmp_path}/{chk}").awaitTermination()
    run("a", "ca")
    run("b", "cb")
    assert sorted(r.id for r in c.read("/t").collect()) == [*range(10, 15), *range(20, 25)]
    assert c.cook("/t") == 2 and len(c.streams("/t")) == 1
    run("a", "ca")
    assert c.read("/t").count() == 10 and c.clean("/t") == 2 and c.read("/t").count() == 10


def test_readers_during_a_replacement(spark, tmp_path):
    """A reader sees the old content until the new manifest is there, and a reader's plan made before still runs after."""
    c = Catalog(spark, f"file://{tmp_path}/cat6")
    c.write("/r", spark.range(3), "create")
    before = c.read("/r")
    seen = []
    publish = c.manifest("/r").publish
    import setwise.manifest as mf

    old = mf.Manifest.publish
    try:
        mf.Manifest.publish = lambda self, v, x: (seen.append(Catalog(spark, c.root).read("/r").count()), old(self, v, x))[1]
        c.write("/r", spark.range(7), "replace")
    finally:
        mf.Manifest.publish = old
    assert publish and seen == [3] and c.read("/r").count() == 7 and before.count() == 3
    c.write("/r", spark.range(2), "replace", stream="s", terminal=False)
    assert c.read("/r").count() == 7
    c.write("/r", spark.range(4), "replace", stream="s")
    assert c.read("/r").count() == 6


def test_two_writers_of_one_version(spark, tmp_path):
    from setwise.manifest import Manifest

    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.latest() == (0, {}) and m.publish(1, {"a": 1}) and not m.publish(1, {"a": 2})
    assert m.latest() == (1, {"a": 1})
    for i in range(15):
        m.update(lambda c: {"a": c["a"] + 1})
    assert m.latest() == (16, {"a": 16}) and len(m.versions()) <= 11


def test_files_and_schedules(spark, tmp_path):
    import datetime as dt

    c = Catalog(spark, f"file://{tmp_path}/cat7")
    c.put_file("/pic", put(tmp_path, "x.bin", "abc"), "image/png")
    assert c.get_file("/pic") == (b"abc", "image/png") and c.children("/") == ["pic"]
    t = dt.datetime(2024, 1, 31, 23, 59)
    assert streams.Cron("*/15 * * * *").after(t) == dt.datetime(2024, 2, 1)
    assert streams.Cron("30 4 1,15 * 5").after(t) == dt.datetime(2024, 2, 1, 4, 30) and streams.Cron("0 0 29 2 *").after(dt.datetime(2024, 3, 1)) == dt.datetime(2028, 2, 29)
    assert streams.Cron("0 37 13 * * ?").after(t) == dt.datetime(2024, 2, 1, 13, 37) and streams.Cron("5/20 * * * * ?").after(t.replace(second=5)) == t.replace(second=25)
    assert streams.Cron("30 0 12 ? * 2").after(t) == dt.datetime(2024, 2, 5, 12, 0, 30)  # a Monday
    for bad in ("* * *", "61 * * * *", "a * * * *"):
        with pytest.raises(SetwiseError):
            streams.Cron(bad)
    c.write("/n", spark.range(4).withColumnRenamed("id", "v"))
    s = streams.Schedule(c)
    s.add("q", "0 * * * *", "n := //n {d: n.v * 2}", "/out", t)
    assert s.run_due(t) == [] and s.run_due(dt.datetime(2024, 2, 1, 0, 0)) == ["q"] and s.run_due(dt.datetime(2024, 2, 1, 0, 30)) == []
    assert c.read("/out").count() == 4


def test_enrichment_in_the_language(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["data"]
            body = json.dumps({"data": [None if r["v"] == 2 else {"sq": r["v"] ** 2} for r in rows]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    from setwise.operators.sets import Table

    n = Table(spark.range(4).withColumnRenamed("id", "v"), ("v",))
    got = query(spark, f'n := //n e := remote::enrich({{v: n.v}}, {{url: "http://127.0.0.1:{srv.server_port}/"}}) {{k: n.v, s: e.sq}}', {"/n": n}).collect()
    srv.shutdown()
    assert sorted((r.k, r.s.toPython()) for r in got) == [(0, 0), (1, 1), (3, 9)]


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("select timestamp'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 40) as ts, id % 2 as k from range(10)")
    rows.write.parquet(f"{tmp_path}/w/p")
    src = streams.stream_files(spark, f"{tmp_path}/w/*", "ts timestamp, k bigint")
    agg = streams.windowed(src, "ts", "2 minutes", ["k"], [F.count("*").alias("n")])
    q = agg.writeStream.outputMode("complete").format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w1").agg(F.sum("n")).collect()[0][0] == 10
    ses = streams.sessions(src, "ts", "1 minute", ["k"], [F.count("*").alias("n")])
    q = ses.writeStream.outputMode("complete").format("memory").queryName("w2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w2").count() == 10


def test_scheduled_query(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat4")
    c.write("/n", spark.range(4).withColumnRenamed("id", "v"))
    streams.run_scheduled(c, "n := //n {d: n.v * 2}", "/out")
    streams.run_scheduled(c, "n := //n {d: n.v * 3}", "/out")
    assert sorted(r.d for r in c.read("/out").collect()) == [0, 3, 6, 9]


def test_timeout(spark):
    from setwise.errors import QueryTimeout

    assert len(sinks.collect(spark.range(3), timeout=60)) == 3
    slow = spark.range(20_000_000, numPartitions=4).selectExpr("max(sha2(sha2(cast(id as string), 512), 512))")
    with pytest.raises(QueryTimeout):
        sinks.collect(slow, timeout=0.3)
