import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setwise.operators import rejects as rj

DIALECTS = [(",", '"', '"'), (",", '"', "\\"), ("\t", "'", "\\"), ("|", "'", "'"), (";", '"', ""), (",", '"', "^")]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=",;|\t\"'\\^ab\r\n ", max_size=14), st.sampled_from(DIALECTS))
def test_reader_equals_plain_rules(line, dialect):
    plain = rj._plain_split(line[:-1] if line.endswith("\r") else line, *dialect)
    assert rj.split_line(line, *dialect) == plain


@pytest.mark.parametrize(
    "line,types,why",
    [
        ('1,"a""b",true', ["long", "string", "boolean"], None),
        ('1,"a\\"b",TRUE\r', ["long", "string", "boolean"], None),
        ('1,"ab,true', ["long", "string", "boolean"], "quoting"),
        ('1,"ab"x,true', ["long", "string", "boolean"], "quoting"),
        ('1,a"b"x,true', ["long", "string", "boolean"], None),
        ("1,2", ["long", "string", "boolean"], "columns"),
        ("", ["string"], None),
        (None, ["long"], None),
        (" 12 ", ["long"], None),
        ("9223372036854775807", ["long"], None),
        ("-9223372036854775808", ["long"], None),
        ("9223372036854775808", ["long"], "value"),
        ("0" * 5000 + "7", ["long"], None),
        ("9" * 5000, ["long"], "value"),
        ("+1", ["long"], "value"),
        ("1.", ["double"], "value"),
        ("-0.5e-3", ["double"], None),
        ("01.5", ["double"], "value"),
        ("NaN", ["double"], "value"),
        ("yes", ["boolean"], "value"),
        ("2012-02-29T00:00:00Z", ["timestamp"], None),
        ("2013-02-29T00:00:00", ["timestamp"], "value"),
        ("2012-1-5T1:2:3", ["timestamp"], "value"),
        ("2012-01-05T24:00:00", ["timestamp"], "value"),
        ("whatever", ["odd"], None),
    ],
)
def test_reasons(line, types, why):
    assert rj.check_line(line, ",", '"', "\\", types, len(types))[0] == why


def batches(spark, rows):
    return spark.createDataFrame(rows, "ingest_no bigint, delimiter string, quote_char string, escape_char string, column_names array<string>, column_types array<string>")


def test_batches(spark):
    b = batches(spark, [(1, ",", '"', '"', ["a", "b"], ["long", "string"])] * 2 + [(2, "||", None, None, ["a"], None), (3, ",", '"', '"', None, None), (None, ",", '"', '"', ["a"], ["long"]), (4, ",", '"', '"', ["x"], ["long"])])
    lines = [(1, 1, 1, "1,x"), (2, 1, 2, "q,x"), (3, 1, 2, "q,x"), (4, 1, 3, '1,"x'), (5, 1, 4, None), (6, 2, 1, "a||b"), (7, 2, 2, '"a'), (8, 3, 1, "x"), (9, 99, 1, "x"), (10, None, 1, "x"), (11, 1, 5, '2,"' + "y" * 300_000 + '"')]
    df = spark.createDataFrame(lines, "line_id bigint, ingest_no bigint, line_no int, raw_line string").selectExpr("*", "'z' as d", "1 as reason", "2 as fields", "3 as w")
    assert sorted(map(tuple, rj.failed_lines(df, b).collect())) == [(1, 2, "value"), (1, 3, "quoting"), (1, 4, "columns"), (2, 1, "columns"), (3, 1, "columns")]
    assert {(r.ingest_no, r.line_no): len(r.fields) for r in rj.loaded_lines(df, b).collect()} == {(1, 1): 2, (1, 5): 2, (2, 2): 1}
    res = {r.ingest_no: (r.total, r.ingested, r.quoting, r["columns"], r.value) for r in rj.batch_results(df, b).collect()}
    assert res == {1: (5, 2, 1, 1, 1), 2: (2, 1, 0, 1, 0), 3: (1, 0, 0, 1, 0), 4: (0, 0, 0, 0, 0)}
    assert rj.failed_lines(df.limit(0), b).count() == 0 and rj.failed_lines(df, b.limit(0)).count() == 0


def test_whole_tables_against_plain_rules(spark, sf_dir):
    from setwise.session import table

    dialect = {r.ingest_no: r for r in table(spark, sf_dir, "ingest_batches").collect()}
    want = set()
    for r in table(spark, sf_dir, "ingest_lines").collect():
        b = dialect[r.ingest_no]
        line = r.raw_line[:-1] if r.raw_line.endswith("\r") else r.raw_line
        f = rj._plain_split(line, b.delimiter, b.quote_char, b.escape_char)
        if f is None:
            want.add((r.ingest_no, r.line_no, "quoting"))
        elif len(f) != len(b.column_names):
            want.add((r.ingest_no, r.line_no, "columns"))
        elif any(x.strip() and t in rj._FITS and not rj._FITS[t](x.strip()) for x, t in zip(f, b.column_types)):
            want.add((r.ingest_no, r.line_no, "value"))
    assert {tuple(r) for r in rj.failed_lines(table(spark, sf_dir, "ingest_lines"), table(spark, sf_dir, "ingest_batches")).collect()} == want
