import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from setwise.session import get_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, dir): rows of the Spark query and of DuckDB's, order aside, floats to 9 digits."""
    import datetime
    import decimal
    import math

    import duckdb

    def norm(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return "NULL" if math.isnan(v) else f"{v:.9g}" if v else "0"
        if isinstance(v, bool) or v is None:
            return "NULL" if v is None else str(v)
        if isinstance(v, int):
            return f"{float(v):.9g}" if abs(v) < 2**53 and v else str(v)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
            return "[" + ",".join(map(norm, v)) + "]"
        if hasattr(v, "asDict"):
            v = v.asDict()
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}:{norm(v[k])}" for k in sorted(v)) + "}"
        return str(v)

    def run(query, sql, d):
        con = duckdb.connect()
        for f in os.listdir(d):
            p = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
            con.execute(f"create view {f.split('.')[0]} as select * from '{p}'")
        con.execute("set timezone='UTC'")
        df = query(spark, d)
        cols = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
        assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
        assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]
        return got

    return run
