"""Every query that has an SQL statement gives DuckDB's rows on the small tables; the others run."""

import pytest

import __spark_entry__ as entry

Q, O = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_matches_sql(name, compare, sf_dir):
    compare(Q[name], O[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(name, spark, sf_dir):
    df = Q[name](spark, sf_dir)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["agent_id", "msg_offset"]
