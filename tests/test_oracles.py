"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

import check
from siftbase.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = check.rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == check.rows_of(columns, cur.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "lexical_score", "n_terms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
