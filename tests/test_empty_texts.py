"""Documents without any text, in the queries over records and chunks."""

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from siftbase.operators import quality as Q
from siftbase.plans import ORACLES, QUERIES
from siftbase.plans.knowledge import records
from siftbase.sources import jsonl


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d.withColumn("text", F.when(F.col("doc_id").isin(20, 31, 47, 58), "").otherwise(F.col("text"))).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def equals_sql(spark, path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df, cur = QUERIES[name](spark, path), con.execute(ORACLES[name])
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([c[0] for c in cur.description], cur.fetchall())


def test_verify_kb(spark, empty_dir):
    equals_sql(spark, empty_dir, "verify_kb")
    # the rule itself holds: a chunk without text fails
    assert Q.rule_report(records(spark, empty_dir).withColumn("chunk_ordinal", F.lit(0)), "chunk_id", Q.chunk_rules()).where("rule = 'text_filled'").count() == 4


def test_kb_write_read(spark, empty_dir, monkeypatch):
    """Every record is written; those without text have no chunk, as in the reference."""
    counts, write = [], jsonl.write_knowledge_base

    def counted(records, chunks, path):
        counts.append((records.count(), chunks.count()))
        return write(records, chunks, path)

    monkeypatch.setattr(jsonl, "write_knowledge_base", counted)
    equals_sql(spark, empty_dir, "kb_write_read")
    assert counts == [(200, 196)]
