"""Registered queries of the subpackage: against DuckDB where there is SQL, and the pipeline against its stages' rules."""

import duckdb
import pytest

import check
import corpus_pipeline
from siftbase.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cur.fetchall())


def test_held_out_languages(spark, sf_dir):
    told = QUERIES["op8_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = told.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_pipeline(spark, sf_dir):
    from test_llm_operators import linked

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    language, exact, near, mixture, _ = (f for _, f in corpus_pipeline.STAGES)
    one = language(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() == docs.where("text RLIKE '\\\\p{L}'").count()
    two = exact(spark, one, sf_dir)
    texts = {r.doc_id: r.text for r in two.collect()}
    assert len(texts) == one.selectExpr("translate(text, ' \\t\\n\\r\\f', '') AS t").distinct().count()
    ids = sorted(texts)
    _, label = linked([texts[i] for i in ids])
    three = near(spark, two, sf_dir)
    assert sorted(r.doc_id for r in three.collect()) == [i for k, i in enumerate(ids) if label[k] == k]
    four = mixture(spark, three, sf_dir)
    assert four.columns == docs.columns
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    whole = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"piece": "max"}).withColumnRenamed("max(piece)", "n").collect()}
    assert set(whole) == {r.doc_id for r in four.select("doc_id").distinct().collect()}
