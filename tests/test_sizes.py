"""Plans that must not depend on how small a file looks."""

import pytest
from pyspark.sql import functions as F

from siftbase.functions import text as T
from siftbase.operators import blocks as bk, index as ix, retrieve as rt, scoring as sc
from siftbase.plans import corpus as C
from siftbase.session import stored_side, written
from test_retrieval import rows


@pytest.fixture(scope="module")
def forward(spark, sf_dir):
    return ix.store_index(ix.build_index(C.chunks(spark, sf_dir)))


def test_a_side_of_many_rows_in_a_small_file_is_not_broadcast(spark):
    """Rows that compress to almost nothing, as (query, block, term) do: the planner sees a few kilobytes."""
    side = stored_side(spark.range(0, 600_000, 1, 4).select((F.col("id") % 7).alias("k"), F.lit("term").alias("term")), "many")
    big = written(spark.range(0, 50).select((F.col("id") % 7).alias("k")), "big")
    joined = big.join(side, "k")
    assert joined.count() > 600_000
    joined.write.format("noop").mode("overwrite").save()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_batch_of_many_query_block_pairs_needs_no_bounds(spark, sf_dir, forward, tmp_path, monkeypatch):
    index, asked = bk.TermIndex.build(forward, str(tmp_path)), C.benchmark_queries(spark, sf_dir)
    monkeypatch.setattr(bk, "SKIP_PAIRS", index.n_blocks * asked.count() - 1)

    def bounded(*args):
        raise AssertionError("a row for each query and block")

    monkeypatch.setattr(bk, "_by_bound", bounded)
    assert rows(bk.retrieve(index, asked, C.ref_ts(), skip_from=0)) == rows(rt.retrieve(forward, asked, C.ref_ts()))
    full = rt.bm25(forward, asked)
    assert rows(bk.bm25(index, asked, skip_from=0).select(full.columns)) == rows(full)


def test_a_task_keeps_the_best_rows_of_all_its_groups(spark, sf_dir, forward, tmp_path, monkeypatch):
    """One task, many groups of chunks: top_k rows per query, not per query and group, and no copy of a group is shuffled."""
    monkeypatch.setattr(sc, "GROUP_CHUNKS", 30)
    monkeypatch.setattr(sc, "CELLS_PER_CORE", 0)
    index, asked = bk.TermIndex.build(forward, str(tmp_path)), C.filtered_queries(spark, sf_dir)
    made, top_lists = [], sc.top_lists
    monkeypatch.setattr(sc, "top_lists", lambda *a, **k: made.append(top_lists(*a, **k)) or made[-1])
    assert rows(bk.retrieve(index, asked, C.ref_ts())) == rows(rt.retrieve(forward, asked, C.ref_ts()))
    assert index.n_chunks > 3 * sc.GROUP_CHUNKS
    assert made[0].groupBy("qn").count().agg(F.max("count")).first()[0] == 10


@pytest.mark.parametrize("most", [4, 32_768])
def test_queries_of_the_same_terms(spark, sf_dir, forward, tmp_path, monkeypatch, most):
    """Together in a group, or dealt out when they are too many, they get the same lists."""
    monkeypatch.setattr(sc, "GROUP_QUERIES", most)
    monkeypatch.setattr(sc, "FEWEST_QUERIES", 1)
    index, asked = bk.TermIndex.build(forward, str(tmp_path)), C.filtered_queries(spark, sf_dir).limit(5)
    copies = asked.withColumn("_c", F.explode(F.array(*[F.lit(f"-{i}") for i in range(9)]))).withColumn("query_id", F.concat("query_id", "_c")).drop("_c")
    assert rows(bk.retrieve(index, copies, C.ref_ts())) == rows(rt.retrieve(forward, copies, C.ref_ts()))


def test_a_labelled_value_splits_its_text_once(spark):
    bodies = ["제목\n Hall  A \r\n\n둘째 줄\n기간\nx", "x\n 제목 \n기간\n제목\ny", "제목", "제목\n" + "w" * 201, "no label", "in 제목 line\nz", "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", T.labelled_value("body", "제목", ["제목", "기간"]).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == ["Hall A 둘째 줄", None, None, None, None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
