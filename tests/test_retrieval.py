import pytest
from pyspark.sql import functions as F

from siftbase.operators import index as ix, retrieve as rt, roles
from siftbase.operators.vocabulary import synonym_pairs
from siftbase.plans import corpus as C
from siftbase.session import positions, salted_join


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return ix.store_index(ix.build_index(C.chunks(spark, sf_dir)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_large_query_sets_take_the_salted_path_with_equal_results(spark, sf_dir, index, monkeypatch):
    asked = C.filtered_queries(spark, sf_dir)
    broadcast = rows(rt.retrieve(index, asked, C.ref_ts()))
    monkeypatch.setattr(rt, "is_small", lambda *a, **k: False)
    assert rows(rt.retrieve(index, asked, C.ref_ts())) == broadcast


def every_pair(state, asked):
    """All (query, chunk) pairs with the part of the score that needs no term; for small fixtures only."""
    pairs = asked.crossJoin(state).filter(rt.passes_filters())
    for name in ("lexical_score", "title_boost", "category_boost"):
        pairs = pairs.withColumn(name, F.lit(0.0))
    return pairs.withColumn("deadline_penalty", rt.deadline_penalty(F.col("status"), F.col("listing"))).withColumn("score", rt.total_score()).filter("score > 0")


def test_zero_match_shortcut_equals_every_pair(spark, sf_dir, index):
    state = rt.chunk_state(index, C.ref_ts())
    asked = rt.with_defaults(C.filtered_queries(spark, sf_dir)).drop("query").withColumn("listing", F.crc32("query_id") % 2 == 0)
    fast = rt.zero_match_candidates(state, asked).select("query_id", "chunk_id", "score")
    exact = rt._best(every_pair(state, asked), "query_id").select("query_id", "chunk_id", "score")
    assert rows(fast) == rows(exact)


def small_corpus(spark):
    base = {"source_id": "s", "source_name": "board", "category": "공지", "collection_category": "notice", "source_family": "f", "deadline_status": "unknown", "deadline_raw_text": ""}
    data = [
        ("a", "인턴 채용", "채용 공고 인턴 모집", "job_posting", "~1/5"), ("b", "상담 안내", "진로 상담예약 방법", "guide", ""), ("c", "후기", "선배 취업성공후기", "career_review", "상시채용"),
        ("d", "로그인", "포털시스템 로그인 공유 인쇄", "notice", ""),
    ]
    rows_ = [{**base, "chunk_id": i, "title": t, "text": x, "collection_category": k, "deadline_raw_text": raw} for i, t, x, k, raw in data]
    df = spark.createDataFrame(rows_)
    return df.withColumn("posted_at", F.lit(None).cast("timestamp")).withColumn("fetched_at", F.lit("2026-05-01").cast("timestamp"))


def test_scoring_rules_on_a_small_corpus(spark):
    ref = F.lit("2026-05-10").cast("timestamp")
    idx = ix.build_index(small_corpus(spark))
    asked = spark.createDataFrame([("q1", "인턴십", 5), ("q2", "zzz", 5), ("q3", "난 지금", 5), ("q4", "인턴십", 0)], "query_id string, query string, top_k int")
    out = {(r.query_id, r.chunk_id): r for r in rt.retrieve(idx, asked, ref).collect()}
    hit = out[("q1", "a")]
    assert hit.deadline_penalty == 0.5 and hit.freshness_boost == 0.2 and hit.title_boost >= 0.25 and hit.normalized_score == 1.0
    assert out[("q2", "c")].score == 0.35 and out[("q2", "c")].lexical_score == 0.0
    assert ("q2", "d") not in out
    assert not [k for k in out if k[0] in ("q3", "q4")]


def test_last_synonym_group_wins():
    pairs = synonym_pairs()
    assert ("인턴", "현장실습") in pairs and ("인턴", "intern") not in pairs and ("intern", "인턴") in pairs


def test_merge_keeps_first_position_and_best_row(spark):
    lists = spark.createDataFrame(
        [("q", "x", 2, 1, 1.0, 0.5), ("q", "y", 2, 2, 3.0, 1.0), ("q", "x", 2, 3, 2.0, 0.7), ("q", "z", 2, 4, 9.0, 1.0)],
        "query_id string, chunk_id string, top_k int, pos int, score double, normalized_score double",
    )
    assert rows(roles.merge_lists(lists)) == [("q", "x", 1, 2.0, 0.7), ("q", "y", 2, 3.0, 1.0)]


def test_salted_join_and_positions_on_a_hot_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(salted_join(left, right, "k", "id").select("k", "id", "v")) == rows(left.join(right, "k").select("k", "id", "v"))
    numbered = positions(left, ["k"], ["id"])
    from pyspark.sql import Window

    expected = left.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert rows(numbered.select("k", "id", "position")) == rows(expected.select("k", "id", "position"))


def test_sum_per_chunk_needs_no_shuffle_after_the_hits_are_hashed(spark, sf_dir, index):
    plan = rt.retrieve(index, C.benchmark_queries(spark, sf_dir), C.ref_ts())._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
