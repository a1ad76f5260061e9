"""Groups of chunks against groups of queries: the lists of the full form, and no row per (query, chunk)."""

import pytest
from pyspark.sql import functions as F

from siftbase.operators import blocks as bk, index as ix, recommend as R, retrieve as rt, scoring as sc
from siftbase.plans import corpus as C, state
from test_blocks import stop_word_queries
from test_retrieval import rows


@pytest.fixture(scope="module")
def forward(spark, sf_dir):
    """Every chunk also as a copy, so that ids decide most places."""
    chunks = C.chunks(spark, sf_dir)
    return ix.store_index(ix.build_index(chunks.unionByName(chunks.withColumn("chunk_id", F.concat(F.lit("b"), "chunk_id")))))


def test_small_groups_give_the_lists_of_the_full_form(spark, sf_dir, forward, tmp_path, monkeypatch):
    monkeypatch.setattr(sc, "GROUP_CHUNKS", 30)
    monkeypatch.setattr(sc, "GROUP_QUERIES", 4)
    index = bk.TermIndex.build(forward, str(tmp_path))
    made = []
    top_lists = sc.top_lists

    def counted(*args, **kwargs):
        made.append((args[2].count(), top_lists(*args, **kwargs)))
        return made[-1][1]

    monkeypatch.setattr(sc, "top_lists", counted)
    for asked in (C.filtered_queries(spark, sf_dir), stop_word_queries(spark, forward)):
        assert rows(bk.retrieve(index, asked, C.ref_ts())) == rows(rt.retrieve(forward, asked, C.ref_ts()))
        full = rt.bm25(forward, asked)
        assert rows(bk.bm25(index, asked).select(full.columns)) == rows(full)
    groups = -(-index.n_chunks // 30)
    assert groups > 3 and len(made) == 4
    for queries, found in made:
        assert found.groupBy("qn").count().where(F.col("count") > groups * 25).count() == 0 and found.count() > queries


def test_equal_profiles_are_searched_once(spark, sf_dir, forward, tmp_path):
    index = bk.TermIndex.build(forward, str(tmp_path))
    profiles = state.profiles(spark, sf_dir)
    twice = profiles.unionByName(profiles.withColumn("query_id", F.concat(F.lit("again"), "query_id")))
    chunks = C.chunks(spark, sf_dir)
    anchor = F.struct(F.col("canonical_url").alias("url"), F.col("title").alias("label"), F.lit(None).cast("int").alias("page_number"))
    chunks = chunks.withColumn("citation_anchors", F.array(anchor))
    asked = []

    def search(index, queries, *args, **kwargs):
        asked.append(queries.count())
        return bk.retrieve(index, queries, *args, **kwargs)

    def lists(p):
        return R.recommend(index, chunks, p, C.ref_ts(), search=search, explain=bk.matched_terms).select("query_id", "position", "chunk_id", "final_score", F.array_join("match_reasons", "|").alias("reasons"))

    once, both = rows(lists(profiles)), lists(twice).withColumn("query_id", F.regexp_replace("query_id", "^again", ""))
    assert asked[0] == asked[1] < profiles.count()
    assert sorted(rows(both), key=repr) == sorted([*once, *once], key=repr)
