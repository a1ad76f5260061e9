"""The term-clustered index: equal to the full form, reads its buckets, skips blocks, takes upserts as segments."""

import os

import pytest
from pyspark.sql import functions as F

from siftbase.operators import blocks as bk, index as ix, retrieve as rt
from siftbase.plans import corpus as C
from test_retrieval import rows


@pytest.fixture(scope="module")
def forward(spark, sf_dir):
    return ix.store_index(ix.build_index(C.chunks(spark, sf_dir)))


@pytest.fixture(scope="module")
def terms(forward, tmp_path_factory):
    return bk.TermIndex.build(forward, str(tmp_path_factory.mktemp("terms")))


def stop_word_queries(spark, forward):
    """Frequent words of the corpus alone, one with a rare word, one with none that occurs, one of a filter that nothing passes."""
    df = {r.term: r.df for r in ix.term_stats(forward).collect()}
    often = sorted(df, key=lambda t: (-df[t], t))[:12]
    rare = sorted(t for t, n in df.items() if n == 1)[:3]
    none = ["nothing-has-this"]
    data = [("s1", " ".join(often), 5, None), ("s2", " ".join(often[:6] + rare[:1]), 10, None), ("s3", "zzqqx", 5, None), ("s4", often[0], 25, None), ("s5", " ".join(often), 5, none), ("s6", " ".join(rare), 1, None)]
    return spark.createDataFrame(data, "query_id string, query string, top_k int, collection_categories array<string>")


def test_equal_to_the_full_form(spark, sf_dir, forward, terms):
    """With bounds and without."""
    for asked in (C.filtered_queries(spark, sf_dir), stop_word_queries(spark, forward)):
        expected, full = rows(rt.retrieve(forward, asked, C.ref_ts())), rt.bm25(forward, asked)
        for options in ({"skip_from": 0, "seeds": 1}, {}):
            assert rows(bk.retrieve(terms, asked, C.ref_ts(), **options)) == expected
            assert rows(bk.bm25(terms, asked, **options).select(full.columns)) == rows(full)


def test_small_blocks_are_skipped(spark, sf_dir, forward, tmp_path, monkeypatch):
    """With blocks of four chunks the threshold leaves few (query, block) pairs, and the lists are the same."""
    monkeypatch.setattr(bk, "BLOCK_BITS", 2)
    index = bk.TermIndex.build(forward, str(tmp_path))
    asked = C.benchmark_queries(spark, sf_dir)
    counts = {}
    reaching = bk._reaching

    def counted(ranked, thresholds, seeds):
        out = reaching(ranked, thresholds, seeds)
        counts.update(all=ranked.count(), rest=out.count(), seeds=ranked.where(F.col("_place") <= seeds).count())
        return out

    monkeypatch.setattr(bk, "_reaching", counted)
    assert rows(bk.retrieve(index, asked, C.ref_ts(), skip_from=0)) == rows(rt.retrieve(forward, asked, C.ref_ts()))
    assert counts["seeds"] + counts["rest"] < 0.6 * counts["all"]


def test_bounds_hold(spark, terms):
    """No posting weighs more than the bound of its block."""
    joined = terms.postings().withColumn("idf", F.lit(1.0)).join(terms.bounds(), ["term", "block"])
    over = joined.where(bk._weight(terms, "tf", "token_count") > bk._weight(terms, "max_tf", "min_length") + 1e-12)
    assert over.count() == 0
    assert terms.bounds().agg(F.sum("n")).first()[0] == terms.postings().count()


def test_a_batch_reads_its_buckets_only(spark, sf_dir, forward, tmp_path, monkeypatch):
    monkeypatch.setattr(bk, "BUCKET_CHUNKS", 10)
    index = bk.TermIndex.build(forward, str(tmp_path))
    assert index.segments[0]["buckets"] == 20
    asked = spark.createDataFrame([("q", "alpha beta")], "query_id string, term string")
    buckets = index.buckets_of(asked.select(F.explode(F.split("term", " ")).alias("term")))
    assert 1 <= len(buckets[0]) <= 2
    for df in (index.postings(buckets), index.bounds(buckets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan and "Generate" not in plan
    full = rt.bm25(forward, C.benchmark_queries(spark, sf_dir))
    assert rows(bk.bm25(index, C.benchmark_queries(spark, sf_dir)).select(full.columns)) == rows(full)


def test_upserts_write_segments_and_equal_a_rebuilt_index(spark, sf_dir, forward, tmp_path):
    asked, terms = C.filtered_queries(spark, sf_dir), bk.TermIndex.build(forward, str(tmp_path))
    files = {os.path.join(d, f) for d, _, fs in os.walk(terms.path) for f in fs}
    chunks = C.chunks(spark, sf_dir)
    i = F.substring("chunk_id", 2, 12).cast("int")
    changed = chunks.where(i % 50 == 7).withColumn("text", F.concat(F.lit("brand new words here "), F.reverse("text")))
    added = chunks.where(i % 100 == 3).withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    batch = ix.build_index(changed.unionByName(added))
    newer = terms.upsert(batch)
    assert len(newer.segments) == 2 and newer.segments[0] == terms.segments[0]
    assert files <= {os.path.join(d, f) for d, _, fs in os.walk(terms.path) for f in fs}  # nothing old is rewritten
    want = ix.store_index(ix.build_index(chunks.where(i % 50 != 7).unionByName(changed).unionByName(added)))
    stats = ix.corpus_stats(want).first()
    assert newer.n_chunks == stats.n_chunks and abs(newer.avg_length - stats.avg_length) < 1e-9
    every = ix.term_stats(want)
    assert rows(newer.document_frequencies(every.select("term"))) == rows(every.select("term", "df"))
    expected, full = rows(rt.retrieve(want, asked, C.ref_ts())), rt.bm25(want, asked)
    assert rows(bk.retrieve(newer, asked, C.ref_ts())) == expected and rows(bk.retrieve(newer, asked, C.ref_ts(), skip_from=0)) == expected
    assert rows(bk.bm25(newer, asked, skip_from=0).select(full.columns)) == rows(full)
    assert rows(bk.bm25(newer, asked).select(full.columns)) == rows(full)
    # the version before is still read as it was
    assert rows(bk.retrieve(bk.TermIndex(spark, terms.path, 1), asked, C.ref_ts())) == rows(rt.retrieve(forward, asked, C.ref_ts()))
    twice = newer.upsert(batch)  # the same rows again replace themselves
    assert rows(bk.retrieve(twice, asked, C.ref_ts())) == expected
    one = twice.compact()
    assert len(one.segments) == 1 and one.n_chunks == newer.n_chunks
    assert rows(bk.retrieve(one, asked, C.ref_ts())) == expected
    assert len(one.vacuum(1)) == 5 and rows(bk.retrieve(one, asked, C.ref_ts())) == expected


def test_matched_terms(spark, sf_dir, forward, terms):
    asked = C.filtered_queries(spark, sf_dir)
    found = rt.retrieve(forward, asked, C.ref_ts()).select("query_id", "chunk_id", "rank")
    words = rt.query_terms(asked)
    columns = ["query_id", "chunk_id", "rank", "matched_terms"]
    assert rows(bk.matched_terms(found, terms, words).select(columns)) == rows(rt.matched_terms(found, forward, words).select(columns))


def test_chunks_of_the_corpus_are_not_broadcast(spark, sf_dir, terms):
    found = bk.retrieve(terms, C.filtered_queries(spark, sf_dir), C.ref_ts())
    found.write.format("noop").mode("overwrite").save()
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and line.count("chunk_no#") == 2]
    assert joins and not [line for line in joins if "Broadcast" in line]
