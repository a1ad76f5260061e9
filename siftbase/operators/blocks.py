"""Term-clustered index in immutable segments, and exact top lists that skip what cannot reach them.

A segment numbers its chunks so that ``chunk_no >> BLOCK_BITS`` is a block of
neighbours, alike in filter attributes and length.  Its tables:

- ``chunks``: the forward index with numbers; retrieval reads narrow columns of it;
- ``postings``: one row per (term, chunk), in folders by term bucket, sorted by term;
- ``bounds``: one row per (term, block) with the greatest term frequency and the
  smallest length, from which no chunk of the block can weigh more.

A batch of queries reads the buckets of its terms only.  A small batch in a large index bounds every (query,
block) from ``bounds``, scores the most promising blocks exactly, takes the
k-th best score so far as a threshold, and scores of the other blocks only those
whose bound reaches it.  Blocks below cannot hold a result, so the lists are
those of ``retrieve.retrieve``.

An upsert writes one new segment, the numbers of the chunks that it replaces and
how often their terms occurred; a version's manifest names the parts that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftbase.functions import text as T
from siftbase.operators import retrieve as rt, scoring as sc
from siftbase.operators.vocabulary import FILLER_TERMS, LISTING_TERMS, SYNONYM_GROUPS
from siftbase.session import broadcast_if_small, computed_once, shared_dir, stored_side, written
from siftbase.sources.versions import Versions

BLOCK_BITS = 7
SEGMENT_BITS = 52

#: Chunks of a segment for each of its buckets, the most buckets, and the chunks of a posting file's shard.
BUCKET_CHUNKS, MAX_BUCKETS, SHARD_CHUNKS = 4_000, 4096, 1_000_000

#: Blocks of a query that are scored before a threshold is known, and the rounding that a bound must allow for.
SEEDS, SLACK = 4, 1e-5

#: Bounds cost some jobs of their own and a row for each query and block: an index of fewer blocks, and a batch of more such pairs, is scored without them.
SKIP_FROM, SKIP_PAIRS = 4096, 1 << 18

ATTRIBUTES = list(rt.FILTERS.values())

_POSTINGS = "term string, chunk_no long, tf int, in_title boolean, in_category boolean, token_count long, bucket int"
_BOUNDS = "term string, block long, n long, max_tf int, min_length long, in_title int, in_category int, bucket int"


def block_of(chunk_no: str = "chunk_no") -> Column:
    return F.shiftright(F.col(chunk_no), BLOCK_BITS)


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TermIndex:
    """A stored index at one version; ``upsert`` and ``compact`` give the next one, and leave this readable."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self._versions = spark, path, Versions(path)
        self.manifest = self._versions.read(spark, version)
        if self.manifest is None:
            raise ValueError(f"no index at {path}")

    @classmethod
    def build(cls, index: DataFrame, path: str | None = None) -> TermIndex:
        """Store ``build_index`` rows as a first segment."""
        spark = index.sparkSession
        path = path or f"{shared_dir(spark)}/siftbase/{spark.sparkContext.applicationId}/terms-{uuid.uuid4().hex}"
        Versions(path).commit(spark, {"segments": [_write_segment(index, path, 0)], "replaced": [], "n_replaced": 0, "replaced_length": 0}, 0)
        return cls(spark, path)

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]

    @property
    def n_chunks(self) -> int:
        return sum(s["n_chunks"] for s in self.segments) - self.manifest["n_replaced"]

    @property
    def n_blocks(self) -> int:
        """At least so many blocks hold the chunks."""
        return sum(-(-s["n_chunks"] // (1 << BLOCK_BITS)) for s in self.segments)

    @property
    def avg_length(self) -> float:
        """O-88: mean length, at least 1, from the counts of the manifest."""
        return max(1.0, (sum(s["length"] for s in self.segments) - self.manifest["replaced_length"]) / self.n_chunks) if self.n_chunks else 1.0

    def _table(self, name: str, schema: str, buckets: list[list[int]] | None = None) -> DataFrame:
        parts = []
        for i, segment in enumerate(self.segments):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{segment['folder']}/{name}")
            parts.append(part.where(F.col("bucket").isin(buckets[i])) if buckets is not None else part)
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def buckets_of(self, terms: DataFrame) -> list[list[int]]:
        """Per segment, the buckets that hold these terms: at most a number per bucket reaches the driver."""
        sizes = sorted({s["buckets"] for s in self.segments})
        used = {n: [r.b for r in terms.select(bucket_of("term", n).alias("b")).distinct().collect()] for n in sizes}
        return [used[s["buckets"]] for s in self.segments]

    def postings(self, buckets: list[list[int]] | None = None) -> DataFrame:
        return self._table("postings", _POSTINGS, buckets).drop("bucket").withColumn("block", block_of())

    def bounds(self, buckets: list[list[int]] | None = None) -> DataFrame:
        return self._table("bounds", _BOUNDS, buckets).drop("bucket")

    def _replaced(self, name: str, schema: str) -> DataFrame | None:
        folders = [f"{self.path}/{f}/{name}" for f in self.manifest["replaced"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else None

    def chunks(self) -> DataFrame:
        """The forward rows that count, with their numbers."""
        rows = self._table("chunks", self.segments[0]["schema"])
        gone = self._replaced("chunks", "chunk_no long")
        return rows if gone is None else rows.join(broadcast_if_small(gone), "chunk_no", "left_anti")

    def alive(self, rows: DataFrame) -> DataFrame:
        gone = self._replaced("chunks", "chunk_no long")
        return rows if gone is None else rows.join(broadcast_if_small(gone), "chunk_no", "left_anti")

    def document_frequencies(self, terms: DataFrame, buckets: list[list[int]] | None = None) -> DataFrame:
        """O-88: (term, df) of these distinct terms, summed over blocks and segments, without replaced chunks."""
        buckets = self.buckets_of(terms) if buckets is None else buckets
        counts = self.bounds(buckets).select("term", "n")
        gone = self._replaced("terms", "term string, n long")
        if gone is not None:
            counts = counts.unionByName(gone.select("term", (-F.col("n")).alias("n")))
        return counts.join(broadcast_if_small(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def upsert(self, index: DataFrame) -> TermIndex:
        """Add ``build_index`` rows; a stored chunk of the same id is replaced.  Writes one segment and the marks of what it replaces."""
        index = written(index, "upsert")
        found = self.chunks().join(broadcast_if_small(index.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_no", "token_count", "postings.term")
        found = written(found, "found")
        folder = f"replaced/{uuid.uuid4().hex}"
        found.select("chunk_no").write.parquet(f"{self.path}/{folder}/chunks")
        found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/{folder}/terms")
        sums = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("length")).first()
        number = max(s["number"] for s in self.segments) + 1
        body = {k: self.manifest[k] for k in ("segments", "replaced", "n_replaced", "replaced_length")}
        body = {
            "segments": [*body["segments"], _write_segment(index, self.path, number)], "replaced": [*body["replaced"], folder],
            "n_replaced": body["n_replaced"] + sums.n, "replaced_length": body["replaced_length"] + sums.length,
        }
        return TermIndex(self.spark, self.path, self._versions.commit(self.spark, body, self.manifest["version"]))

    def compact(self) -> TermIndex:
        """The same rows as one segment without marks: for when upserts have left many."""
        number = max(s["number"] for s in self.segments) + 1
        segment = _write_segment(self.chunks().drop("chunk_no"), self.path, number)
        body = {"segments": [segment], "replaced": [], "n_replaced": 0, "replaced_length": 0}
        return TermIndex(self.spark, self.path, self._versions.commit(self.spark, body, self.manifest["version"]))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions; the segments and marks that none of those names are removed and returned."""
        return self._versions.vacuum(self.spark, keep, lambda m: {s["folder"] for s in m["segments"]} | set(m["replaced"]))


def _write_segment(index: DataFrame, path: str, number: int) -> dict:
    """Write the three tables of a segment; rows are ordered within their partitions, so only postings are shuffled."""
    spark, folder = index.sparkSession, f"segments/{number}-{uuid.uuid4().hex}"
    order = ["collection_category", "source_family", "source_id", "token_count", "chunk_id"]
    placed = index.sortWithinPartitions(*order).withColumn("chunk_no", F.lit(number << SEGMENT_BITS).cast("bigint") + F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/{folder}/chunks")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/{folder}/chunks")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("length")).first()
    buckets = max(1, min(MAX_BUCKETS, -(-total.n // BUCKET_CHUNKS)))
    shards = max(1, -(-total.n // SHARD_CHUNKS))
    posted = rows.select("chunk_no", "token_count", F.explode("postings").alias("p")).select("p.*", "chunk_no", "token_count")
    posted = posted.withColumn("bucket", bucket_of("term", buckets)).withColumn("_shard", F.pmod(block_of(), F.lit(shards)))
    # a term of many chunks is spread over the shards of its bucket
    posted.repartition("bucket", "_shard").sortWithinPartitions("bucket", "term", "chunk_no").drop("_shard").write.partitionBy("bucket").parquet(f"{path}/{folder}/postings")
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/{folder}/postings")
    bounds = stored.groupBy("bucket", "term", block_of().alias("block")).agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("token_count").alias("min_length"),
        F.max(F.col("in_title").cast("int")).alias("in_title"), F.max(F.col("in_category").cast("int")).alias("in_category"),
    )
    bounds.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}/bounds")
    return {"folder": folder, "number": number, "buckets": buckets, "n_chunks": total.n, "length": total.length, "schema": _ddl(placed)}


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _weighted(index: TermIndex, terms: DataFrame) -> tuple[DataFrame, list[list[int]]]:
    """(qn, term, idf) of the query terms that occur, and the buckets they are in."""
    distinct = terms.select("term").distinct()
    buckets = index.buckets_of(distinct)
    df = index.document_frequencies(distinct, buckets)
    weighted = terms.join(df, "term").select("qn", "term", rt.idf(F.lit(index.n_chunks), F.col("df")).alias("idf"))
    return stored_side(weighted, "weighted"), buckets


def _bounds_pay(index: TermIndex, queries: DataFrame, skip_from: int) -> bool:
    return index.n_blocks >= skip_from and index.n_blocks * queries.count() <= SKIP_PAIRS


def _weight(index: TermIndex, tf: str, length: str) -> Column:
    return rt.bm25_weight(F.col("idf"), F.col(tf), F.col(length), F.lit(index.avg_length))


def _bounded(index: TermIndex, weighted: DataFrame, buckets: list[list[int]]) -> DataFrame:
    """(qn, block, bound): what no chunk of the block exceeds by matching terms alone, per query term that occurs in it."""
    met = index.bounds(buckets).join(weighted, "term")
    return met.groupBy("qn", "block").agg(
        (F.sum(_weight(index, "max_tf", "min_length"))).alias("lexical_bound"),
        (F.sum("in_title") * rt.TITLE_BOOST + F.sum("in_category") * rt.CATEGORY_BOOST).alias("boost_bound"),
    )


def _summed(index: TermIndex, hits: DataFrame) -> DataFrame:
    return hits.groupBy("qn", "chunk_no").agg(
        F.round(F.sum(_weight(index, "tf", "token_count")), 6).alias("lexical_score"),
        F.round(F.sum(F.col("in_title").cast("int")) * rt.TITLE_BOOST, 6).alias("title_boost"),
        F.round(F.sum(F.col("in_category").cast("int")) * rt.CATEGORY_BOOST, 6).alias("category_boost"),
        F.count("*").alias("n_terms"),
    )


def _sums(index: TermIndex, pairs: DataFrame, weighted: DataFrame, buckets: list[list[int]]) -> DataFrame:
    """Exact sums of the chunks of these (qn, block) pairs: (term, block) is the key, so a frequent term is no hot one."""
    wanted = stored_side(pairs.select("qn", "block").join(weighted, "qn"), "wanted")
    return _summed(index, index.postings(buckets).join(wanted, ["term", "block"]))


def _by_bound(bounded: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("bound"), "block"))
    return written(bounded.withColumn("_place", place), "bounds")


def _reaching(ranked: DataFrame, thresholds: DataFrame, seeds: int) -> DataFrame:
    """The pairs that are not scored yet and whose bound reaches their query's threshold; all of them where there is none."""
    rest = ranked.where(F.col("_place") > seeds).join(thresholds, "qn", "left")
    return rest.where(F.col("threshold").isNull() | (F.col("bound") + SLACK >= F.col("threshold"))).select("qn", "block")


def chunk_state(index: TermIndex, ref_ts: Column) -> DataFrame:
    """Per live chunk: number, id, filter attributes and the parts of the score that no query changes, written once."""
    rows = index.chunks().drop("postings")
    return written(rt.chunk_state(rows, ref_ts).select("chunk_no", "chunk_id", *ATTRIBUTES, "freshness_boost", "boilerplate_penalty"), "state")


def _block_state(state: DataFrame) -> DataFrame:
    """Per block: the values of each filter attribute, and the best score without a matching term, with listing words and without."""
    rest = F.col("freshness_boost") - F.col("boilerplate_penalty")
    return state.groupBy(block_of().alias("block")).agg(
        *[F.collect_set(a).alias(f"_{a}") for a in ATTRIBUTES],
        *[F.max(rest - rt.deadline_penalty(F.col("status"), F.lit(flag))).alias(name) for flag, name in ((True, "_listing"), (False, "_plain"))],
    )


def retrieve(
    index: TermIndex, queries: DataFrame, ref_ts: Column, use_nfkc: bool = True, synonym_groups: Sequence[Sequence[str]] = SYNONYM_GROUPS,
    fillers: Sequence[str] = FILLER_TERMS, listing_terms: Sequence[str] = LISTING_TERMS, max_top_k: int = rt.MAX_TOP_K, seeds: int = SEEDS, skip_from: int = SKIP_FROM,
) -> DataFrame:
    """O-78..O-80, O-89, O-108: the rows of ``retrieve.retrieve``, from the blocks that can hold them.

    ``top_k`` beyond ``max_top_k`` is cut to it; ``retrieve.clamped`` tells which queries that concerns.
    """
    queries = rt.with_defaults(queries, max_top_k)
    terms = written(rt.query_terms(queries, synonym_groups, fillers, use_nfkc), "query-terms")
    listing = terms.groupBy("query_id").agg(F.bool_or(F.col("term").isin(*listing_terms)).alias("listing"))
    asked = written(queries.drop("query").join(listing, "query_id").withColumn("qn", F.monotonically_increasing_id()), "asked")
    numbers = broadcast_if_small(asked.select("query_id", "qn", "top_k", "listing", *rt.FILTERS))
    weighted, buckets = _weighted(index, terms.join(numbers.select("query_id", "qn"), "query_id"))
    state = chunk_state(index, ref_ts)
    unmatched = rt.zero_match_candidates(state, asked, max_top_k).join(numbers.select("query_id", "qn"), "query_id")

    def scored(sums: DataFrame) -> DataFrame:
        # a row per chunk of the corpus: its file may look small enough to broadcast, so the kind of join is named
        met = sums.join(state.hint("shuffle_hash"), "chunk_no").join(numbers, "qn").where(rt.passes_filters())
        met = met.withColumn("deadline_penalty", rt.deadline_penalty(F.col("status"), F.col("listing"))).withColumn("score", rt.total_score())
        return met.where("score > 0").select("qn", "query_id", "chunk_id", "top_k", *rt.FEATURES, "score")

    if not _bounds_pay(index, asked, skip_from):
        found = sc.top_lists(index.postings(buckets), weighted, asked, state, index.n_chunks, _weight(index, "tf", "token_count"))
        every = scored(rt._best(found, "qn", max_top_k).select("qn", "chunk_no", "lexical_score", "title_boost", "category_boost"))
    else:
        unmatched = written(unmatched, "unmatched")
        blocks = stored_side(_block_state(state), "blocks")
        bounded = _bounded(index, weighted, buckets).join(blocks, "block").join(numbers, "qn")
        for values, attribute in rt.FILTERS.items():
            bounded = bounded.where(F.col(values).isNull() | F.arrays_overlap(F.col(values), F.col(f"_{attribute}")))
        rest = F.when(F.col("listing"), F.col("_listing")).otherwise(F.col("_plain"))
        ranked = _by_bound(bounded.select("qn", "block", (F.col("lexical_bound") + F.col("boost_bound") + rest).alias("bound")))
        first = written(scored(_sums(index, ranked.where(F.col("_place") <= seeds), weighted, buckets)), "first")
        known = first.unionByName(unmatched.select(*first.columns)).where("boilerplate_penalty < 2")
        known = known.groupBy("qn", "chunk_id").agg(F.max("score").alias("score"), F.first("top_k").alias("top_k"))
        place = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score")))
        thresholds = known.withColumn("_k", place).where(F.col("_k") == F.col("top_k")).select("qn", F.col("score").alias("threshold"))
        every = first.unionByName(scored(_sums(index, _reaching(ranked, thresholds, seeds), weighted, buckets)))
    best = rt._best(every, "qn", max_top_k)
    return rt.rank_candidates(best.drop("qn").unionByName(unmatched.drop("qn")))


def bm25(index: TermIndex, queries: DataFrame, top_k: int = rt.DEFAULT_TOP_K, use_nfkc: bool = True, seeds: int = SEEDS, skip_from: int = SKIP_FROM) -> DataFrame:
    """O-89, O-101: the rows of ``retrieve.bm25``, from the blocks that can hold them; ``top_k`` has no other bound."""
    numbered = queries.select("query_id", "query").withColumn("qn", F.monotonically_increasing_id())
    norm = computed_once(numbered, {"_n": T.normalize_search_text("query", use_nfkc)}, ["query_id", "qn"])
    terms = written(norm.select("query_id", "qn", F.explode(T.search_terms("_n")).alias("term")), "query-terms")
    weighted, buckets = _weighted(index, terms.select("qn", "term"))
    order = Window.partitionBy("qn").orderBy(F.desc("lexical_score"), "chunk_id")
    ids = broadcast_if_small(terms.select("qn", "query_id").distinct())
    result = ["query_id", "chunk_id", "lexical_score", "n_terms", "rank"]
    if not _bounds_pay(index, ids, skip_from):
        none = F.lit(None).cast("array<string>")
        asked = terms.select("qn").distinct().select("qn", F.lit(top_k).alias("top_k"), F.lit(False).alias("listing"), *[none.alias(v) for v in rt.FILTERS])
        plain = index.chunks().select("chunk_no", "chunk_id", *[F.lit("").alias(a) for a in ATTRIBUTES], *[F.lit(0.0).alias(v) for v in sc.STATE])
        found = sc.top_lists(index.postings(buckets), weighted, asked, plain, index.n_chunks, _weight(index, "tf", "token_count"), lexical=True)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).join(ids, "qn").select(result)
    scored = lambda sums: index.alive(sums.select("qn", "chunk_no", "lexical_score", "n_terms"))
    ranked = _by_bound(_bounded(index, weighted, buckets).select("qn", "block", F.col("lexical_bound").alias("bound")))
    first = written(scored(_sums(index, ranked.where(F.col("_place") <= seeds), weighted, buckets)), "first")
    place = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("lexical_score")))
    thresholds = first.withColumn("_k", place).where(F.col("_k") == top_k).select("qn", F.col("lexical_score").alias("threshold"))
    every = first.unionByName(scored(_sums(index, _reaching(ranked, thresholds, seeds), weighted, buckets)))
    # ids decide ties, so the cut waits for them; rows that tie with the last place stay until then
    near = every.withColumn("_r", F.rank().over(Window.partitionBy("qn").orderBy(F.desc("lexical_score")))).where(F.col("_r") <= top_k).drop("_r")
    named = index.chunks().select("chunk_no", "chunk_id").join(stored_side(near, "near"), "chunk_no")
    ranked_rows = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked_rows.join(ids, "qn").select(result)


def matched_terms(results: DataFrame, index: TermIndex, terms: DataFrame) -> DataFrame:
    """Add the sorted ``matched_terms`` of each result row, read from the buckets of the terms."""
    results = written(results, "results")
    numbered = index.chunks().select("chunk_no", "chunk_id").join(broadcast_if_small(results.select("chunk_id").distinct()), "chunk_id")
    pairs = results.select("query_id", "chunk_id").join(terms, "query_id").join(stored_side(numbered, "numbers"), "chunk_id")
    wanted = stored_side(pairs, "wanted")
    found = index.postings(index.buckets_of(terms)).select("term", "chunk_no").join(wanted, ["term", "chunk_no"])
    lists = found.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return results.join(lists, ["query_id", "chunk_id"], "left").withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))
