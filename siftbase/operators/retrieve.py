"""Ranked retrieval of chunks for a whole table of queries.

``queries``: query_id, query, top_k and four optional filter lists.  The plan:

1. query terms (small) get their idf from one pass over the posting terms;
2. postings meet the query terms.  When the terms are measured to be small they
   are broadcast and the surviving hits are hashed by chunk once, so the sum per
   (query, chunk) needs no further shuffle.  Otherwise hot terms are salted;
3. the best 25 per query are cut inside each task before the shuffle by query;
4. chunks without a matching term still score by freshness.  Their score does
   not depend on the query, so the best 25 per filter combination suffice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import dates as D, text as T
from siftbase.operators.index import boilerplate_penalty, corpus_stats
from siftbase.operators.vocabulary import FILLER_TERMS, LISTING_TERMS, SYNONYM_GROUPS, synonym_table
from siftbase.session import computed_once, is_small, salted_join, stored_side, written

K1, B = 1.2, 0.75
MAX_TOP_K = 25
DEFAULT_TOP_K = 5
TITLE_BOOST, CATEGORY_BOOST = 0.25, 0.15
FILTERS = {
    "collection_categories": "collection_category",
    "source_families": "source_family",
    "source_ids": "source_id",
    "deadline_statuses": "status",
}
FEATURES = ("lexical_score", "title_boost", "category_boost", "freshness_boost", "deadline_penalty", "boilerplate_penalty")


def expand_synonyms(terms: DataFrame, synonyms: DataFrame, key: str = "query_id") -> DataFrame:
    """O-26: the terms themselves and their synonyms, distinct."""
    pairs = F.broadcast(synonyms)  # one row per pair of a literal word list
    more = terms.join(pairs, "term").select(key, F.col("synonym").alias("term"))
    return terms.select(key, "term").unionByName(more).distinct()


def query_terms(queries: DataFrame, synonym_groups: Sequence[Sequence[str]] = SYNONYM_GROUPS,
                fillers: Sequence[str] = FILLER_TERMS, use_nfkc: bool = True) -> DataFrame:
    """O-27: (query_id, term): own terms and synonyms, re-split, fillers removed."""
    norm = computed_once(queries, {"_n": T.normalize_search_text("query", use_nfkc)}, ["query_id"])
    own = norm.select("query_id", F.explode(T.search_terms("_n")).alias("term"))
    expanded = expand_synonyms(own, synonym_table(queries.sparkSession, synonym_groups))
    again = computed_once(expanded, {"_n": T.normalize_search_text("term", False)}, ["query_id"]).filter("_n <> ''")
    parts = again.select("query_id", F.explode(F.array_union(T.search_terms("_n"), F.array("_n"))).alias("term"))
    return parts.filter(~F.col("term").isin(*fillers)).distinct()


def with_defaults(queries: DataFrame, max_top_k: int = MAX_TOP_K) -> DataFrame:
    """Fill in the optional columns and bound ``top_k`` to 0..``max_top_k``; ``clamped`` tells whose wish was larger."""
    have = set(queries.columns)
    k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K)) if "top_k" in have else F.lit(DEFAULT_TOP_K)
    out = queries.withColumn("top_k", F.greatest(F.lit(0), F.least(k.cast("int"), F.lit(max_top_k))))
    for name in FILTERS:
        current = F.col(name) if name in have else F.lit(None).cast("array<string>")
        out = out.withColumn(name, F.when(F.size(F.coalesce(current, F.array().cast("array<string>"))) > 0, current))
    return out.filter("top_k > 0")


def clamped(queries: DataFrame, max_top_k: int = MAX_TOP_K) -> DataFrame:
    """(query_id, top_k_requested, top_k) of the queries that ask for more rows than ``retrieve`` gives, or for fewer than none."""
    asked = queries.filter(~F.col("top_k").between(0, max_top_k))
    return asked.select("query_id", F.col("top_k").alias("top_k_requested"), F.greatest(F.lit(0), F.least(F.col("top_k"), F.lit(max_top_k))).cast("int").alias("top_k"))


def passes_filters() -> Column:
    """O-67: a missing or empty list lets everything pass."""
    ok = F.lit(True)
    for values, attribute in FILTERS.items():
        ok = ok & (F.col(values).isNull() | F.array_contains(F.col(values), F.col(attribute)))
    return ok


def chunk_state(index: DataFrame, ref_ts: Column) -> DataFrame:
    """Per-chunk values that do not depend on the query: effective status, freshness, penalties."""
    keep = [c for c in index.columns if c not in ("deadline_raw_text", "deadline_status")]
    status = D.effective_status("deadline_raw_text", "deadline_status", ref_ts)
    return computed_once(index, {"status": status}, keep).withColumn(
        "freshness_boost", F.round(D.freshness_boost(F.col("status"), F.col("posted_at"), F.col("fetched_at"), ref_ts), 6)
    ).withColumn("boilerplate_penalty", boilerplate_penalty(F.col("boilerplate_label")))


def deadline_penalty(status: Column, listing: Column) -> Column:
    return F.when(status == "expired", F.when(listing, 0.5).otherwise(0.15)).otherwise(0.0)


def total_score() -> Column:
    plus = F.col("lexical_score") + F.col("title_boost") + F.col("category_boost") + F.col("freshness_boost")
    return F.round(F.greatest(F.lit(0.0), plus - F.col("deadline_penalty") - F.col("boilerplate_penalty")), 6)


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_chunks - df + 0.5) / (df + 0.5))


def bm25_weight(idf_value: Column, tf: Column, token_count: Column, avg_length: Column) -> Column:
    norm = F.lit(1 - B) + F.lit(B) * (token_count / avg_length)
    return idf_value * (tf * (K1 + 1)) / (tf + F.lit(K1) * norm)


def _hits(index: DataFrame, terms: DataFrame, small: bool, keep: Sequence[str]) -> DataFrame:
    """Postings whose term some query uses (O-78), hashed by chunk."""
    posted = index.select(*keep, F.explode("postings").alias("p")).select(*keep, "p.*")
    if small:
        return posted.join(F.broadcast(terms), "term", "left_semi")
    return salted_join(posted, terms, "term", "chunk_id", "left_semi")


def retrieve(index: DataFrame, queries: DataFrame, ref_ts: Column, use_nfkc: bool = True,
             synonym_groups: Sequence[Sequence[str]] = SYNONYM_GROUPS, fillers: Sequence[str] = FILLER_TERMS,
             listing_terms: Sequence[str] = LISTING_TERMS, max_top_k: int = MAX_TOP_K) -> DataFrame:
    """O-108: (query_id, chunk_id, rank, score, normalized_score, features) of the best ``top_k`` chunks per query.

    ``index`` should be stored (``store_index``): it is read once for lengths,
    once for document frequencies and once for scoring.
    """
    queries = with_defaults(queries, max_top_k)
    terms = written(query_terms(queries, synonym_groups, fillers, use_nfkc), "query-terms")
    listing = terms.groupBy("query_id").agg(F.bool_or(F.col("term").isin(*listing_terms)).alias("listing"))
    # a number per query keeps the keys of the large aggregate and sort short
    asked = written(queries.drop("query").join(listing, "query_id").withColumn("qn", F.monotonically_increasing_id()), "asked")
    small = is_small(terms.join(asked, "query_id"))  # terms with their filter lists, as they would be broadcast
    distinct_terms = terms.select("term").distinct()

    stats = corpus_stats(index)
    n_chunks = stats.select("n_chunks").scalar()
    avg_length = stats.select("avg_length").scalar()
    df = _hits(index, distinct_terms, small, ["chunk_id"]).groupBy("term").agg(F.count("*").alias("df"))
    weighted = (
        terms.join(df, "term").withColumn("idf", idf(n_chunks, F.col("df")))
        .join(asked.select("query_id", "qn", "listing", *FILTERS), "query_id").drop("df", "query_id")
    )

    keep = ["chunk_id", "collection_category", "source_family", "source_id", "status", "freshness_boost", "boilerplate_penalty", "token_count"]
    state = chunk_state(index, ref_ts)
    hits = _hits(state, distinct_terms, small, keep)
    if small:
        # hashing the hits by chunk makes the sum below local, whatever the number of queries
        matched = hits.repartition("chunk_id").join(F.broadcast(weighted), "term")
    else:
        matched = salted_join(hits, weighted, "term", "chunk_id")
    scored = (
        matched.filter(passes_filters())
        .groupBy("qn", "chunk_id")
        .agg(
            F.round(F.sum(bm25_weight(F.col("idf"), F.col("tf"), F.col("token_count"), avg_length)), 6).alias("lexical_score"),
            F.round(F.sum(F.col("in_title").cast("int")) * TITLE_BOOST, 6).alias("title_boost"),
            F.round(F.sum(F.col("in_category").cast("int")) * CATEGORY_BOOST, 6).alias("category_boost"),
            # the same value on every row of a pair
            F.max("freshness_boost").alias("freshness_boost"),
            F.max("boilerplate_penalty").alias("boilerplate_penalty"),
            F.max(deadline_penalty(F.col("status"), F.col("listing"))).alias("deadline_penalty"),
        )
        .withColumn("score", total_score())
        .filter("score > 0")
    )
    best = _best(scored, "qn", max_top_k).join(asked.select("qn", "query_id", "top_k"), "qn").select("query_id", "chunk_id", "top_k", *FEATURES, "score")
    unmatched = zero_match_candidates(state, asked, max_top_k)
    return rank_candidates(best.unionByName(unmatched))


def _answerable() -> Column:
    return (F.col("boilerplate_penalty") < 2).cast("int")


def _best(scored: DataFrame, key: str, most: int = MAX_TOP_K) -> DataFrame:
    """The best rows per query, as many as any query may get, answerable ones first."""
    order = Window.partitionBy(key).orderBy(_answerable().desc(), F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def zero_match_candidates(state: DataFrame, asked: DataFrame, most: int = MAX_TOP_K) -> DataFrame:
    """O-80: best chunks per query by the part of the score that needs no matching term.

    First the best ``most`` per combination of filter attributes, cut inside each
    task; then per used filter pattern; then equi-joins with the queries' filter
    values.  A chunk beyond position ``most`` has as many others above it whatever they match.
    """
    attributes = list(FILTERS.values())
    flagged = state.select("chunk_id", *attributes, "freshness_boost", "boilerplate_penalty", F.explode(F.array(F.lit(True), F.lit(False))).alias("listing"))
    for name in ("lexical_score", "title_boost", "category_boost"):
        flagged = flagged.withColumn(name, F.lit(0.0))
    flagged = flagged.withColumn("deadline_penalty", deadline_penalty(F.col("status"), F.col("listing"))).withColumn("score", total_score()).filter("score > 0")

    def cut(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("chunk_id"))
        return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")

    wanted = asked.withColumn("mask", sum((F.when(F.col(v).isNotNull(), 1 << bit).otherwise(0) for bit, v in enumerate(FILTERS)), F.lit(0)))
    used = sorted(r.mask for r in wanted.select("mask").distinct().collect())  # at most 2 ** len(FILTERS) numbers
    groups = cut(flagged, [*attributes, "listing"])
    masked = groups.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in used]).cast("array<int>")))
    for bit, attribute in enumerate(attributes):
        masked = masked.withColumn(f"f_{attribute}", F.when(F.col("mask").bitwiseAND(1 << bit) != 0, F.col(attribute)).otherwise(""))
    keys = ["mask", "listing", *[f"f_{a}" for a in attributes]]
    per_pattern = cut(masked.drop(*attributes), keys)

    for values, attribute in FILTERS.items():
        wanted = wanted.withColumn(f"f_{attribute}", F.explode(F.coalesce(F.array_distinct(values), F.array(F.lit("")))))
    joined = wanted.select("query_id", "top_k", *keys).join(per_pattern, keys)
    return cut(joined, ["query_id"]).select("query_id", "chunk_id", "top_k", *FEATURES, "score")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """O-99..O-101: merge the two lists, prefer answerable rows, normalise, cut to ``top_k``."""
    merged = candidates.groupBy("query_id", "chunk_id", "top_k").agg(F.max(F.struct("score", *FEATURES)).alias("s")).select(
        "query_id", "chunk_id", "top_k", "s.*"
    )
    by_query = Window.partitionBy("query_id")
    merged = merged.withColumn("_any", F.max(_answerable()).over(by_query)).filter(F.col("_any") == _answerable())
    merged = merged.withColumn("normalized_score", F.round(F.col("score") / F.max("score").over(by_query), 6))
    order = by_query.orderBy(F.col("normalized_score").desc(), F.col("score").desc(), F.col("chunk_id"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("top_k"))
    return ranked.select("query_id", "chunk_id", "rank", "score", "normalized_score", *FEATURES)


def bm25(index: DataFrame, queries: DataFrame, top_k: int = DEFAULT_TOP_K, use_nfkc: bool = True) -> DataFrame:
    """O-89, O-101: lexical score only, best ``top_k`` per query."""
    numbered = queries.select("query_id", "query").withColumn("qn", F.monotonically_increasing_id())
    norm = computed_once(numbered, {"_n": T.normalize_search_text("query", use_nfkc)}, ["query_id", "qn"])
    terms = written(norm.select("query_id", "qn", F.explode(T.search_terms("_n")).alias("term")), "query-terms")
    distinct_terms = terms.select("term").distinct()
    small = is_small(terms)
    stats = corpus_stats(index)
    n_chunks, avg_length = stats.select("n_chunks").scalar(), stats.select("avg_length").scalar()
    df = _hits(index, distinct_terms, small, ["chunk_id"]).groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.select("qn", "term").join(df, "term").withColumn("idf", idf(n_chunks, F.col("df"))).drop("df")
    hits = _hits(index, distinct_terms, small, ["chunk_id", "token_count"])
    matched = hits.repartition("chunk_id").join(F.broadcast(weighted), "term") if small else salted_join(hits, weighted, "term", "chunk_id")
    scored = matched.groupBy("qn", "chunk_id").agg(
        F.round(F.sum(bm25_weight(F.col("idf"), F.col("tf"), F.col("token_count"), avg_length)), 6).alias("lexical_score"),
        F.count("*").alias("n_terms"),
    )
    order = Window.partitionBy("qn").orderBy(F.col("lexical_score").desc(), F.col("chunk_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(top_k, MAX_TOP_K))
    return ranked.join(terms.select("qn", "query_id").distinct(), "qn").drop("qn")


def matched_terms(results: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """Add the sorted ``matched_terms`` of each result row; results are bounded by 25 per query."""
    own = terms.groupBy("query_id").agg(F.collect_set("term").alias("_terms"))
    chunk_terms = index.select("chunk_id", F.col("postings.term").alias("_posted"))
    joined = chunk_terms.join(stored_side(results.join(own, "query_id", "left"), "results"), "chunk_id")
    return joined.withColumn("matched_terms", F.array_sort(F.array_intersect(F.coalesce("_terms", F.array().cast("array<string>")), "_posted"))).drop("_terms", "_posted")


def attach_chunks(results: DataFrame, chunks: DataFrame, ref_ts: Column) -> DataFrame:
    """Join the chunk payload to result rows and put the effective status in ``deadline_status``."""
    payload = chunks.withColumn("deadline_status", D.effective_status("deadline_raw_text", "deadline_status", ref_ts))
    return payload.join(stored_side(results, "results"), "chunk_id")
