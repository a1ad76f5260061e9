"""Registered queries: terms, index statistics and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftbase.functions import text as T
from siftbase.operators import blocks as bk
from siftbase.operators import index as ix
from siftbase.operators import retrieve as rt
from siftbase.operators import roles
from siftbase.operators.vocabulary import ANSWER_SIGNALS, FILLER_TERMS, LISTING_TERMS, NOISE_SIGNALS, synonym_pairs, synonym_table
from siftbase.plans import corpus as C
from siftbase.plans.registry import query, table
from siftbase.session import computed_once
from siftbase.sources.versions import fingerprint

BM25_SQL = f"""
WITH {C.CHUNKS_SQL}, {C.INDEX_SQL}, {C.QUERIES_SQL},
qterms AS (SELECT query_id, top_k, unnest({C.sql_terms(C.sql_norm('query'))}) AS term FROM asked),
scored AS (
  SELECT q.query_id, p.chunk_id, any_value(q.top_k) AS top_k, count(*) AS n_terms,
         round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * (l.token_count / s.avgdl)))), 6) AS lexical_score
  FROM qterms q JOIN postings p USING (term) JOIN dfs d USING (term) JOIN lengths l USING (chunk_id), stats s
  GROUP BY q.query_id, p.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS rank FROM scored)
"""


_STORED: dict[tuple[str, str, str], bk.TermIndex] = {}


def stored_terms(spark, sf_dir):
    """One term-clustered index per corpus and application, shared by all retrieval queries; a corpus written anew gets a new one."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _STORED:
        _STORED[key] = bk.TermIndex.build(ix.build_index(C.chunks(spark, sf_dir)))
    return _STORED[key]


@query("bm25_topk", BM25_SQL + "SELECT query_id, chunk_id, rank, lexical_score, n_terms FROM ranked WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return bk.bm25(stored_terms(spark, sf_dir), C.benchmark_queries(spark, sf_dir)).select("query_id", "chunk_id", "rank", "lexical_score", "n_terms")


@query("hit_at_k", BM25_SQL + r"""
, expected AS (SELECT q.query_id, c.chunk_id FROM asked q JOIN chunks c ON contains(c.text, q.query)),
per_query AS (SELECT e.query_id, count(*) AS n_expected, count(r.chunk_id) AS n_found
              FROM expected e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (query_id, chunk_id) GROUP BY e.query_id)
SELECT query_id, n_expected, n_found, n_found > 0 AS hit FROM per_query""")
def hit_at_k(spark, sf_dir):
    from siftbase.operators.evaluate import expected_passages, hit_rate

    chunks, asked = C.chunks(spark, sf_dir), C.benchmark_queries(spark, sf_dir)
    found = bk.bm25(stored_terms(spark, sf_dir), asked)
    return hit_rate(expected_passages(chunks, asked), found)


@query("term_stats", f"WITH {C.CHUNKS_SQL}, {C.INDEX_SQL} SELECT term, df FROM dfs")
def term_stats(spark, sf_dir):
    return ix.term_stats(ix.build_index(C.chunks(spark, sf_dir)))


@query("corpus_stats", f"WITH {C.CHUNKS_SQL}, {C.INDEX_SQL} SELECT n AS n_chunks, round(avgdl, 6) AS avg_length FROM stats")
def corpus_stats(spark, sf_dir):
    return ix.corpus_stats(ix.build_index(C.chunks(spark, sf_dir))).withColumn("avg_length", F.round("avg_length", 6))


_SYN = ", ".join(f"({C.sql_text(a)}, {C.sql_text(b)})" for a, b in synonym_pairs())


def full_retrieval_sql(asked: str) -> str:
    """Every query against every chunk, as the definition says; no shortcut for zero-match rows."""
    return f"""
WITH {C.CHUNKS_SQL}, {C.INDEX_SQL}, {asked},
syn(term, synonym) AS (VALUES {_SYN}),
own AS (SELECT query_id, unnest({C.sql_terms(C.sql_norm('query'))}) AS term FROM asked),
expanded AS (SELECT query_id, term FROM own UNION SELECT query_id, synonym FROM own JOIN syn USING (term)),
qterms AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(list_append({C.sql_terms(C.sql_norm('term'))}, {C.sql_norm('term')})) AS t FROM expanded)
           WHERE t <> '' AND t NOT IN ({', '.join(C.sql_text(t) for t in FILLER_TERMS)})),
listing AS (SELECT query_id, bool_or(term IN ({', '.join(C.sql_text(t) for t in LISTING_TERMS)})) AS listing FROM qterms GROUP BY query_id),
labels_of AS (
  SELECT chunk_id, CASE WHEN noise AND answer THEN 0.2 WHEN noise THEN 2.0 ELSE 0.0 END AS boilerplate_penalty FROM (
    SELECT chunk_id, regexp_matches(n_title || ' ' || n_category || ' ' || n_text, '{'|'.join(ix._plain(w) for w in NOISE_SIGNALS)}') AS noise,
           regexp_matches(n_title || ' ' || n_category || ' ' || n_text, '{'|'.join(ix._plain(w) for w in ANSWER_SIGNALS)}') AS answer FROM norms)),
sums AS (
  SELECT q.query_id, p.chunk_id,
         round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * (l.token_count / s.avgdl)))), 6) AS lexical_score,
         round(sum(p.in_title) * 0.25, 6) AS title_boost, round(sum(p.in_category) * 0.15, 6) AS category_boost
  FROM qterms q JOIN postings p USING (term) JOIN dfs d USING (term) JOIN lengths l USING (chunk_id), stats s GROUP BY q.query_id, p.chunk_id),
pairs AS (
  SELECT a.query_id, a.top_k, c.chunk_id, coalesce(m.lexical_score, 0) AS lexical_score, coalesce(m.title_boost, 0) AS title_boost, coalesce(m.category_boost, 0) AS category_boost,
         CASE WHEN c.status = 'active' THEN 0.35 WHEN date_diff('day', coalesce(c.posted_at, c.fetched_at), {C.REF_SQL}) <= 30 THEN 0.2
              WHEN date_diff('day', coalesce(c.posted_at, c.fetched_at), {C.REF_SQL}) <= 180 THEN 0.1 ELSE 0.0 END AS freshness_boost,
         CASE WHEN c.status = 'expired' THEN CASE WHEN g.listing THEN 0.5 ELSE 0.15 END ELSE 0.0 END AS deadline_penalty, b.boilerplate_penalty
  FROM asked a JOIN listing g USING (query_id) CROSS JOIN chunks c JOIN labels_of b USING (chunk_id) LEFT JOIN sums m ON m.query_id = a.query_id AND m.chunk_id = c.chunk_id
  WHERE (coalesce(len(a.collection_categories), 0) = 0 OR list_contains(a.collection_categories, c.collection_category))
    AND (coalesce(len(a.source_families), 0) = 0 OR list_contains(a.source_families, c.source_family))
    AND (coalesce(len(a.source_ids), 0) = 0 OR list_contains(a.source_ids, c.source_id))
    AND (coalesce(len(a.deadline_statuses), 0) = 0 OR list_contains(a.deadline_statuses, c.status))),
totals AS (SELECT *, round(greatest(0, lexical_score + title_boost + category_boost + freshness_boost - deadline_penalty - boilerplate_penalty), 6) AS score FROM pairs),
positive AS (SELECT *, max(CAST(boilerplate_penalty < 2 AS INTEGER)) OVER (PARTITION BY query_id) AS any_answerable FROM totals WHERE score > 0),
candidates AS (SELECT * FROM positive WHERE any_answerable = 0 OR boilerplate_penalty < 2),
normalised AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalized_score FROM candidates),
results AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY normalized_score DESC, score DESC, chunk_id) AS rank FROM normalised QUALIFY rank <= top_k)
"""


NO_FILTERS_SQL = C.QUERIES_SQL.replace("5 AS top_k", "5 AS top_k, CAST([] AS VARCHAR[]) AS collection_categories, CAST([] AS VARCHAR[]) AS source_families, CAST([] AS VARCHAR[]) AS source_ids, CAST([] AS VARCHAR[]) AS deadline_statuses")
RESULT_COLUMNS = ["query_id", "chunk_id", "rank", "score", "normalized_score", *rt.FEATURES]


@query("retrieve_full", full_retrieval_sql(NO_FILTERS_SQL) + f"SELECT {', '.join(RESULT_COLUMNS)} FROM results")
def retrieve_full(spark, sf_dir):
    return bk.retrieve(stored_terms(spark, sf_dir), C.benchmark_queries(spark, sf_dir), C.ref_ts()).select(*RESULT_COLUMNS)


@query("retrieve_filtered", full_retrieval_sql(C.FILTERED_SQL) + f"SELECT {', '.join(RESULT_COLUMNS)} FROM results")
def retrieve_filtered(spark, sf_dir):
    return bk.retrieve(stored_terms(spark, sf_dir), C.filtered_queries(spark, sf_dir), C.ref_ts()).select(*RESULT_COLUMNS)


@query("retrieve_zero_match", full_retrieval_sql(C.FILTERED_SQL) + "SELECT query_id, chunk_id, rank, score, freshness_boost, deadline_penalty FROM results WHERE lexical_score = 0")
def retrieve_zero_match(spark, sf_dir):
    found = bk.retrieve(stored_terms(spark, sf_dir), C.filtered_queries(spark, sf_dir), C.ref_ts())
    return found.filter("lexical_score = 0").select("query_id", "chunk_id", "rank", "score", "freshness_boost", "deadline_penalty")


@query("matched_terms", full_retrieval_sql(C.FILTERED_SQL) + """
SELECT r.query_id, r.chunk_id, r.rank, coalesce(string_agg(p.term, ' ' ORDER BY p.term), '') AS matched_terms
FROM results r LEFT JOIN (SELECT q.query_id, p.chunk_id, p.term FROM qterms q JOIN postings p USING (term)) p ON p.query_id = r.query_id AND p.chunk_id = r.chunk_id
GROUP BY r.query_id, r.chunk_id, r.rank""")
def matched_terms(spark, sf_dir):
    index, asked = stored_terms(spark, sf_dir), C.filtered_queries(spark, sf_dir)
    found = bk.matched_terms(bk.retrieve(index, asked, C.ref_ts()), index, rt.query_terms(asked))
    return found.select("query_id", "chunk_id", "rank", F.array_join("matched_terms", " ").alias("matched_terms"))


def _words(spark, sf_dir):
    """Conversation turns with a Korean request appended."""
    return C.requests(spark, sf_dir)


@query("hangul_terms", f"WITH {C.REQUESTS_SQL} SELECT request_id, array_to_string(list_sort({C.sql_terms(C.sql_norm('query'))}), ' ') AS terms FROM requests")
def hangul_terms(spark, sf_dir):
    terms = T.search_terms(T.normalize_search_text("query"))
    return C.requests(spark, sf_dir).select("request_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query("synonym_terms", f"""WITH {C.REQUESTS_SQL}, syn(term, synonym) AS (VALUES {_SYN}),
own AS (SELECT request_id, unnest({C.sql_terms(C.sql_norm('query'))}) AS term FROM requests)
SELECT request_id, term FROM own UNION SELECT request_id, synonym FROM own JOIN syn USING (term)""")
def synonym_terms(spark, sf_dir):
    own = C.requests(spark, sf_dir).select("request_id", F.explode(T.search_terms(T.normalize_search_text("query"))).alias("term"))
    return rt.expand_synonyms(own, synonym_table(spark), key="request_id")


_KO_WORDS = ("공유 인쇄", "상담예약 안내", "목차 포트폴리오", "HOME", "일반 글", "현장실습 다운로드")
_BP = f"text || ' ' || {C.sql_pick(_KO_WORDS, f'doc_id % {len(_KO_WORDS)}')}"


@query("boilerplate_class", f"""WITH n AS (SELECT doc_id, {C.sql_norm('(' + _BP + ')')} AS n FROM documents),
h AS (SELECT doc_id, len(list_filter({C.sql_list([ix._plain(w) for w in NOISE_SIGNALS])}, lambda w: contains(n, w))) AS noise,
      len(list_filter({C.sql_list([ix._plain(w) for w in ANSWER_SIGNALS])}, lambda w: contains(n, w))) AS answer FROM n)
SELECT doc_id, noise AS boilerplate_score, answer * 2 AS answer_signal_score,
       CASE WHEN noise > 0 AND answer > 0 THEN 'mixed' WHEN answer > 0 THEN 'answerable' WHEN noise > 0 THEN 'boilerplate_only' ELSE 'answerable' END AS label FROM h""")
def boilerplate_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit(" "), C.pick(_KO_WORDS, F.col("doc_id") % len(_KO_WORDS)))
    norm = computed_once(d, {"norm": T.normalize_search_text(text)}, ["doc_id"])
    return norm.select("doc_id", ix.boilerplate_label(F.col("norm")).alias("b")).select("doc_id", "b.boilerplate_score", "b.answer_signal_score", "b.label")


def _role_requests(spark, sf_dir):
    r = C.requests(spark, sf_dir)
    return r.select(F.col("request_id").alias("query_id"), "query", F.lit(5).alias("top_k"))


_INTENT_SQL = f"""
flags AS (SELECT *, regexp_matches(lower(query), '{roles.CAREER}') AS general, regexp_matches(lower(query), '{roles.INTERNSHIP}') AS internship FROM requests),
intents AS (SELECT *, general OR regexp_matches(lower(query), '{roles.OPPORTUNITY_CUES}') AS opportunity, regexp_matches(lower(query), '{roles.ADVICE_CUES}') AS advice,
   regexp_matches(lower(query), '{roles.PROCEDURE_CUES}') AS procedure, general AND regexp_matches(lower(query), '{roles.MIXED_CUES}') AS mixed FROM flags)"""


@query("query_intent", f"WITH {C.REQUESTS_SQL}, {_INTENT_SQL} SELECT request_id, opportunity, advice, procedure, internship, general AS career_general, mixed AS mixed_career_advice FROM intents")
def query_intent(spark, sf_dir):
    return C.requests(spark, sf_dir).select("request_id", roles.intent("query").alias("i")).select("request_id", "i.*")


_ROLE_ASKED = f"""{C.REQUESTS_SQL}, {_INTENT_SQL},
plan_lists AS (SELECT request_id, query, CASE WHEN mixed THEN list_filter([
     CASE WHEN opportunity THEN CASE WHEN internship THEN {C.sql_list(roles.INTERNSHIP_OPPORTUNITY)} ELSE {C.sql_list(roles.OPPORTUNITY)} END END,
     CASE WHEN advice THEN {C.sql_list(roles.ADVICE)} END, CASE WHEN procedure THEN {C.sql_list(roles.PROCEDURE)} END], lambda x: x IS NOT NULL) ELSE [] END AS plans FROM intents),
plan_rows AS (
  SELECT request_id, query, plans[i] AS collection_categories, i AS plan, CAST(greatest(2, ceil(5.0 / greatest(len(plans), 1)) + 1) AS INTEGER) AS top_k
  FROM (SELECT *, unnest(range(1, len(plans) + 1)) AS i FROM plan_lists)
  UNION ALL SELECT request_id, query, CAST([] AS VARCHAR[]), 99, 5 FROM plan_lists),
asked AS (SELECT request_id || '#' || CAST(plan AS VARCHAR) AS query_id, *, CAST([] AS VARCHAR[]) AS source_families, CAST([] AS VARCHAR[]) AS source_ids,
          CAST([] AS VARCHAR[]) AS deadline_statuses FROM plan_rows)"""


@query("role_merge", full_retrieval_sql(_ROLE_ASKED) + """
, listed AS (SELECT a.request_id, r.chunk_id, r.score, r.normalized_score, a.plan * 100 + r.rank AS pos FROM results r JOIN asked a USING (query_id)),
merged AS (SELECT request_id, chunk_id, min(pos) AS pos, arg_max(score, [score, -pos]) AS score, arg_max(normalized_score, [score, -pos]) AS normalized_score FROM listed GROUP BY ALL)
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS rank, score, normalized_score FROM merged QUALIFY rank <= 5""")
def role_merge(spark, sf_dir):
    found = roles.retrieve_by_role(stored_terms(spark, sf_dir), _role_requests(spark, sf_dir), C.ref_ts(), search=bk.retrieve)
    return found.select(F.col("query_id").alias("request_id"), "chunk_id", "rank", "score", "normalized_score")
