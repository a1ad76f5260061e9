"""Registered queries: recommendations, evaluation, keyed state, streams, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftbase.functions import dates as D
from siftbase.operators import blocks as bk, evaluate as E, ingest as I, recommend as R, safety as S, sessions as SS
from siftbase.operators import retrieve as rt
from siftbase.plans import corpus as C
from siftbase.plans.guard import INPUT_SQL
from siftbase.plans.registry import query, table
from siftbase.plans.retrieval import full_retrieval_sql, stored_terms
from siftbase.sources import jsonl
from siftbase.session import shared_dir, written
from siftbase.streaming import runs


# --- recommendations ------------------------------------------------------------
MAJORS = ("thre", "erand tion", "ouon", "nicht", "the of")
ROLES = ("anti er", "zzq", "de la", "retion", "and")


def profiles(spark, sf_dir):
    """One profile per user of the event table; every seventh has none."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id")
    return u.select(
        F.concat(F.lit("p"), F.lpad(k.cast("string"), 9, "0")).alias("query_id"), F.when(k % 7 != 0, C.pick(MAJORS, k % 5)).alias("major"), F.when(k % 7 != 0, C.pick(ROLES, (k + 2) % 5)).alias("target_role"),
        F.when(k % 3 == 0, F.array(F.lit("ing"), F.lit("zzq"))).otherwise(F.array().cast("array<string>")).alias("industry"), F.array().cast("array<string>").alias("region"),
        F.when(k % 4 == 0, F.array(F.lit("인턴"))).otherwise(F.array().cast("array<string>")).alias("employment_type"),
        F.when(k % 7 != 0, C.pick(("balanced", "urgent_first", "include_unknown"), k % 3)).alias("deadline_sensitivity"), F.lit(3).alias("limit"),
    )


_PROFILES = f"""profiles AS (SELECT 'p' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS query_id, CASE WHEN user_id % 7 <> 0 THEN {C.sql_pick(MAJORS, 'user_id % 5')} END AS major, CASE WHEN user_id % 7 <> 0 THEN {C.sql_pick(ROLES, '(user_id + 2) % 5')} END AS target_role,
  CASE WHEN user_id % 3 = 0 THEN ['ing', 'zzq'] ELSE CAST([] AS VARCHAR[]) END AS industry, CASE WHEN user_id % 4 = 0 THEN ['인턴'] ELSE CAST([] AS VARCHAR[]) END AS employment_type,
  CASE WHEN user_id % 7 <> 0 THEN {C.sql_pick(('balanced', 'urgent_first', 'include_unknown'), 'user_id % 3')} END AS sensitivity FROM (SELECT DISTINCT user_id FROM events))"""
_REC_ASKED = f"""{_PROFILES},
asked AS (SELECT query_id, CASE WHEN major IS NULL THEN '{R.DEFAULT_QUERY}' ELSE array_to_string(list_concat(list_concat([major, target_role], list_concat(industry, employment_type)),
   [CASE sensitivity WHEN 'urgent_first' THEN '마감 임박 진행 중' WHEN 'include_unknown' THEN '마감 미정 포함' ELSE '채용 모집 공고' END]), ' ') END AS query, 9 AS top_k,
   CASE WHEN len(employment_type) > 0 THEN ['job_posting', 'career_program', 'internship_notice'] ELSE ['job_posting', 'career_program'] END AS collection_categories,
   CAST([] AS VARCHAR[]) AS source_families, CAST([] AS VARCHAR[]) AS source_ids, CAST([] AS VARCHAR[]) AS deadline_statuses FROM profiles)"""


def _pref(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[\s\x{{00A0}}\x{{3000}}\p{{P}}\p{{S}}]+', ' ', 'g'))"


def _r4(x: str) -> str:
    return f"(floor(greatest(0.0, least(1.0, CAST({x} AS DOUBLE))) * 10000 + 0.5) / 10000)"


def _match(p: str) -> str:
    words = f"list_filter(string_split({p}, ' '), lambda w: w <> '')"
    return f"CASE WHEN coalesce({p}, '') = '' THEN 0.0 WHEN contains(evidence, {p}) THEN 1.0 ELSE {_r4(f'len(list_filter({words}, lambda w: contains(evidence, w))) / CAST(len({words}) AS DOUBLE)')} END"


_AGE = "date_diff('day', {}, " + C.REF_SQL + ")"
REC_SQL = full_retrieval_sql(_REC_ASKED) + rf"""
, pool AS (SELECT r.query_id, r.chunk_id, r.rank, r.normalized_score, r.boilerplate_penalty, coalesce(t.terms, '') AS matched FROM results r LEFT JOIN
   (SELECT q.query_id, p.chunk_id, string_agg(p.term, ' ' ORDER BY p.term) AS terms FROM qterms q JOIN postings p USING (term) GROUP BY ALL) t ON t.query_id = r.query_id AND t.chunk_id = r.chunk_id),
joined AS (SELECT p.*, c.title, c.category, c.status, c.source_url, c.canonical_url, c.posted_at, c.fetched_at, f.major, f.target_role, f.industry, f.employment_type, f.sensitivity,
   {_pref("concat_ws(' ', c.title, c.category, c.deadline_raw_text, c.text, p.matched)")} AS evidence FROM pool p JOIN chunks c USING (chunk_id) JOIN profiles f USING (query_id)),
parts AS (SELECT *, CASE status WHEN 'active' THEN 1.0 WHEN 'unknown' THEN 0.45 ELSE 0.0 END AS dl,
   CASE WHEN posted_at IS NULL THEN 0.35 ELSE greatest(0.0, least(1.0, 1.0 - {_AGE.format('posted_at')} / CAST(120 AS DOUBLE))) END AS pr, greatest(0.0, least(1.0, 1.0 - {_AGE.format('fetched_at')} / CAST(180 AS DOUBLE))) AS fr FROM joined),
scored AS (SELECT *, {_r4('CAST(dl AS DOUBLE) * 0.25 + pr * 0.15 + fr * 0.1 + 1.0 * 0.2 + 0.2 * 0.15 + greatest(0.0, least(1.0, 1.0 - boilerplate_penalty)) * 0.15')} AS source_quality_score, {_r4('CAST(dl AS DOUBLE) * 0.5 + pr * 0.3 + fr * 0.2')} AS freshness_score,
   {_r4('normalized_score')} AS base, CASE WHEN major IS NULL THEN 0.0 ELSE {_match(_pref('major'))} END AS major_match_score, CASE WHEN major IS NULL THEN 0.0 ELSE {_match(_pref('target_role'))} END AS role_score,
   CASE WHEN major IS NULL THEN 0.0 ELSE {_r4(f"coalesce(list_sum(list_transform(list_concat(industry, employment_type), lambda p: {_match(_pref('p'))})) / CAST(len(list_concat(industry, employment_type)) AS DOUBLE), 0.0) * 0.65 + (CASE sensitivity WHEN 'include_unknown' THEN CASE WHEN status = 'expired' THEN 0.0 ELSE 1.0 END WHEN 'urgent_first' THEN CASE WHEN status = 'active' THEN 1.0 ELSE 0.0 END ELSE CASE WHEN status = 'expired' THEN 0.25 ELSE 0.75 END END) * 0.35")} END AS optional_score FROM parts),
final AS (SELECT *, {_r4('round(base * 0.30 + major_match_score * 0.20 + role_score * 0.20 + optional_score * 0.10 + source_quality_score * 0.15 + freshness_score * 0.05, 10)')} AS final_score,
   CASE WHEN major IS NULL THEN 'general_recommendation' WHEN greatest(major_match_score, role_score) >= 0.75 AND source_quality_score >= 0.45 THEN 'personalized_match' ELSE 'partial_match' END AS match_strength FROM scored),
recommended AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS position FROM final QUALIFY position <= 3)
"""


def _recommended(spark, sf_dir):
    chunks = C.chunks(spark, sf_dir)
    anchor = F.struct(F.col("canonical_url").alias("url"), F.col("title").alias("label"), F.lit(None).cast("int").alias("page_number"))
    return R.recommend(stored_terms(spark, sf_dir), chunks.withColumn("citation_anchors", F.array(anchor)), profiles(spark, sf_dir), C.ref_ts(), search=bk.retrieve, explain=bk.matched_terms)


@query("recommend", REC_SQL + "SELECT query_id, position, chunk_id, final_score, match_strength, major_match_score, role_score, optional_score, source_quality_score, freshness_score FROM recommended")
def recommend(spark, sf_dir):
    return _recommended(spark, sf_dir).select(
        "query_id", "position", "chunk_id", "final_score", "match_strength", "major_match_score", F.col("target_role_match_score").alias("role_score"),
        F.col("optional_preference_score").alias("optional_score"), "source_quality_score", "freshness_score",
    )


_MARK = "'[' || CAST(position AS VARCHAR) || ']'"


@query("match_reasons", REC_SQL + f"""SELECT query_id, position, array_to_string((CASE WHEN match_strength = 'personalized_match' THEN list_filter([
  CASE WHEN major_match_score > 0 THEN '{R.REASON['major']}' || {_MARK} END, CASE WHEN role_score > 0 THEN '{R.REASON['role']}' || {_MARK} END,
  CASE WHEN major_match_score <= 0 AND role_score <= 0 AND optional_score > 0 THEN '{R.REASON['optional']}' || {_MARK} END, '{R.REASON['source_head']}' || category || '{R.REASON['source_tail']}' || {_MARK},
  CASE WHEN NOT (major_match_score > 0 AND role_score > 0) THEN CASE status WHEN 'active' THEN '{R.REASON['active']}' WHEN 'expired' THEN '{R.REASON['expired']}' ELSE '{R.REASON['unknown']}' END || {_MARK} END], lambda x: x IS NOT NULL)
  ELSE [CASE WHEN match_strength = 'partial_match' THEN '{R.REASON['partial']}' ELSE '{R.REASON['general']}' END || {_MARK}, CASE status WHEN 'active' THEN '{R.REASON['active']}' WHEN 'expired' THEN '{R.REASON['expired']}' ELSE '{R.REASON['unknown']}' END || {_MARK}] END)[1:3], '|') AS reasons,
  0 AS n_failures FROM recommended""")
def match_reasons(spark, sf_dir):
    r = _recommended(spark, sf_dir)
    failures = R.reason_failures(F.col("match_reasons"), F.array(F.col("position").cast("bigint")))
    return r.select("query_id", "position", F.array_join("match_reasons", "|").alias("reasons"), F.size(failures).cast("bigint").alias("n_failures"))


@query("list_views", REC_SQL + """SELECT query_id, chunk_id, view, view_position FROM (
 SELECT query_id, chunk_id, 'newest' AS view, row_number() OVER (PARTITION BY query_id ORDER BY posted_at DESC NULLS LAST, fetched_at DESC NULLS LAST, position) AS view_position FROM recommended
 UNION ALL SELECT query_id, chunk_id, 'closing', row_number() OVER (PARTITION BY query_id ORDER BY posted_at DESC NULLS LAST, fetched_at DESC NULLS LAST, position) FROM recommended WHERE status = 'active'
 UNION ALL SELECT query_id, chunk_id, 'recommended', row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) FROM recommended WHERE match_strength <> 'general_recommendation'
 UNION ALL SELECT query_id, chunk_id, 'by_status', row_number() OVER (PARTITION BY query_id ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, position) FROM recommended)""")
def list_views(spark, sf_dir):
    from siftbase.session import written

    items = written(_recommended(spark, sf_dir).select("query_id", "chunk_id", "position", "posted_at", "fetched_at", "deadline_status", "source_id", "match_strength", F.col("final_score").alias("score")), "items")
    out = None
    for view in ("newest", "closing", "recommended", "by_status"):
        v = SS.list_view(items, view, ["query_id"]).select("query_id", "chunk_id", F.lit(view).alias("view"), "view_position")
        out = v if out is None else out.unionByName(v)
    return out


@query("source_quality", f"""WITH {C.CHUNKS_SQL}, p AS (SELECT chunk_id, source_url, canonical_url, CASE status WHEN 'active' THEN 1.0 WHEN 'unknown' THEN 0.45 ELSE 0.0 END AS dl,
 CASE WHEN posted_at IS NULL THEN 0.35 ELSE greatest(0.0, least(1.0, 1.0 - {_AGE.format('posted_at')} / CAST(120 AS DOUBLE))) END AS pr, greatest(0.0, least(1.0, 1.0 - {_AGE.format('fetched_at')} / CAST(180 AS DOUBLE))) AS fr FROM chunks)
SELECT chunk_id, {_r4('CAST(dl AS DOUBLE) * 0.25 + pr * 0.15 + fr * 0.1 + 1.0 * 0.2 + 0.2 * 0.15 + 1.0 * 0.15')} AS source_quality_score, {_r4('CAST(dl AS DOUBLE) * 0.5 + pr * 0.3 + fr * 0.2')} AS freshness_score FROM p""")
def source_quality(spark, sf_dir):
    c = C.chunks(spark, sf_dir).withColumn("deadline_status", D.effective_status("deadline_raw_text", "deadline_status", C.ref_ts())).withColumn("boilerplate_penalty", F.lit(0.0))
    anchor = F.struct(F.col("canonical_url").alias("url"), F.col("title").alias("label"), F.lit(None).cast("int").alias("page_number"))
    return R.source_quality(c.withColumn("citation_anchors", F.array(anchor)), C.ref_ts()).select("chunk_id", "source_quality_score", "freshness_score")


@query("preference_minimising", """SELECT 's' || CAST(event_id AS VARCHAR) AS session_key, trim(' ' || event_type || ' ') AS major, array_to_string(items, '|') AS industry,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN len(items) > 5 THEN 1 ELSE 0 END AS n_failures
FROM (SELECT *, list_filter(list_transform(string_split(replace(CASE WHEN event_id % 5 = 0 THEN props || ',a,b,c,d' ELSE props END, ':', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM events)""")
def preference_minimising(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(",a,b,c,d"))).otherwise(F.col("props")))  # some have six items
    raw = e.select(F.concat(F.lit("s"), F.col("event_id")).alias("session_key"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("major"), F.when(F.col("event_id") % 7 != 0, "role").alias("target_role"),
                   F.replace("props", F.lit(":"), F.lit(",")).alias("industry"), F.lit("").alias("region"), F.lit("").alias("employment_type"),
                   F.when(F.col("event_id") % 3 == 0, "sometimes").alias("deadline_sensitivity"), F.lit("free text").alias("session_only_optional_text"))
    out = R.minimised_profile(raw)
    return out.select("session_key", "major", F.array_join("industry", "|").alias("industry"), F.size("failures").cast("bigint").alias("n_failures"))


# --- evaluation -------------------------------------------------------------------
@query("safety_rollup", """WITH c AS (SELECT 'doc' AS layer, source AS risk_type, (d.n_chars > 500) = (l.quality = 1) AS passed FROM documents d JOIN labels l USING (doc_id))
SELECT layer, risk_type, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS ok, CAST(grouping(layer, risk_type) AS BIGINT) AS level FROM c GROUP BY ROLLUP (layer, risk_type)""")
def safety_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.rollup(j.select(F.lit("doc").alias("layer"), F.col("source").alias("risk_type"), ((F.col("n_chars") > 500) == (F.col("quality") == 1)).alias("passed")))


EXPECTED = ("refuse", "allow", "redact")


@query("safety_evaluation", f"""WITH {INPUT_SQL}, o AS (SELECT request_id, CASE WHEN refuse THEN 'refuse' WHEN pii THEN 'redact' ELSE 'allow' END AS a, {C.sql_pick(EXPECTED, 'n % 3')} AS e FROM input)
SELECT request_id, CAST(a <> e AS INTEGER) + CAST((a = 'refuse') <> (e = 'refuse') AS INTEGER) AS n_failures, a = e AS passed FROM o""")
def safety_evaluation(spark, sf_dir):
    o = S.input_safety(C.requests(spark, sf_dir), "query").withColumn("expected_action", C.pick(EXPECTED, F.col("n") % 3))
    tier = lambda c: F.when(F.col(c) == "refuse", "hard_refuse").otherwise("normal_answer")
    rows = o.withColumn("observed_action", F.col("input_action")).withColumn("observed_tier", tier("input_action")).withColumn("expected_tier", tier("expected_action"))
    return E.safety_case_results(rows).select("request_id", F.size("failures").cast("bigint").alias("n_failures"), "passed")


@query("retrieval_evaluation", full_retrieval_sql(C.FILTERED_SQL) + """
, cases AS (SELECT query_id, 'src' || CAST(CAST(substr(query_id, 2) AS BIGINT) % 20 AS VARCHAR) AS s, 'c' || lpad(CAST(CAST(substr(query_id, 2) AS BIGINT) AS VARCHAR), 12, '0') AS c FROM asked),
found AS (SELECT k.query_id, bool_or(coalesce(h.source_id = k.s, false)) AS sf, bool_or(coalesce(r.chunk_id = k.c, false)) AS cf FROM cases k LEFT JOIN results r USING (query_id) LEFT JOIN chunks h ON h.chunk_id = r.chunk_id GROUP BY k.query_id)
SELECT query_id, CAST(NOT sf AS INTEGER) + CAST(NOT cf AS INTEGER) AS n_failures, sf AND cf AS passed FROM found""")
def retrieval_evaluation(spark, sf_dir):
    asked = rt.with_defaults(C.filtered_queries(spark, sf_dir))
    i = F.substring("query_id", 2, 6).cast("bigint")
    cases = asked.drop("query", "top_k").withColumn("expected_source_id", F.concat(F.lit("src"), i % 20)).withColumn(
        "expected_chunk_id", F.concat(F.lit("c"), F.lpad(i.cast("string"), 12, "0"))).withColumn("expected_tier", F.lit("normal_answer")).withColumn("observed_tier", F.lit("normal_answer"))
    found = bk.retrieve(stored_terms(spark, sf_dir), asked, C.ref_ts()).select("query_id", "chunk_id")
    chunks = C.chunks(spark, sf_dir).select("chunk_id", "source_id", "collection_category", "source_family", D.effective_status("deadline_raw_text", "deadline_status", C.ref_ts()).alias("status"))
    out = E.retrieval_failures(cases, found.join(chunks, "chunk_id"))
    return out.select("query_id", F.size("failures").cast("bigint").alias("n_failures"), "passed")


PROHIBITED = (r"zzqx\d+3$", "[.!?] [A-Z]")


@query("citation_evaluation", full_retrieval_sql(C.FILTERED_SQL) + f"""
, cites AS (SELECT r.query_id, r.rank AS k, r.rank % 5 <> 0 AS found FROM results r JOIN asked a USING (query_id)
  WHERE (len(a.collection_categories) > 0 OR len(a.source_families) > 0 OR len(a.source_ids) > 0 OR len(a.deadline_statuses) > 0) AND CAST(substr(r.query_id, 2) AS BIGINT) % 6 <> 0)
SELECT query_id, 'citation ' || CAST(k AS VARCHAR) || ' does not map to public filtered retrieval results' AS failure FROM cites WHERE NOT found
UNION ALL SELECT query_id, 'filtered citation ' || CAST(k AS VARCHAR) || ' lacks posted_at' FROM cites WHERE found AND k % 3 = 0
UNION ALL SELECT query_id, 'filtered citation ' || CAST(k AS VARCHAR) || ' lacks fetched_at' FROM cites WHERE found AND k % 8 = 0
UNION ALL SELECT query_id, 'filtered citation ' || CAST(k AS VARCHAR) || ' lacks deadline_status' FROM cites WHERE found AND k % 7 = 0
UNION ALL SELECT query_id, 'filtered citation ' || CAST(k AS VARCHAR) || ' lacks HTTPS source URL' FROM cites WHERE found AND k % 4 = 0
UNION ALL SELECT query_id, 'answer contains prohibited pattern ' || pattern FROM asked, (SELECT unnest({C.sql_list(PROHIBITED)}) AS pattern) WHERE regexp_matches(query, pattern)""")
def citation_evaluation(spark, sf_dir):
    """Citations made of the retrieved rows, some of them damaged by rank, judged against the rows; the passages stand for answers."""
    asked = rt.with_defaults(C.filtered_queries(spark, sf_dir))
    state = C.chunks(spark, sf_dir).select(
        "chunk_id", "source_id", "collection_category", "source_family", "canonical_url", D.effective_status("deadline_raw_text", "deadline_status", C.ref_ts()).alias("status"))
    results = written(bk.retrieve(stored_terms(spark, sf_dir), asked, C.ref_ts()).select("query_id", "chunk_id", "rank").join(state, "chunk_id"), "results")
    k, day = F.col("rank"), F.lit("2026-01-02T00:00:00Z")
    citations = results.select(
        "query_id", k.alias("citation_id"), F.when(k % 5 == 0, "none").otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(k % 4 == 0, F.regexp_replace("canonical_url", "^https", "http")).otherwise(F.col("canonical_url")).alias("url"), F.when(k % 3 != 0, day).alias("posted_at"),
        F.when(k % 8 == 0, "yesterday").otherwise(day).alias("fetched_at"), F.when(k % 7 == 0, "open").otherwise(F.col("status")).alias("deadline_status"),
    )
    refused = F.substring("query_id", 2, 6).cast("bigint") % 6 == 0
    cases = asked.withColumn("refusal_tier", F.when(refused, "hard_refuse").otherwise("normal_answer"))
    patterns = asked.select("query_id", F.explode(F.array(*[F.lit(p) for p in PROHIBITED])).alias("pattern"))
    return E.citation_failures(cases, citations, results).unionByName(E.prohibited_matches(asked.withColumnRenamed("query", "answer"), patterns))


CHECKS = ("inline_citation", "structured_citation", "korean", "refusal_behavior", "no_guaranteed_outcome", "source_url", "deadline_status")


@query("answer_checks", f"""WITH {C.ANSWERS_SQL}, a AS (SELECT request_id, answer, n, CASE WHEN n % 4 = 0 THEN 'hard_refuse' ELSE 'normal_answer' END AS tier FROM answers),
e AS (SELECT *, unnest({C.sql_list(CHECKS)}) AS check_name FROM a)
SELECT request_id AS case_id, check_name, CASE check_name WHEN 'inline_citation' THEN regexp_matches(answer, '\\[\\d+\\]') WHEN 'structured_citation' THEN tier = 'hard_refuse' OR n % 3 <> 0 WHEN 'korean' THEN regexp_matches(answer, '[가-힣]')
  WHEN 'refusal_behavior' THEN tier = 'hard_refuse' WHEN 'no_guaranteed_outcome' THEN NOT regexp_matches(answer, '(?:취업|합격|채용)\\s*보장') WHEN 'source_url' THEN n % 3 = 0 OR n % 5 <> 0 WHEN 'deadline_status' THEN n % 2 = 0 END AS passed FROM e""")
def answer_checks(spark, sf_dir):
    a = C.answers(spark, sf_dir)
    n = F.col("n")
    cite = F.struct(F.lit("c1").alias("chunk_id"), F.when(n % 5 == 0, "http://example.com/").otherwise("https://example.com/").alias("url"))
    top = F.struct(F.lit("c1").alias("chunk_id"), F.lit("2024-06-01T00:00:00Z").alias("fetched_at"), F.lit(None).cast("string").alias("posted_at"), F.when(n % 2 == 0, "active").otherwise("unknown").alias("deadline_status"))
    cases = a.select(
        F.col("request_id").alias("case_id"), F.array(*[F.lit(c) for c in CHECKS]).alias("checks"), "answer", F.when(n % 4 == 0, "hard_refuse").otherwise("normal_answer").alias("refusal_tier"),
        F.when(n % 3 == 0, F.array().cast("array<struct<chunk_id:string,url:string>>")).otherwise(F.array(cite)).alias("citations"), F.array(top).alias("top"),
        F.lit(False).alias("requires_posted_at"), F.lit("active").alias("expected_deadline_status"),
    )
    return E.answer_checks(cases)


@query("judge_scores", f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 1 ELSE CAST(value / 100 < 0.7 OR event_type = 'error' AS INTEGER) END AS n_failures FROM events""")
def judge_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    dim = lambda s, p: F.struct(s.alias("score"), p.alias("passed"), F.lit("why").alias("reason"))
    good = dim(F.lit(0.9), F.lit(True))
    raw = F.to_json(F.struct(F.struct(good.alias("faithfulness"), dim(F.col("value") / 100, F.col("event_type") != "error").alias("citation_quality"), good.alias("korean_quality")).alias("dimensions")))
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit('{"dimensions": {}}')).otherwise(raw).alias("raw"))
    return E.judge_scores(rows, "raw").select("event_id", F.size("judge_failures").cast("bigint").alias("n_failures"))


@query("p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY event_type")
def p95(spark, sf_dir):
    return E.p95(table(spark, sf_dir, "events"), "value", ["event_type"])


# --- keyed state and streams --------------------------------------------------------
def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_HOURLY = "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def _hourly(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("audit_hourly", _HOURLY)
def audit_hourly(spark, sf_dir):
    return _hourly(SS.audit_counts(events(spark, sf_dir), "ts", "event_type"))


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return runs.file_stream(spark, f"{sf_dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_audit", _HOURLY)
def stream_audit(spark, sf_dir):
    return _hourly(runs.run_available(runs.audit_count_stream(_event_stream(spark, sf_dir), "ts", "event_type"), "update", ["window_start", "event_type"]))


def _references(e):
    k = F.col("event_id")
    return e.select(
        F.concat(F.lit("s"), "user_id").alias("session"), F.concat(F.lit(" https://example.com/"), F.col("user_id") % 5, F.lit("/"), k % 4, F.lit(" ")).alias("url"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("title "), k)).alias("title"), F.lit("label").alias("source_label"),
        F.when(k % 5 == 0, F.col("ts")).alias("posted_at"), F.col("ts").alias("fetched_at"), C.pick(("unknown", "active", "expired"), k % 3).alias("deadline_status"),
        F.col("ts").alias("at"), "event_id", F.when(k % 2 == 0, F.concat(F.lit("q"), k)).alias("last_query"),
    )


_REFS = """WITH r AS (SELECT 's' || CAST(user_id AS VARCHAR) AS session, 'https://example.com/' || CAST(user_id % 5 AS VARCHAR) || '/' || CAST(event_id % 4 AS VARCHAR) AS url, event_id AS k, ts FROM events)
SELECT session, url, coalesce(arg_min('title ' || CAST(k AS VARCHAR), (ts, k)) FILTER (k % 3 <> 0), '') AS title, CAST(arg_min(ts, (ts, k)) FILTER (k % 5 = 0) AS VARCHAR) AS posted_at,
  coalesce(arg_min(CASE WHEN k % 3 = 1 THEN 'open' ELSE 'closed' END, (ts, k)) FILTER (k % 3 <> 0), 'unknown') AS deadline_status, count(*) AS reference_count, CAST(max(ts) AS VARCHAR) AS last_at,
  arg_max('q' || CAST(k AS VARCHAR), (ts, k)) FILTER (k % 2 = 0) AS last_query FROM r GROUP BY session, url"""


def _refs_out(df):
    stamp = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return df.select("session", "url", "title", stamp("posted_at").alias("posted_at"), "deadline_status", "reference_count", stamp("last_referenced_at").alias("last_at"), "last_query")


@query("session_refs", _REFS)
def session_refs(spark, sf_dir):
    return _refs_out(SS.session_references(_references(events(spark, sf_dir)), ["at", "event_id"]))


@query("reference_list", "WITH x AS (" + _REFS + ") SELECT session, url, row_number() OVER (PARTITION BY session ORDER BY last_at DESC, title, url) AS position FROM x")
def reference_list(spark, sf_dir):
    refs = SS.session_references(_references(events(spark, sf_dir)), ["at", "event_id"])
    return SS.reference_list(refs).select("session", "url", "position")


@query("stream_refs", _REFS)
def stream_refs(spark, sf_dir):
    return _refs_out(runs.run_available(runs.reference_stream(_references(_event_stream(spark, sf_dir)), ["at", "event_id"]), "update", ["session", "url"]))


def _preference_events(e):
    t, k = F.col("event_type"), F.col("event_id")
    setting = t.isin("signup", "purchase")
    return e.select(
        F.concat(F.lit("s"), "user_id").alias("session_key"), "ts", "event_id", F.when(setting, "set").when(t == "error", "clear").otherwise("update").alias("event"),
        F.when(setting | ((t == "view") & (k % 3 == 0)), F.concat(F.lit("major "), k % 7)).alias("major"), F.when(t != "error", F.concat(F.lit("role "), k % 11)).alias("target_role"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("ind"), k % 5))).alias("industry"), F.lit(None).cast("array<string>").alias("region"), F.lit(None).cast("array<string>").alias("employment_type"),
        F.when(k % 4 == 0, "urgent_first").alias("deadline_sensitivity"), (t == "purchase").alias("persist"), F.col("ts").alias("consented_at"),
        F.when(k % 13 == 0, 0).otherwise(365).alias("retention_days"), F.lit(True).alias("deletion_supported"),
    )


_PREFS = """WITH e AS (SELECT 's' || CAST(user_id AS VARCHAR) AS session_key, ts, event_id AS k, event_type AS t, CASE WHEN event_type IN ('signup', 'purchase') THEN 'set' WHEN event_type = 'error' THEN 'clear' ELSE 'update' END AS ev,
  CASE WHEN event_type IN ('signup', 'purchase') OR (event_type = 'view' AND event_id % 3 = 0) THEN 'major ' || CAST(event_id % 7 AS VARCHAR) END AS major, CASE WHEN event_type <> 'error' THEN 'role ' || CAST(event_id % 11 AS VARCHAR) END AS role,
  CASE WHEN event_id % 2 = 0 THEN 'ind' || CAST(event_id % 5 AS VARCHAR) END AS ind, CASE WHEN event_id % 4 = 0 THEN 'urgent_first' END AS sens FROM events WHERE NOT (event_type = 'purchase' AND event_id % 13 = 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY ts, k) AS i FROM e),
b AS (SELECT session_key, coalesce(max(i) FILTER (ev IN ('set', 'clear')), 0) AS reset, arg_max(ev, i) FILTER (ev IN ('set', 'clear')) AS kind FROM n GROUP BY session_key),
s AS (SELECT n.session_key, CASE WHEN b.kind = 'set' THEN any_value(b.reset) ELSE min(n.i) FILTER (n.ev = 'update' AND n.major IS NOT NULL AND n.i > b.reset) END AS start FROM n JOIN b USING (session_key) GROUP BY n.session_key, b.kind)
SELECT session_key, arg_max(major, i) FILTER (major IS NOT NULL) AS major, arg_max(role, i) FILTER (role IS NOT NULL) AS target_role, coalesce(arg_max(ind, i) FILTER (ind IS NOT NULL), '') AS industry,
  coalesce(arg_max(sens, i) FILTER (sens IS NOT NULL), 'balanced') AS deadline_sensitivity, CASE WHEN arg_max(t, i) = 'purchase' THEN 'persistent' ELSE 'session' END AS storage_scope
FROM n JOIN s USING (session_key) WHERE i >= start GROUP BY session_key"""


def _prefs_out(df):
    return df.select("session_key", "major", "target_role", F.coalesce(F.array_join("industry", ","), F.lit("")).alias("industry"), "deadline_sensitivity", "storage_scope")


@query("preference_state", _PREFS)
def preference_state(spark, sf_dir):
    return _prefs_out(SS.preference_state(_preference_events(events(spark, sf_dir)), ["ts", "event_id"], C.ref_ts()))


@query("stream_prefs", _PREFS)
def stream_prefs(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    rows = runs.run_available(runs.preference_stream(_preference_events(_event_stream(spark, sf_dir)), "ts", "event_id"), "update", ["session_key"])
    return _prefs_out(runs.live_preferences(rows, C.ref_ts()))


# --- sources ------------------------------------------------------------------------
@query("jsonl_scan", """WITH l AS (SELECT doc_id, doc_id % 16 AS part, doc_id % 10 AS kind FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS line FROM l WHERE kind <> 5)
SELECT part, CASE WHEN kind IN (3, 6) OR kind = 4 THEN line END AS line, CASE WHEN kind IN (3, 6) THEN 'invalid JSON' WHEN kind = 4 THEN 'schema invalid: lang must not be empty' END AS message,
       CASE WHEN kind NOT IN (3, 4, 6) THEN doc_id END AS doc_id FROM n""")
def jsonl_scan(spark, sf_dir):
    """Documents as JSON lines in files of their own, some lines broken, blank or empty: every valid row, and every failure with its file and line."""
    from pyspark.sql.types import StructType
    import uuid

    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("part", i % 16)
    line = F.to_json(F.struct("doc_id", "text", F.when(i % 10 == 4, "").otherwise(F.col("lang")).alias("lang")))
    value = F.when(i % 10 == 3, F.substring(line, 1, 20)).when(i % 10 == 5, "").when(i % 10 == 6, "  ").otherwise(line)
    path = f"{shared_dir(spark)}/siftbase/jsonl-{uuid.uuid4().hex}"
    d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", value.alias("value")).write.partitionBy("part").text(path)
    schema = StructType().add("doc_id", "long").add("text", "string").add("lang", "string")
    ok, bad = jsonl.scan_jsonl(spark, [path], schema, rules=[("lang_filled", F.length("lang") > 0, "lang must not be empty")])
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint")
    none = F.lit(None).cast("bigint")
    failed = bad.select(part.alias("part"), "line", "message", none.alias("doc_id"))
    return ok.select((i % 16).alias("part"), none.alias("line"), F.lit(None).cast("string").alias("message"), "doc_id").unionByName(failed)


@query("canonical_json", """SELECT doc_id, '{"a":{"lang":' || to_json(lang) || ',"source":' || to_json(source) || '},"doc_id":' || CAST(doc_id AS VARCHAR) || ',"z":[' || CAST(n_chars AS VARCHAR) || ']}' AS json FROM documents""")
def canonical_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.array("n_chars").alias("z"), "doc_id", F.struct("source", "lang").alias("a"))
    return d.select("doc_id", jsonl.canonical_json(d).alias("json"))


@query("multi_dataset_load", "SELECT dataset, count(*) AS n FROM (SELECT 'documents' AS dataset FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY dataset")
def multi_dataset_load(spark, sf_dir):
    both = spark.read.schema("text string").parquet(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.parquet", 1)
    return both.select(name.alias("dataset")).groupBy("dataset").agg(F.count("*").alias("n"))


@query("kb_write_read", f"WITH {C.CHUNKS_SQL} SELECT source_family, count(*) AS records, min(record_id) AS first_id, count(DISTINCT source_id) AS sources FROM chunks GROUP BY source_family")
def kb_write_read(spark, sf_dir):
    """Records and chunks through the checked sink and back."""
    import uuid

    from siftbase.plans.knowledge import records

    r = records(spark, sf_dir).withColumn("cleaned_text", F.col("text"))
    path = f"{shared_dir(spark)}/siftbase/kb-{uuid.uuid4().hex}"
    chunked = r.where(F.col("text").rlike(r"\S"))  # a record without text has no chunk
    jsonl.write_knowledge_base(r.drop("chunk_id", "text"), chunked.withColumn("chunk_ordinal", F.lit(0)).drop("cleaned_text", "raw_text"), path)
    back = jsonl.read_knowledge_base(spark, path, "records")
    return back.groupBy("source_family").agg(F.count("*").alias("records"), F.min("record_id").alias("first_id"), F.count_distinct("source_id").alias("sources"))


def _two_writes(batch):
    version = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))).alias("version")
    rows = batch.select("doc_id", "lang", F.sha2("text", 256).alias("hash"), version)
    return rows.withColumn("lang", F.when(F.col("version") == 0, "old").otherwise(F.col("lang")))


@query("stream_upsert", "SELECT doc_id, lang, sha256(text) AS hash, CAST(1 AS BIGINT) AS version FROM documents")
def stream_upsert(spark, sf_dir):
    """Documents streamed in four micro-batches into bucketed snapshots, each as two conflicting writes of which the later wins; the second run merges nothing new."""
    import uuid

    from siftbase.sources.snapshots import SnapshotStore

    store = SnapshotStore(f"{shared_dir(spark)}/siftbase/snapshots-{uuid.uuid4().hex}", key="doc_id", buckets=16)
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    inbox = f"{store.path}-inbox"
    documents.write.parquet(inbox)  # a file per task, so none holds a share of the whole table
    files = len(spark.read.schema(documents.schema).parquet(inbox).inputFiles())
    stream = runs.file_stream(spark, inbox, documents.schema, -(-files // 4))  # four micro-batches
    for _ in range(2):
        runs.upsert_stream(stream, store, "doc_id", F.col("version"), _two_writes).awaitTermination()
    return store.current(spark).select("doc_id", "lang", "hash", "version")


@query("personalisation_scenarios", REC_SQL + """, first AS (SELECT query_id, chunk_id, match_strength FROM recommended WHERE position = 1), p AS (SELECT query_id, 'p' || lpad(CAST(CAST(substr(query_id, 2) AS BIGINT) + 1 AS VARCHAR), 9, '0') AS other FROM profiles)
SELECT 'strength ' || p.query_id AS scenario, coalesce(f.match_strength = 'partial_match', false) AS passed FROM p LEFT JOIN first f USING (query_id)
UNION ALL SELECT 'flip ' || p.query_id, coalesce(f.chunk_id <> o.chunk_id, false) FROM p LEFT JOIN first f USING (query_id) LEFT JOIN first o ON o.query_id = p.other""")
def personalisation_scenarios(spark, sf_dir):
    results = _recommended(spark, sf_dir).select("query_id", "position", "chunk_id", "match_strength", F.array_join("match_reasons", "|").alias("published"))
    p = profiles(spark, sf_dir).select("query_id")
    other = F.concat(F.lit("p"), F.lpad((F.substring("query_id", 2, 9).cast("bigint") + 1).cast("string"), 9, "0"))
    none = F.lit(None).cast("string")
    scenarios = p.select(F.concat(F.lit("strength "), "query_id").alias("scenario"), F.lit("strength").alias("kind"), "query_id", none.alias("other_query_id"), F.lit("partial_match").alias("value")).unionByName(
        p.select(F.concat(F.lit("flip "), "query_id").alias("scenario"), F.lit("first_differs").alias("kind"), "query_id", other.alias("other_query_id"), none.alias("value"))
    )
    from siftbase.session import written

    return E.scenario_checks(written(results, "results"), scenarios)
