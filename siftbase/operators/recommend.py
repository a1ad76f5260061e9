"""Recommendations: profile queries, source quality, scores, reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import dates as D, text as T, urls as U
from siftbase.operators.retrieve import MAX_TOP_K, matched_terms, query_terms, retrieve
from siftbase.operators.roles import INTERNSHIP_OPPORTUNITY, OPPORTUNITY, internship_signal
from siftbase.session import broadcast_if_small, computed_once, written

# --- fixed values -----------------------------------------------------------
DEFAULT_QUERY = "채용 모집 공고 취업 프로그램"
SENSITIVITY_TERMS = {"urgent_first": "마감 임박 진행 중", "include_unknown": "마감 미정 포함", "balanced": "채용 모집 공고"}
WEIGHTS = {
    "base_retrieval_score": 0.30, "major_match_score": 0.20, "target_role_match_score": 0.20,
    "optional_preference_score": 0.10, "source_quality_score": 0.15, "freshness_score": 0.05,
}
UNSUPPORTED_PHRASES = ("공식 인증", "합격 보장", "취업 보장", "출처를 생략", "개인정보를 입력")
REASON = {
    "general": "- 일반 안내: 현재 공고/프로그램 정보와 출처 메타데이터를 기준으로 확인할 수 있는 항목입니다 ",
    "partial": "- 참고 정보: 현재 공고/프로그램 정보와 출처 메타데이터를 기준으로 확인할 수 있는 항목입니다 ",
    "major": "- 맞춤 추천: 입력한 전공 선호 관련 근거가 공고 정보에서 확인됩니다 ",
    "role": "- 맞춤 추천: 입력한 관심직무 선호와 연결되는 모집/프로그램 단서가 있습니다 ",
    "optional": "- 맞춤 추천: 입력한 선택 선호와 일부 맞는 조건이 확인됩니다 ",
    "source_head": "- 출처 근거: ",
    "source_tail": " 항목의 제목·분류·출처 메타데이터를 함께 확인했습니다 ",
    "active": "- 마감/최신성: 현재 마감 상태가 진행 중인 정보로 표시되어 우선 확인할 가치가 있습니다 ",
    "expired": "- 마감/최신성: 마감된 정보일 수 있어 지원 전 원문 날짜를 다시 확인하세요 ",
    "unknown": "- 마감/최신성: 마감 상태가 불명확하므로 원문과 게시·수집일을 함께 확인하세요 ",
}
# ----------------------------------------------------------------------------


def round4(c: Column) -> Column:
    """Clamp to 0..1, four digits, halves up."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 10000 + 0.5) / 10000


def source_quality(df: DataFrame, ref_ts: Column, status: str = "deadline_status") -> DataFrame:
    """O-110: adds ``source_quality_score`` and ``freshness_score``; ``status`` is the effective one."""
    anchors, source_url = F.col("citation_anchors"), F.col("source_url")
    staged = computed_once(
        df,
        {
            "_deadline": F.when(F.col(status) == "active", 1.0).when(F.col(status) == "unknown", 0.45).otherwise(0.0),
            "_posted": D.recency(F.col("posted_at"), ref_ts, 120),
            "_fetched": D.recency(F.col("fetched_at"), ref_ts, 180),
            "_precise": F.exists(anchors, lambda a: a["page_number"].isNotNull() | (a["url"] != source_url)),
            "_detailed": F.exists(anchors, lambda a: U.is_detailed(a["url"])),
            "_anchors": F.size(anchors),
            "_url": F.when(U.is_detailed(source_url), 1.0).otherwise(0.2),
        },
        df.columns,
    )
    by_count = F.least(F.lit(1.0), F.col("_anchors") / 2.0) * 0.45 + F.when(F.col("_detailed"), 1.0).otherwise(0.35) * 0.55
    citation = F.when(F.col("_precise"), 1.0).otherwise(round4(by_count))
    clean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("boilerplate_penalty")))
    quality = F.col("_deadline") * 0.25 + F.col("_posted") * 0.15 + F.col("_fetched") * 0.1 + citation * 0.2 + F.col("_url") * 0.15 + clean * 0.15
    return staged.select(
        *df.columns,
        round4(quality).alias("source_quality_score"),
        round4(F.col("_deadline") * 0.5 + F.col("_posted") * 0.3 + F.col("_fetched") * 0.2).alias("freshness_score"),
    )


def match_score(preference: Column, evidence: Column) -> Column:
    """O-111: ``preference`` and ``evidence`` in preference form; whole phrase 1, else the share of tokens found."""
    words = T.preference_tokens(preference)
    share = F.size(F.filter(words, lambda w: F.contains(evidence, w))) / F.size(words)
    return F.when(F.coalesce(preference, F.lit("")) == "", 0.0).when(F.contains(evidence, preference), 1.0).when(F.size(words) == 0, 0.0).otherwise(round4(share))


def optional_score(preferences: Column, evidence: Column, sensitivity: Column, status: Column) -> Column:
    """O-95, O-112: mean match × .65 plus the deadline term × .35."""
    scores = F.transform(preferences, lambda p: match_score(p, evidence))
    mean = F.when(F.size(preferences) == 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(preferences))
    deadline = (
        F.when(sensitivity == "include_unknown", F.when(status == "expired", 0.0).otherwise(1.0))
        .when(sensitivity == "urgent_first", F.when(status == "active", 1.0).otherwise(0.0))
        .otherwise(F.when(status == "expired", 0.25).otherwise(0.75))
    )
    return round4(mean * 0.65 + deadline * 0.35)


def profile_queries(profiles: DataFrame) -> DataFrame:
    """Retrieval query per profile row (query_id, profile columns, optional ``request_query`` and ``limit``)."""
    have = set(profiles.columns)
    own = F.col("request_query") if "request_query" in have else F.lit(None).cast("string")
    limit = F.coalesce(F.col("limit"), F.lit(5)) if "limit" in have else F.lit(5)
    known = F.col("major").isNotNull()
    term = F.coalesce(*[F.when(F.coalesce(F.col("deadline_sensitivity"), F.lit("balanced")) == k, F.lit(v)) for k, v in SENSITIVITY_TERMS.items()])
    words = F.concat(F.array("major", "target_role"), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("industry", "region", "employment_type")], F.array(term, own))
    text = F.array_join(F.filter(words, lambda w: w.isNotNull() & (F.trim(w) != "")), " ")
    q = profiles.withColumn("query", F.when(known, text).otherwise(F.coalesce(own, F.lit(DEFAULT_QUERY))))
    names = lambda values: F.array(*[F.lit(v) for v in values])
    given = F.col("collection_categories") if "collection_categories" in have else F.lit(None).cast("array<string>")
    by_intent = F.when(internship_signal(F.col("query"), F.coalesce(F.col("employment_type"), F.array().cast("array<string>"))), names(INTERNSHIP_OPPORTUNITY)).otherwise(names(OPPORTUNITY))
    return q.select(
        *[c for c in profiles.columns if c not in ("collection_categories", "limit")], "query", limit.cast("int").alias("limit"),
        F.least(F.lit(MAX_TOP_K), F.greatest(limit, limit * 3)).cast("int").alias("top_k"),
        F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(by_intent).alias("collection_categories"),
    )


def with_evidence(chunks: DataFrame) -> DataFrame:
    """The part of the match evidence that is the same for every profile."""
    return computed_once(chunks, {"chunk_evidence": T.preference_text(F.concat_ws(" ", "title", "category", "deadline_raw_text", "text"))}, chunks.columns)


def score_candidates(candidates: DataFrame, ref_ts: Column) -> DataFrame:
    """O-113: score parts, ``final_score`` and ``match_strength`` of (profile, chunk) rows with an effective status and ``chunk_evidence``."""
    scored = source_quality(candidates, ref_ts)
    lists = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("industry", "region", "employment_type")])
    staged = computed_once(
        scored,
        {
            "_evidence": F.concat_ws(" ", "chunk_evidence", T.preference_text(F.array_join("matched_terms", " "))),
            "_major": T.preference_text("major"), "_role": T.preference_text("target_role"), "_optional": F.transform(lists, T.preference_text),
        },
        scored.columns,
    )
    known, evidence = F.col("major").isNotNull(), F.col("_evidence")
    parts = computed_once(
        staged,
        {
            "base_retrieval_score": round4(F.col("normalized_score")),
            "major_match_score": F.when(known, match_score(F.col("_major"), evidence)).otherwise(0.0),
            "target_role_match_score": F.when(known, match_score(F.col("_role"), evidence)).otherwise(0.0),
            "optional_preference_score": F.when(known, optional_score(F.col("_optional"), evidence, F.col("deadline_sensitivity"), F.col("deadline_status"))).otherwise(0.0),
        },
        scored.columns,
    )
    total = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    strong = (F.greatest("major_match_score", "target_role_match_score") >= 0.75) & (F.col("source_quality_score") >= 0.45)
    # the sum is rounded to 10 digits first so that both ends of a tie at the fourth digit round alike
    return parts.withColumn("final_score", round4(F.round(total, 10))).withColumn(
        "match_strength", F.when(~known, "general_recommendation").when(strong, "personalized_match").otherwise("partial_match")
    )


def rank_recommendations(scored: DataFrame) -> DataFrame:
    """O-102: drop rows without a usable citation or field, then order and cut to ``limit``; the number is the citation id."""
    anchor = F.get("citation_anchors", F.lit(0))
    valid = U.is_https(anchor["url"]) & (F.length("title") > 0) & (F.length("category") > 0) & (U.protocol("source_url") != "") & F.col("fetched_at").isNotNull()
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("rank"))
    kept = scored.filter(F.coalesce(valid, F.lit(False))).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= F.col("limit"))
    return kept.withColumn("recommendation_id", F.concat(F.lit("rec-"), "position"))


def match_reasons(ranked: DataFrame) -> DataFrame:
    """O-115: two or three templated reasons per recommendation."""
    marker = F.concat(F.lit("["), "position", F.lit("]"))
    line = lambda key: F.concat(F.lit(REASON[key]), marker)
    fresh = F.when(F.col("deadline_status") == "active", line("active")).when(F.col("deadline_status") == "expired", line("expired")).otherwise(line("unknown"))
    source = F.concat(F.lit(REASON["source_head"]), "category", F.lit(REASON["source_tail"]), marker)
    major, role = F.col("major_match_score") > 0, F.col("target_role_match_score") > 0
    own = F.array_compact(
        F.array(
            F.when(major, line("major")), F.when(role, line("role")),
            F.when(~major & ~role & (F.col("optional_preference_score") > 0), line("optional")), source, F.when(~(major & role), fresh),
        )
    )
    plain = F.array(F.when(F.col("match_strength") == "partial_match", line("partial")).otherwise(line("general")), fresh)
    personal = (F.col("match_strength") == "personalized_match") & F.col("major").isNotNull()
    return ranked.withColumn("match_reasons", F.slice(F.when(personal, own).otherwise(plain), 1, 3))


def reason_failures(reasons: Column, allowed: Column) -> Column:
    """O-115: failures of a reason list against the allowed citation ids."""
    def per_reason(r: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        markers = T.citation_markers(r)
        phrases = F.transform(T.contains_any(r, UNSUPPORTED_PHRASES), lambda p: F.concat(F.lit("unsupported recommendation phrase rejected: "), p))
        foreign = F.transform(
            F.filter(markers, lambda m: ~F.array_contains(allowed, m)),
            lambda m: F.concat(F.lit("citation marker ["), m, F.lit("] is not allowed for recommendation reasons")),
        )
        return F.concat(
            F.array_compact(F.array(F.when(~T.has_hangul(r), F.concat(F.lit("reason "), number, F.lit(" must be Korean-first and contain Hangul"))))),
            phrases,
            F.array_compact(F.array(F.when(F.size(markers) == 0, F.concat(F.lit("reason "), number, F.lit(" must include an inline numeric citation"))))),
            foreign,
        )

    count = F.array_compact(F.array(F.when((F.size(reasons) == 0) | (F.size(reasons) > 3), "recommendation reasons must contain 1-3 bullets")))
    return F.concat(count, F.flatten(F.transform(reasons, per_reason)))


def recommend(index, chunks: DataFrame, profiles: DataFrame, ref_ts: Column, search: Callable[..., DataFrame] = retrieve, explain: Callable[..., DataFrame] = matched_terms, **options) -> DataFrame:
    """O-86, O-114: profiles (query_id, major, target_role, lists, deadline_sensitivity) to ranked, explained recommendations.

    A profile row with a null ``major`` stands for a request without preferences.
    ``search`` and ``explain`` are the retrieval and the matched terms of the kind of ``index``.
    """
    asked = written(profile_queries(profiles), "profile-queries")
    # profiles that ask the same are searched and explained once
    same = ["query", "top_k", "collection_categories"]
    searches = written(asked.groupBy(*same).agg(F.min("query_id").alias("search_id")), "searches")
    plain = searches.withColumnRenamed("search_id", "query_id")
    pool = written(search(index, plain, ref_ts, **options), "candidates")
    terms = query_terms(plain, use_nfkc=options.get("use_nfkc", True))
    found = written(explain(pool, index, terms).withColumnRenamed("query_id", "search_id"), "explained")
    members = asked.join(searches, same).select("query_id", "search_id")
    with_terms = written(members.join(broadcast_if_small(found), "search_id").drop("search_id"), "results")
    own = asked.drop(*same)
    used = chunks.join(broadcast_if_small(found.select("chunk_id").distinct()), "chunk_id", "left_semi")
    # evidence is normalised once per used chunk, not once per (profile, chunk)
    payload = with_evidence(used).drop("text").withColumn("deadline_status", D.effective_status("deadline_raw_text", "deadline_status", ref_ts))
    candidates = payload.join(broadcast_if_small(with_terms), "chunk_id").join(broadcast_if_small(own), "query_id")
    return match_reasons(rank_recommendations(score_candidates(candidates, ref_ts)))


def minimised_profile(raw: DataFrame, list_columns: tuple[str, ...] = ("industry", "region", "employment_type")) -> DataFrame:
    """O-144: comma lists split and trimmed; free text dropped; failures of the strict limits, a list of more than five items among them."""
    def items(c: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    out = raw.select(
        "session_key", F.trim("major").alias("major"), F.trim("target_role").alias("target_role"), *[items(c).alias(c) for c in list_columns],
        F.coalesce("deadline_sensitivity", F.lit("balanced")).alias("deadline_sensitivity"),
    )
    failures = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.length("major").between(1, 80), F.lit(False)), "major must have 1-80 characters"),
            F.when(~F.coalesce(F.length("target_role").between(1, 120), F.lit(False)), "target_role must have 1-120 characters"),
            *[F.when(F.size(c) > 5, f"{c} must have at most 5 items") for c in list_columns],
            *[F.when(F.exists(c, lambda x: F.length(x) > 80), f"{c} items must have at most 80 characters") for c in list_columns],
            F.when(~F.col("deadline_sensitivity").isin(*SENSITIVITY_TERMS), "unknown deadline_sensitivity"),
        )
    )
    return out.withColumn("failures", failures)
