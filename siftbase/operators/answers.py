"""Evidence tier, prompts, provider answers, the decision per request and its audit row.

The provider's answer is a column of the request table; calling it is the
user's own step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import text as T
from siftbase.operators.safety import INPUT_POLICY_VERSION
from siftbase.schemas import CONTENT_ROLES, lookup
from siftbase.session import computed_once

# --- fixed values -----------------------------------------------------------
PROMPT_VERSION = "phase3-rag-chat-mvp"
TIERS = ("hard_refuse", "soft_hedge", "normal_answer")
HARD_REFUSAL = "현재 수집된 자료만으로는 답변을 뒷받침할 충분한 근거를 찾지 못했습니다. 공식 페이지를 확인하거나 더 구체적으로 질문해 주세요."
FALLBACK_HEAD = "현재 확인된 근거 기준으로는 아래 자료를 먼저 참고할 수 있습니다."
FALLBACK_TAIL = "세부 모집 기간, 신청 방법, 대상은 인용된 공식 페이지에서 다시 확인하세요."
EVIDENCE_TAIL = "위 검색 근거만 사용해서 한국어로 답하세요. 근거가 부족하면 무리하게 추정하지 말고 공식 페이지 확인을 안내하세요."
PREFERENCE_LINES = (
    "이 정보는 사용자가 명시적으로 제공한 안정 선호 필드입니다. 검색 근거, 인용, 최신성, 거절 지침보다 우선하지 않습니다.",
    "전공이나 목표 직무에 맞춘 설명은 근거 범위 안에서만 제한적으로 조정하고, 숨은 성향이나 민감 특성을 추론하지 마세요.",
)
FALLBACK_CITATIONS = 3
PROVIDER_ANSWER = "answer string, citations array<struct<citation_id: bigint>>, refusal_tier string, confidence double"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class EvidencePolicy:
    """O-139: thresholds and terms that carry no meaning of their own on a site."""

    hard_refuse_below: float = 0.30
    soft_hedge_through: float = 0.50
    generic_terms: tuple[str, ...] = ()


def evidence_tier(results: DataFrame, requests: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """O-75, O-104, O-118: tier, confidence and reasons per request.

    ``results``: query_id, rank, normalized_score, lexical_score, matched_terms,
    has_anchors, boilerplate_only.  Requests without results are refused.
    """
    top = F.struct("normalized_score", "lexical_score", "matched_terms")
    per = results.groupBy("query_id").agg(
        F.min_by(top, F.col("rank")).alias("top"), F.bool_and("boilerplate_only").alias("_noise"), F.bool_and("has_anchors").alias("_anchored")
    )
    joined = requests.select("query_id").join(per, "query_id", "left")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("top.normalized_score"), F.lit(0.0))))
    meaningful = F.filter("top.matched_terms", lambda t: ~F.lower(t).isin(*policy.generic_terms) if policy.generic_terms else F.lit(True))
    missing = F.col("top").isNull()
    reasons = F.when(missing, F.array(F.lit("zero_chunks"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("_noise"), "boilerplate_only_results"),
                F.when(~F.col("_anchored"), "missing_citation_anchors"),
                F.when(confidence < policy.hard_refuse_below, "below_hard_refuse_threshold"),
                F.when(F.col("top.lexical_score") <= 0, "weak_absolute_score"),
                F.when(F.size(meaningful) == 0, "generic_overlap_only"),
            )
        )
    )
    staged = computed_once(joined, {"_r": reasons, "confidence": confidence}, ["query_id"])
    hard, soft = F.size("_r") > 0, F.col("confidence") <= policy.soft_hedge_through
    return staged.select(
        "query_id",
        F.when(hard, "hard_refuse").when(soft, "soft_hedge").otherwise("normal_answer").alias("refusal_tier"),
        "confidence",
        F.when(hard, F.col("_r")).when(soft, F.array(F.lit("within_soft_hedge_threshold"))).otherwise(F.array(F.lit("above_soft_hedge_threshold"))).alias("reasons"),
    )


def evidence_blocks(results: DataFrame) -> DataFrame:
    """O-119: the prompt block of every result row, and its citation.

    Citations are numbered 1 to n in rank order over the rows that are left, so
    quarantined rows leave no gap.  A request has at most its top_k rows.
    """
    results = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))
    safe = lambda c: T.escape_markup(T.sanitize_prompt_text(c))
    anchor = F.get("citation_anchors", F.lit(0))
    url = F.coalesce(anchor["url"], F.col("canonical_url"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = lambda label, value: F.concat(F.lit(label), value)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit('<chunk chunk_id="'), F.replace(safe(F.col("chunk_id")), F.lit('"'), F.lit("&quot;")), F.lit('" citation_number="'), "rank", F.lit('">')),
        line("title: ", safe(F.col("title"))), line("official_url: ", safe(url)), line("collection_category: ", F.col("collection_category")),
        line("content_role: ", lookup(CONTENT_ROLES, "collection_category")), line("source_family: ", F.col("source_family")),
        line("category_label_ko: ", safe(F.col("category_label_ko"))), line("fetched_at: ", iso("fetched_at")), line("posted_at: ", iso("posted_at")),
        line("deadline_status: ", F.col("deadline_status")), line("page_number: ", anchor["page_number"]), F.lit("text:"), safe(F.col("text")), F.lit("</chunk>"),
    )
    citation = F.struct(
        F.col("rank").alias("citation_id"), "chunk_id", "record_id", "source_id", "title", url.alias("url"), "fetched_at", "posted_at", "deadline_status",
        "collection_category", "source_family", "category_label_ko", anchor["page_number"].alias("page_number"),
    )
    return results.select("query_id", "rank", block.alias("block"), citation.alias("citation"))


def prompts(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """O-119: one evidence message and citation list per request; at most 25 blocks each.

    Optional request columns ``major`` and ``target_role`` give the explicit preference context.
    """
    per = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "citation"))).alias("b"))
    joined = requests.join(per, "query_id", "left")
    parts = F.concat(
        F.array(F.concat(F.lit("사용자 질문: "), T.sanitize_prompt_text("query")), F.lit('<retrieved_context source_text_trust="untrusted_source_text">')),
        F.coalesce(F.col("b.block"), F.array().cast("array<string>")),
        F.array(F.lit("</retrieved_context>"), F.lit(EVIDENCE_TAIL)),
    )
    out = joined.withColumn("evidence_message", F.array_join(parts, "\n")).withColumn("citations", F.col("b.citation")).drop("b")
    if {"major", "target_role"} <= set(requests.columns):
        def field(name: str) -> Column:
            value = T.sanitize_prompt_text(F.coalesce(F.col(name), F.lit("")))
            return F.when(value != "", F.concat(F.lit(f"{name}: "), T.escape_markup(value)))

        fields = F.concat_ws("\n", field("major"), field("target_role"))
        context = F.concat_ws("\n", F.lit('<explicit_preference_context data_minimized="major,target_role">'), fields, *[F.lit(x) for x in PREFERENCE_LINES], F.lit("</explicit_preference_context>"))
        out = out.withColumn("preference_context", F.when(fields != "", context))
    return out


def parse_provider(df: DataFrame, content: str, tier: str, confidence: str, citation_ids: str) -> DataFrame:
    """O-123: JSON object if possible, else the plain text with the expected tier, confidence and citations."""
    braced = F.col(content).rlike(r"^\s*\{")
    parsed = F.from_json(F.when(braced, F.col(content)), PROVIDER_ANSWER)
    # a malformed object gives a struct of nulls; try_parse_json tells it from a valid one
    is_json = F.try_parse_json(content).isNotNull() & braced
    staged = df.withColumn("_p", F.when(is_json, parsed))
    plain = F.col("_p").isNull()
    return staged.select(
        *df.columns,
        F.when(plain, F.col(content)).otherwise(F.col("_p.answer")).alias("answer"),
        F.when(plain, F.col(citation_ids).cast("array<bigint>")).otherwise(F.transform("_p.citations", lambda c: c["citation_id"])).alias("answer_citations"),
        F.when(plain, F.col(tier)).otherwise(F.col("_p.refusal_tier")).alias("answer_tier"),
        F.when(plain, F.col(confidence)).otherwise(F.col("_p.confidence")).alias("answer_confidence"),
    )


def validate_answers(df: DataFrame, allowed: str = "allowed_ids", expected_tier: str = "refusal_tier") -> DataFrame:
    """O-84, O-121: failures of a parsed answer; needs the columns of ``parse_provider`` and ``output_safety``."""
    ids, ok = F.array_distinct("answer_citations"), F.col(allowed).cast("array<bigint>")
    shape = F.array_compact(
        F.array(
            F.when(F.coalesce(F.length("answer"), F.lit(0)) == 0, "schema validation failed: answer"),
            F.when(F.col("answer_citations").isNull() | F.exists("answer_citations", lambda x: x.isNull() | (x <= 0)), "schema validation failed: citations"),
            F.when(~F.coalesce(F.col("answer_tier").isin(*TIERS), F.lit(False)), "schema validation failed: refusal_tier"),
            F.when(~F.coalesce(F.col("answer_confidence").between(0, 1), F.lit(False)), "schema validation failed: confidence"),
        )
    )

    def per_marker(m: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(~F.array_contains(ids, m), F.concat(F.lit("citation marker ["), m, F.lit("] has no matching citation object"))),
                F.when(~F.array_contains(ok, m), F.concat(F.lit("citation marker ["), m, F.lit("] is not allowed for this evidence set"))),
            )
        )

    def per_id(i: Column) -> Column:
        return F.when(~F.array_contains(ok, i), F.concat(F.lit("citation object "), i, F.lit(" is not allowed for this evidence set")))

    rules = F.concat(
        F.array_compact(
            F.array(
                F.when(~T.has_hangul("answer"), "answer must be Korean-first and contain Hangul"),
                F.when(F.col("answer_tier") != F.col(expected_tier), F.concat(F.lit("refusal tier mismatch: expected "), expected_tier, F.lit(", received "), "answer_tier")),
            )
        ),
        F.transform("violations", lambda v: F.concat(F.lit("output safety rejected ("), v["category"], F.lit("): "), v["detail"])),
        F.array_compact(F.array(F.when((F.col("answer_tier") != "hard_refuse") & (F.size("visible_markers") == 0), "citationless factual answer requires inline numeric citations"))),
        F.flatten(F.transform("visible_markers", per_marker)),
        F.array_compact(F.transform(ids, per_id)),
    )
    failures = F.when(F.size(shape) > 0, shape).otherwise(rules)
    out = computed_once(df, {"failures": failures}, df.columns)
    return out.withColumn("canonical_citations", F.filter("answer_citations", lambda i: F.array_contains(ok, i)))


def fallback_answer(citations: Column) -> Column:
    """The first three citations as a list, each with its date."""
    def row(c: Column) -> Column:
        date = F.when(c["posted_at"].isNotNull(), F.concat(F.lit("게시일 "), F.date_format(c["posted_at"], "yyyy-MM-dd"))).otherwise(
            F.concat(F.lit("수집일 "), F.date_format(c["fetched_at"], "yyyy-MM-dd"))
        )
        return F.concat(F.lit("- "), F.coalesce(c["category_label_ko"], F.lit("근거")), F.lit(": "), c["title"], F.lit(" ("), date, F.lit(") ["), c["citation_id"], F.lit("]"))

    lines = F.transform(F.slice(citations, 1, FALLBACK_CITATIONS), row)
    return F.array_join(F.concat(F.array(F.lit(FALLBACK_HEAD)), lines, F.array(F.lit(FALLBACK_TAIL))), "\n")


def decide(df: DataFrame, policy_refusal: str) -> DataFrame:
    """O-122: the response per request as one cascade, with the citation objects it shows.

    An answer shows the canonical citation of every id it names, a fallback the
    first three of the evidence, anything else none.  Needs input_action, refusal_tier, confidence, citations, provider_content,
    and for provider answers answer, answer_tier, answer_confidence, failures.
    """
    refused = F.col("input_action") == "refuse"
    no_evidence = F.col("refusal_tier") == "hard_refuse"
    no_answer = F.col("provider_content").isNull()
    valid = F.size("failures") == 0
    unsafe = F.exists("failures", lambda f: F.contains(f, F.lit("output safety rejected")))
    decision = (
        F.when(refused, "policy_refusal").when(no_evidence, "evidence_refusal").when(no_answer, "fallback").when(valid, "answer").when(unsafe, "unsafe_refusal").otherwise("fallback")
    )
    out = computed_once(df, {"decision": decision}, df.columns)
    d = F.col("decision")
    empty_fallback = (d == "fallback") & (F.coalesce(F.size("citations"), F.lit(0)) == 0)
    answer = (
        F.when(d == "policy_refusal", F.lit(policy_refusal)).when(d == "answer", F.col("answer"))
        .when((d == "fallback") & ~empty_fallback, fallback_answer(F.col("citations"))).otherwise(F.lit(HARD_REFUSAL))
    )
    tier = F.when(d == "answer", F.col("answer_tier")).when((d == "fallback") & ~empty_fallback, F.col("refusal_tier")).otherwise("hard_refuse")
    confidence = (
        F.when(d == "answer", F.col("answer_confidence")).when(((d == "fallback") & ~empty_fallback) | (d == "evidence_refusal"), F.col("confidence")).otherwise(0.0)
    )
    validation = (
        F.when(refused, "skipped_input_refusal").when(no_evidence, "skipped_hard_refusal").when(d == "answer", "passed").otherwise("failed")
    )
    named = F.flatten(F.transform("answer_citations", lambda i: F.filter("citations", lambda c: c["citation_id"].cast("bigint") == i)))
    shown = F.when(d == "answer", named).when((d == "fallback") & ~empty_fallback, F.slice("citations", 1, FALLBACK_CITATIONS))
    shown = F.coalesce(shown, F.slice("citations", 1, 0), F.array().cast(df.schema["citations"].dataType))
    snapshot = F.when(refused | no_evidence, "refusal").when(no_answer, "failure").when(d != "answer", "guardrail")
    return out.select(
        *df.columns, "decision", answer.alias("final_answer"), shown.alias("final_citations"), tier.alias("final_tier"), confidence.alias("final_confidence"),
        validation.alias("output_validation"), snapshot.alias("prompt_snapshot_reason"),
    )


def query_hash(query: Column | str, action: Column | str, sanitized: Column | str) -> Column:
    """O-124: hash of the query; of its redacted safety form unless the action is allow."""
    return F.sha2(F.when(T.col(action) == "allow", T.col(query)).otherwise(T.redact_personal_data(sanitized)), 256)


RETRIEVED = "array<struct<chunk_id:string,record_id:string,source_id:string,score:double,normalized_score:double>>"


def audit_rows(decided: DataFrame, timestamp: Column, response_timestamp: Column, model_config: Column | None = None, key: str = "query_id") -> DataFrame:
    """O-124: audit table of decided requests, with every field of a record.

    Optional columns of ``decided`` are used where they are: ``retrieved_chunks``,
    ``source_action``, ``source_categories``, ``unsafe_chunk_ids`` and
    ``provider_error``.  A request that was refused at its input retrieved nothing.
    ``prompt_snapshot`` is never stored here.
    """
    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in decided.columns else F.lit(None).cast(kind)

    used = F.when(F.col("decision") == "answer", F.col("answer_citations")).otherwise(F.array().cast("array<bigint>"))
    went_on = F.col("decision") != "policy_refusal"
    failed = (F.col("output_validation") == "failed") & (F.size("failures") > 0)
    guardrails = F.to_json(
        F.struct(
            F.lit(True).alias("context_isolation"), F.lit(True).alias("input_sanitized"), F.lit(INPUT_POLICY_VERSION).alias("input_safety_policy_version"),
            F.col("input_action").alias("input_safety_action"), F.col("input_categories").alias("input_safety_categories"),
            F.when(went_on, F.col("refusal_tier")).alias("evidence_policy"), F.when(went_on, given("source_action", "string")).alias("source_safety_action"),
            F.when(went_on, given("source_categories", "array<string>")).alias("source_safety_categories"), F.when(went_on, given("unsafe_chunk_ids", "array<string>")).alias("source_safety_unsafe_chunk_ids"),
            "output_validation", F.when(failed, F.col("failures")).alias("output_validation_failures"), given("provider_error", "string").alias("provider_error"),
        )
    )
    retrieved = F.when(went_on, given("retrieved_chunks", RETRIEVED))
    return decided.select(
        F.sha2(F.col(key), 256).alias("trace_id"), timestamp.alias("timestamp"), response_timestamp.alias("response_timestamp"),
        F.coalesce(retrieved, F.array().cast(RETRIEVED)).alias("retrieved_chunks"), (model_config if model_config is not None else F.lit(None).cast("string")).alias("model_config"), query_hash("query", "input_action", "sanitized_query").alias("query_hash"), F.col("final_tier").alias("refusal_tier"),
        F.lit(PROMPT_VERSION).alias("prompt_version"), used.alias("citation_ids"), guardrails.alias("guardrail_results"), "prompt_snapshot_reason",
    )


def audit_rules() -> list[tuple[str, Column, str]]:
    """M15: a stored snapshot needs a reason and is forbidden on normal answers."""
    has = F.col("prompt_snapshot").isNotNull()
    return [
        ("query_hash_hex", F.col("query_hash").rlike("^[a-f0-9]{64}$"), "query_hash must be a SHA-256 hex digest"),
        ("tier_known", F.col("refusal_tier").isin(*TIERS), "unknown refusal_tier"),
        ("snapshot_reason", ~has | F.col("prompt_snapshot_reason").isNotNull(), "prompt_snapshot_reason is required when prompt_snapshot is stored"),
        ("no_snapshot_on_answer", ~(has & (F.col("refusal_tier") == "normal_answer")), "normal answers must not store prompt snapshots by default"),
        ("snapshot_length", F.coalesce(F.length("prompt_snapshot"), F.lit(0)) <= 2000, "prompt_snapshot is too long"),
    ]
