"""Table schemas and the taxonomy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)

# --- fixed values -----------------------------------------------------------
CATEGORY_LABELS = {
    "job_posting": "채용공고",
    "career_review": "취업후기",
    "internship_notice": "현장실습/인턴십 안내",
    "internship_review": "현장실습 후기",
    "career_program": "취업 프로그램",
    "guide": "가이드",
    "notice": "공지사항",
    "source_discovery": "출처 탐색",
    "unknown_legacy": "기존 분류 미확인",
}
CONTENT_ROLES = {
    "job_posting": "opportunity",
    "career_program": "opportunity",
    "internship_notice": "opportunity",
    "career_review": "advice_evidence",
    "internship_review": "advice_evidence",
    "guide": "procedure_guide",
    "notice": "supporting_context",
    "source_discovery": "supporting_context",
    "unknown_legacy": "supporting_context",
}
DEADLINE_STATUSES = ("active", "expired", "unknown")
TRUST_LABEL = "untrusted_source_text"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Taxonomy:
    """Closed vocabularies; the source families of a site are its own configuration."""

    category_labels: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_LABELS))
    content_roles: dict[str, str] = field(default_factory=lambda: dict(CONTENT_ROLES))
    source_families: tuple[str, ...] = ()


def lookup(mapping: dict[str, str], key: Column | str) -> Column:
    """Total function over a small dict as a map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(key) if isinstance(key, str) else key)


def _s(name: str, nullable: bool = True) -> StructField:
    return StructField(name, StringType(), nullable)


ANCHOR = StructType([_s("url"), _s("label"), StructField("page_number", IntegerType())])
ANCHORS = ArrayType(ANCHOR)

_SHARED_HEAD = [_s(n) for n in ("record_id", "source_id", "source_name", "source_url", "canonical_url", "title", "category",
                                "collection_category", "source_family", "category_label_ko")]
_TIMES = [StructField("fetched_at", TimestampType()), StructField("posted_at", TimestampType()), _s("deadline_status"), _s("deadline_raw_text")]

RECORD = StructType(
    _SHARED_HEAD + _TIMES
    + [_s("raw_text"), _s("cleaned_text"), _s("content_hash"), StructField("citation_anchors", ANCHORS), _s("source_text_trust")]
)
CHUNK = StructType(
    [_s("chunk_id")] + _SHARED_HEAD + _TIMES
    + [_s("content_hash"), StructField("citation_anchors", ANCHORS), _s("source_text_trust"),
       StructField("chunk_ordinal", IntegerType()), _s("text")]
)
MANIFEST = StructType([
    _s("schema_version"), _s("run_id"), _s("collector"), StructField("generated_at", TimestampType()),
    StructField("source_ids", ArrayType(StringType())), StructField("fetched_at", ArrayType(TimestampType())),
    StructField("record_count", LongType()), StructField("chunk_count", LongType()),
    StructField("collection_category_counts", MapType(StringType(), LongType())),
    StructField("source_family_counts", MapType(StringType(), LongType())),
    StructField("deadline_status_counts", MapType(StringType(), LongType())),
    StructField("record_ids", ArrayType(StringType())), StructField("chunk_ids", ArrayType(StringType())),
])
SOURCE_REGISTRY = StructType([
    *[_s(n) for n in ("source_id", "canonical_url", "source_name", "source_type", "content_type", "category", "approval_scope",
                      "approval_basis", "approval_status")],
    StructField("auth_required", BooleanType()),
    *[_s(n) for n in ("auth_mode", "review_status", "allowed_collection_method", "checklist_reference", "robots_status", "tos_status",
                      "rate_limit_posture", "refresh_cadence", "owner_label")],
    StructField("last_checked_at", TimestampType()), StructField("scheduled_crawling_enabled", BooleanType()),
    _s("notes"), _s("next_action"),
])
QUERY = StructType([
    _s("query_id"), _s("query"), StructField("top_k", IntegerType()),
    *[StructField(n, ArrayType(StringType())) for n in ("collection_categories", "source_families", "source_ids", "deadline_statuses")],
])
PROFILE = StructType([
    _s("session_key"), _s("major"), _s("target_role"),
    *[StructField(n, ArrayType(StringType())) for n in ("industry", "region", "employment_type")],
    _s("deadline_sensitivity"),
])
POST_EXPORT = StructType([
    StructField("exported_at", TimestampType()),
    StructField("posts", ArrayType(StructType([_s(n) for n in ("board", "title", "detail_url", "posted_at", "deadline_status",
                                                               "deadline_raw_text", "body_text")]))),
])
