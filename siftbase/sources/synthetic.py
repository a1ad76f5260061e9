"""O-20: scale corpus and its queries, by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftbase.schemas import CATEGORY_LABELS, TRUST_LABEL, lookup

# --- fixed values -----------------------------------------------------------
# category, Korean words, English word
SIGNALS = {
    "job_posting": ("채용공고", "채용정보 일반채용", "job-posting"),
    "career_review": ("취업후기", "취업성공후기 합격후기", "career-review"),
    "internship_notice": ("현장실습 안내", "현장실습 인턴채용", "internship-notice"),
    "internship_review": ("현장실습 후기", "현장실습 후기", "internship-review"),
    "career_program": ("취업 프로그램", "취업프로그램 직무부트캠프", "career-program"),
    "guide": ("가이드", "가이드북 진로설계", "guide"),
    "notice": ("공지사항", "공지사항 상담예약", "notice"),
    "source_discovery": ("출처 탐색", "출처 탐색 경력개발", "source-discovery"),
    "unknown_legacy": ("기존 분류 미확인", "기존 분류 미확인", "legacy-unknown"),
}
MODULI = {"active": 11, "expired": 13, "token": 997}
# ----------------------------------------------------------------------------


def synthetic_chunks(spark: SparkSession, n: int, families: Sequence[str]) -> DataFrame:
    categories = list(CATEGORY_LABELS)
    i = F.col("id")
    nth = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    base = spark.range(n).select(i, nth(categories, i % len(categories)).alias("collection_category"), nth(families, i % len(families)).alias("source_family"))
    part = lambda k: lookup({c: v[k] for c, v in SIGNALS.items()}, "collection_category")
    status = F.when(i % MODULI["active"] == 0, "active").when(i % MODULI["expired"] == 0, "expired").otherwise("unknown")
    url = F.concat_ws("/", F.lit("https://example.com/kb-benchmark"), "source_family", "collection_category", i)
    number = F.when(i < 1_000_000, F.lpad(i.cast("string"), 6, "0")).otherwise(i.cast("string"))
    return base.select(
        F.concat(F.lit("synthetic-chunk-"), number).alias("chunk_id"), F.concat(F.lit("synthetic-record-"), number).alias("record_id"),
        F.concat_ws("-", F.lit("synthetic"), "source_family", "collection_category").alias("source_id"), F.concat_ws(" ", F.lit("Synthetic"), "source_family", part(0)).alias("source_name"),
        url.alias("source_url"), url.alias("canonical_url"), F.concat(part(0), F.lit(" synthetic scale record "), i).alias("title"), part(0).alias("category"),
        "collection_category", "source_family", lookup(CATEGORY_LABELS, "collection_category").alias("category_label_ko"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit(None).cast("timestamp").alias("posted_at"), status.alias("deadline_status"),
        F.when(status == "active", "상시 모집").otherwise("").alias("deadline_raw_text"), F.lpad(F.lower(F.hex(i)), 64, "0").alias("content_hash"),
        F.array(F.struct(url.alias("url"), F.concat(F.lit("Synthetic benchmark citation "), i).alias("label"), F.lit(None).cast("int").alias("page_number"))).alias("citation_anchors"),
        F.lit(TRUST_LABEL).alias("source_text_trust"), F.lit(0).alias("chunk_ordinal"),
        F.concat(part(1), F.lit(" "), part(2), F.lit(" source-"), "source_family", F.lit(" category-"), "collection_category", F.lit(" retrieval-token-"), i % MODULI["token"]).alias("text"),
    )


def synthetic_queries(spark: SparkSession, n: int, families: Sequence[str], filtered: bool) -> DataFrame:
    categories = list(CATEGORY_LABELS)
    i = F.col("id")
    nth = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    q = spark.range(n).withColumn("c", nth(categories, i % len(categories))).withColumn("f", nth(families, i % len(families)))
    text = F.concat_ws(" ", lookup({c: v[1] for c, v in SIGNALS.items()}, "c"), lookup({c: v[2] for c, v in SIGNALS.items()}, "c"))
    none = F.lit(None).cast("array<string>")
    return q.select(
        F.concat(F.lit("q"), F.lpad(i.cast("string"), 4, "0")).alias("query_id"), text.alias("query"), F.lit(10).alias("top_k"),
        (F.array("c") if filtered else none).alias("collection_categories"), (F.array("f") if filtered else none).alias("source_families"),
    )
