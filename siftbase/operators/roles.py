"""Role-aware retrieval: one query fans out to category plans, results are merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.operators.retrieve import FEATURES, MAX_TOP_K, retrieve, with_defaults

# --- fixed values -----------------------------------------------------------
INTERNSHIP = "인턴|인턴십|현장실습|실습"
CAREER = "취업|커리어|진로|백엔드|프론트엔드|개발자|디자인|기획"
MIXED_CUES = "고민|준비|조언|추천|기회|활동|학년|세부분야|못 정|못정|좋을|뭘 보면|뭐 보면|무엇을 보면|어떻게"
OPPORTUNITY_CUES = "공고|채용|모집|추천|지원|기회|프로그램|인턴|현장실습|뭘 보면|뭐 보면|무엇을 보면"
ADVICE_CUES = "후기|경험|면접|조언|준비|고민|팁|사례|선배|세부분야|세부 분야|못 정|못정|활동"
PROCEDURE_CUES = "방법|절차|신청|예약|상담|첨삭|가이드|어디|확인|이용|활동|준비|고민|세부분야|세부 분야"
OPPORTUNITY = ("job_posting", "career_program")
INTERNSHIP_OPPORTUNITY = ("job_posting", "career_program", "internship_notice")
ADVICE = ("career_review", "internship_review")
PROCEDURE = ("guide", "notice")
# ----------------------------------------------------------------------------


def intent(query: Column | str) -> Column:
    """O-73: six flags of a query."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    general = q.rlike(CAREER)
    return F.struct(
        (q.rlike(OPPORTUNITY_CUES) | general).alias("opportunity"),
        q.rlike(ADVICE_CUES).alias("advice"),
        q.rlike(PROCEDURE_CUES).alias("procedure"),
        q.rlike(INTERNSHIP).alias("internship"),
        general.alias("career_general"),
        (general & q.rlike(MIXED_CUES)).alias("mixed_career_advice"),
    )


def internship_signal(query: Column, employment_type: Column) -> Column:
    """O-74."""
    return F.lower(F.concat_ws(" ", query, employment_type)).rlike(INTERNSHIP)


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def role_plans(queries: DataFrame) -> DataFrame:
    """One row per (query, plan): category list and per-plan k, then the plain query as the last plan."""
    q = with_defaults(queries).withColumn("_i", intent("query"))
    split = F.col("_i.mixed_career_advice") & F.col("collection_categories").isNull()
    plans = F.array_compact(
        F.array(
            F.when(F.col("_i.opportunity"), F.when(F.col("_i.internship"), _names(INTERNSHIP_OPPORTUNITY)).otherwise(_names(OPPORTUNITY))),
            F.when(F.col("_i.advice"), _names(ADVICE)),
            F.when(F.col("_i.procedure"), _names(PROCEDURE)),
        )
    )
    plans = F.when(split, plans).otherwise(F.array().cast("array<array<string>>"))
    per_plan = F.least(F.lit(MAX_TOP_K), F.greatest(F.lit(2), F.ceil(F.col("top_k") / F.greatest(F.size(plans), F.lit(1))).cast("int") + 1))
    role_rows = F.transform(plans, lambda cats, i: F.struct(i.alias("plan"), cats.alias("categories"), per_plan.alias("k")))
    plain = F.array(F.struct(F.lit(99).alias("plan"), F.col("collection_categories").alias("categories"), F.col("top_k").alias("k")))
    rows = q.withColumn("_p", F.explode(F.concat(role_rows, plain)))
    return rows.select(
        F.struct("query_id", F.col("_p.plan").alias("plan"), F.col("top_k").alias("k")).alias("_owner"),
        F.concat_ws("#", "query_id", F.col("_p.plan")).alias("query_id"),
        "query",
        F.col("_p.k").alias("top_k"),
        F.col("_p.categories").alias("collection_categories"),
        "source_families", "source_ids", "deadline_statuses",
    )


def retrieve_by_role(index: DataFrame, queries: DataFrame, ref_ts: Column, search: Callable[..., DataFrame] = retrieve, **options) -> DataFrame:
    """O-109: run all plans of all queries in one retrieval, then merge per query."""
    plans = role_plans(queries)
    found = search(index, plans.drop("_owner"), ref_ts, **options)
    owners = plans.select("query_id", "_owner")
    lists = found.join(owners, "query_id").select(
        F.col("_owner.query_id").alias("query_id"), F.col("_owner.k").alias("top_k"),
        (F.col("_owner.plan") * 100 + F.col("rank")).alias("pos"), "chunk_id", "score", "normalized_score", *FEATURES,
    )
    return merge_lists(lists)


def merge_lists(lists: DataFrame) -> DataFrame:
    """O-106: a chunk keeps its first position but its best-scored row (the earlier one on ties)."""
    payload = [c for c in lists.columns if c not in ("query_id", "chunk_id", "top_k", "pos")]
    merged = lists.groupBy("query_id", "chunk_id", "top_k").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct(*payload), F.struct(F.col("score"), -F.col("pos"))).alias("row")
    )
    order = Window.partitionBy("query_id").orderBy("pos")
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("top_k"))
    return ranked.select("query_id", "chunk_id", "rank", "row.*")
