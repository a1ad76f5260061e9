"""Source registry: access gate, gate report, registry verification, dataset precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.session import broadcast_if_small

# --- fixed values -----------------------------------------------------------
OBSERVATION_TYPES = ("category_discovery", "document_viewer")
REQUIRED_METHOD = {
    "public_html": "approved_bounded_browser_discovery",
    "manual_pdf_download": "approved_manual_download",
    "manual_login_session": "approved_user_manual_login_session",
    "structure_observation_only": "manual_discovery_only",
}
CONTENT_FOR_METHOD = {"public_html": "html", "manual_pdf_download": "pdf", "manual_login_session": "html"}
# ----------------------------------------------------------------------------


def access_decision(method: Column | str = "requested_method") -> list[Column]:
    """O-68: columns status, collection_method, reasons, auth_boundary over a registry row and a requested method."""
    c = F.col
    method = c(method) if isinstance(method, str) else method
    observation = c("source_type").isin(*OBSERVATION_TYPES)
    unreviewed = c("review_status") != "reviewed"
    blocked = (c("review_status") == "blocked") | (c("approval_status") == "blocked")
    required = F.coalesce(*[F.when(method == m, F.lit(r)) for m, r in REQUIRED_METHOD.items()])

    def wrong_content(m: str, wanted: str) -> Column:
        return F.when((method == m) & (c("content_type") != wanted), F.concat(F.lit(f"requested method mismatch: {m} cannot collect "), c("content_type")))

    reasons = F.array_compact(
        F.array(
            F.when(unreviewed, F.concat(F.lit("source not reviewed: review_status is "), c("review_status"))),
            F.when(blocked, "source is blocked by registry review status"),
            F.when(
                c("allowed_collection_method") != required,
                F.concat(F.lit("unapproved collection method: "), c("allowed_collection_method"), F.lit(" does not allow requested "), method),
            ),
            F.when(c("allowed_collection_method") == "none_until_review", "collection method is none_until_review until human access review is complete"),
            F.when(c("scheduled_crawling_enabled"), "scheduled_crawling_enabled must remain false for ingestion access"),
            *[wrong_content(m, wanted) for m, wanted in CONTENT_FOR_METHOD.items()],
            F.when(
                (method == "manual_login_session") & (c("auth_mode") != "user_manual_login_nonpersistent"),
                "manual_login_session requires auth_mode user_manual_login_nonpersistent",
            ),
            F.when(
                (method == "structure_observation_only") & ~observation,
                F.concat(F.lit("requested method mismatch: structure observation is not the parser method for "), c("source_type")),
            ),
            F.when(observation & unreviewed, "source remains structure-observation-only until explicit approval evidence exists"),
        )
    )
    boundary = (
        F.when(blocked, "blocked")
        .when(c("auth_required") | (c("auth_mode") == "env_credentials"), "login_required")
        .when(c("auth_mode") == "unknown", "unknown")
        .otherwise("public")
    )
    return [
        F.when(F.size(reasons) == 0, "allowed").otherwise("blocked").alias("status"),
        F.when(observation & unreviewed, "structure_observation_only").otherwise(method).alias("collection_method"),
        reasons.alias("reasons"),
        boundary.alias("auth_boundary"),
    ]


def gate_report(seeds: DataFrame, registry: DataFrame) -> DataFrame:
    """O-69, O-70: decision per seed (source_id, requested_method); an unregistered source is an error row."""
    known = broadcast_if_small(registry.withColumn("_known", F.lit(True)))
    joined = seeds.join(known, "source_id", "left")
    status, method, reasons, boundary = access_decision()
    missing = F.col("_known").isNull()
    return joined.select(
        "source_id", "requested_method",
        F.when(missing, "error").otherwise(status).alias("status"),
        F.when(~missing, method).alias("collection_method"),
        F.when(missing, F.array(F.concat(F.lit("Source not found in registry: "), "source_id"))).otherwise(reasons).alias("reasons"),
        F.when(~missing, boundary).alias("auth_boundary"),
    )


def verify_registry(registry: DataFrame, required: DataFrame) -> DataFrame:
    """O-131: failures (source_id, message)."""
    checks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("scheduled_crawling_enabled"), F.lit(True)), "scheduled_crawling_enabled other than false"),
            F.when(F.coalesce(F.col("approval_basis"), F.lit("")) != "user_assertion", "lacks approval_basis: user_assertion"),
            *[F.when(F.coalesce(F.col(n), F.lit("")) == "", f"lacks {n}") for n in ("review_status", "allowed_collection_method", "checklist_reference")],
        )
    )
    own = registry.select("source_id", F.explode(checks).alias("message"))
    absent = required.join(registry, "source_id", "left_anti").select("source_id", F.lit("missing required seed source").alias("message"))
    repeated = registry.groupBy("source_id").count().filter("count > 1").select("source_id", F.lit("duplicate source_id").alias("message"))
    return own.unionByName(absent).unionByName(repeated)


def dataset_states(datasets: DataFrame) -> DataFrame:
    """O-04: (id, family, kind in default/split/legacy, has_chunks) to a state; a legacy root counts only without any split."""
    any_split = F.max((F.col("kind") == "split") & F.col("has_chunks")).over(Window.partitionBy("family"))
    kind, has = F.col("kind"), F.col("has_chunks")
    state = (
        F.when(kind == "default", "active")
        .when((kind == "split") & has, "active")
        .when((kind == "legacy") & has & ~any_split, "legacy_fallback")
        .otherwise("disabled")
    )
    return datasets.withColumn("state", state)


def loadable(datasets: DataFrame) -> DataFrame:
    return dataset_states(datasets).filter(F.col("state").isin("active", "legacy_fallback"))
