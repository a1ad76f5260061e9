"""Keyed state in batch form: session references, preferences, audit counts, display lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import dates as D
from siftbase.session import positions, salted_join

PREFERENCE_FIELDS = ("major", "target_role", "industry", "region", "employment_type", "deadline_sensitivity")


def session_references(events: DataFrame, order: list[str]) -> DataFrame:
    """O-133: one row per (session, url).  Works on a batch and, unchanged, on a stream.

    The first filled title, label and dates stay; the status is replaced only
    while it is unknown; counts add up; the last time and query win.
    """
    at = F.struct(*order)
    url = F.trim("url")

    def first_where(value: str, ok: Column) -> Column:
        return F.min_by(F.when(ok, F.col(value)), F.when(ok, at))

    rows = events.withColumn("url", url).filter(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("deadline_status", D.relabel_status("deadline_status"))
    known = F.col("deadline_status") != "unknown"
    return rows.groupBy("session", "url").agg(
        F.coalesce(first_where("title", F.col("title") != ""), F.lit("")).alias("title"),
        F.coalesce(first_where("source_label", F.col("source_label") != ""), F.lit("")).alias("source_label"),
        first_where("posted_at", F.col("posted_at").isNotNull()).alias("posted_at"),
        first_where("fetched_at", F.col("fetched_at").isNotNull()).alias("fetched_at"),
        F.coalesce(first_where("deadline_status", known), F.lit("unknown")).alias("deadline_status"),
        F.min("at").alias("first_referenced_at"),
        F.max("at").alias("last_referenced_at"),
        F.count("*").alias("reference_count"),
        F.max_by(F.col("last_query"), F.when(F.col("last_query").isNotNull(), at)).alias("last_query"),
    )


def reference_list(references: DataFrame) -> DataFrame:
    """O-105: display order per session: last use first, then title in Korean order."""
    order = [F.col("last_referenced_at").desc(), F.collate("title", "ko"), F.col("url")]
    return positions(references, ["session"], order)


def list_view(items: DataFrame, view: str, keys: list[str]) -> DataFrame:
    """O-76: items of each list in the order of a view; a list holds the results of one request.

    "recommended" leaves out general items, "closing" keeps active ones and shows
    the newest first, "by_source" orders by source and title in Korean order.
    """
    newest = [F.col("posted_at").desc_nulls_last(), F.col("fetched_at").desc_nulls_last()]
    status_rank = F.when(F.col("deadline_status") == "active", 0).when(F.col("deadline_status") == "unknown", 1).otherwise(2)
    orders = {
        "recommended": [F.col("score").desc(), "position"],
        "newest": [*newest, "position"],
        "closing": [*newest, "position"],
        "by_source": [F.collate("source_id", "ko"), F.collate("title", "ko"), F.col("position")] if view == "by_source" else [],
        "by_status": [status_rank, "position"],
    }
    kept = {"closing": "deadline_status = 'active'", "recommended": "match_strength <> 'general_recommendation'"}
    rows = items.filter(kept[view]) if view in kept else items
    return rows.withColumn("view_position", F.row_number().over(Window.partitionBy(*keys).orderBy(*orders[view])))


def valid_preference_event() -> Column:
    """Events the store accepts: a set needs both required fields, a persistent write needs full consent."""
    complete = F.col("major").isNotNull() & F.col("target_role").isNotNull()
    consent = F.col("consented_at").isNotNull() & F.col("retention_days").between(1, 365) & F.coalesce(F.col("deletion_supported"), F.lit(False))
    return (F.col("event") == "clear") | ((~F.coalesce(F.col("persist"), F.lit(False)) | consent) & ((F.col("event") != "set") | complete))


def preference_state(events: DataFrame, order: list[str], now: Column) -> DataFrame:
    """O-134: the state per session key at ``now``.

    A set replaces, an update merges field by field, a clear removes.  An update
    without a profile starts one only when it has both required fields.
    A persistent profile lapses when its retention ends: at ``now``, and also
    between two events, after which an update finds nothing to build on.  The
    lapse test needs a time as first order column and looks back one event per
    key in a window that streams; the rest is
    two aggregates with map-side combining and two salted joins, so no task
    holds the events of one key.
    """
    at = F.struct(*order)
    e = events.filter(valid_preference_event()).withColumn("_at", at)
    kept_until = F.when(F.coalesce(F.col("persist"), F.lit(False)) & (F.col("event") != "clear"), F.unix_micros("consented_at") + F.col("retention_days") * 86_400_000_000)
    before = F.lag(kept_until).over(Window.partitionBy("session_key").orderBy(*order))
    timed = events.schema[order[0]].dataType.typeName() == "timestamp"
    e = e.withColumn("_lapsed", F.coalesce(before <= F.unix_micros(F.col(order[0])), F.lit(False)) if timed else F.lit(False))
    resets = e.filter(F.col("event").isin("set", "clear") | F.col("_lapsed")).groupBy("session_key").agg(F.max("_at").alias("_reset"), F.max_by("event", "_at").alias("_kind"))
    spread_key = order[-1]
    after = salted_join(e, resets, "session_key", spread_key, "left").filter(F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset")))
    complete = F.col("major").isNotNull() & F.col("target_role").isNotNull()
    starts = after.groupBy("session_key").agg(
        F.min(F.when(F.col("_kind").eqNullSafe("set"), F.col("_reset")).when((F.col("event") == "update") & complete, F.col("_at"))).alias("_start")
    ).filter(F.col("_start").isNotNull())
    live = salted_join(after, starts, "session_key", spread_key).filter(F.col("_at") >= F.col("_start"))
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in PREFERENCE_FIELDS]
    state = live.groupBy("session_key").agg(
        *last, F.max_by(F.struct("persist", "consented_at", "retention_days"), F.col("_at")).alias("_w")
    )
    persistent = F.coalesce(F.col("_w.persist"), F.lit(False))
    expires = F.timestamp_micros(F.unix_micros("_w.consented_at") + F.col("_w.retention_days") * 86_400_000_000)
    return state.filter(~persistent | (now < expires)).select(
        "session_key", *[F.col(f) for f in PREFERENCE_FIELDS[:-1]], F.coalesce("deadline_sensitivity", F.lit("balanced")).alias("deadline_sensitivity"),
        F.when(persistent, "persistent").otherwise("session").alias("storage_scope"),
    )


def audit_counts(audit: DataFrame, ts: str, tier: str, width: str = "1 hour") -> DataFrame:
    """O-132: rows per tumbling window and tier."""
    return audit.groupBy(F.window(ts, width).alias("w"), F.col(tier)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), tier, "n")
