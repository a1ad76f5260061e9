"""Integrity: rule tables, duplicates, orphans, alignment, manifest, freshness, taxonomy back-fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import urls as U
from siftbase.schemas import DEADLINE_STATUSES, TRUST_LABEL, Taxonomy, lookup
from siftbase.session import broadcast_if_small, salted_join

Rule = tuple[str, Column, str]


def failures(rules: Sequence[Rule]) -> Column:
    """Messages of the rules whose condition does not hold; an unknown condition counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for _, ok, message in rules]))


def rule_report(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """O-77: one row per (key, failed rule)."""
    hits = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, ok, m in rules]))
    return df.select(F.col(key), F.inline(hits))


def _filled(*names: str) -> list[Rule]:
    return [(f"{n}_filled", F.length(n) > 0, f"{n} must not be empty") for n in names]


def anchors_valid(anchors: Column) -> Column:
    """https links with a label; a page anchor needs its page number."""

    def ok(a: Column) -> Column:
        page_ok = a["page_number"].isNull() | (a["page_number"] > 0)
        paged = ~F.contains(a["url"], F.lit("#page=")) | a["page_number"].isNotNull()
        return U.is_https(a["url"]) & (F.length(a["label"]) > 0) & page_ok & paged

    return (F.size(anchors) > 0) & F.forall(anchors, ok)


def record_rules(taxonomy: Taxonomy | None = None) -> list[Rule]:
    t = taxonomy or Taxonomy()
    rules = [
        *_filled("record_id", "source_id", "source_name", "title", "category"),
        ("source_url_https", U.is_https("source_url"), "source_url must use https"),
        ("canonical_url_https", U.is_https("canonical_url"), "canonical_url must use https"),
        ("collection_category_known", F.col("collection_category").isin(*t.category_labels), "unknown collection_category"),
        ("category_label_matches", F.col("category_label_ko") == lookup(t.category_labels, "collection_category"), "category_label_ko must match collection_category"),
        ("fetched_at_present", F.col("fetched_at").isNotNull(), "fetched_at must be a timestamp"),
        ("deadline_status_known", F.col("deadline_status").isin(*DEADLINE_STATUSES), "unknown deadline_status"),
        ("deadline_raw_text_present", F.col("deadline_raw_text").isNotNull(), "deadline_raw_text must be present"),
        ("content_hash_hex", F.col("content_hash").rlike("^[a-f0-9]{64}$"), "content_hash must be a SHA-256 hex digest"),
        ("anchors_valid", anchors_valid(F.col("citation_anchors")), "citation_anchors must be valid and not empty"),
        ("source_text_trust", F.col("source_text_trust") == TRUST_LABEL, f"source_text_trust must be {TRUST_LABEL}"),
    ]
    if t.source_families:
        rules.append(("source_family_known", F.col("source_family").isin(*t.source_families), "unknown source_family"))
    return rules


def chunk_rules(taxonomy: Taxonomy | None = None) -> list[Rule]:
    return [*record_rules(taxonomy), *_filled("chunk_id", "text"), ("chunk_ordinal_from_0", F.col("chunk_ordinal") >= 0, "chunk_ordinal must not be negative")]


def duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    """O-93: every repeat of a key with its own and the first position."""
    firsts = df.groupBy(key).agg(F.min(position).alias("first_position"), F.count("*").alias("copies")).filter("copies > 1")
    joined = salted_join(df.select(key, F.col(position).alias("position")), firsts, key, "position")
    return joined.filter("position > first_position").select(key, "position", "first_position")


def keep_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """O-87: the first row of each key; the cut runs inside each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def orphans(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """O-82: chunks whose record is missing.  The anti-join sees each record id once, however many chunks it has."""
    wanted = chunks.groupBy("record_id").agg(F.count("*").alias("n_chunks"))
    return wanted.join(_known(records), "record_id", "left_anti")


def _known(records: DataFrame) -> DataFrame:
    """Distinct record ids; there are as many as records, so they are never sent through the driver, however small their file looks."""
    return records.select("record_id").distinct().hint("merge")


def orphan_rows(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """The chunks that name a missing record; a null names none.  Tasks with a hot id are split by the adaptive skew join."""
    return chunks.where(F.col("record_id").isNotNull()).join(_known(records), "record_id", "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-92, O-107: ids on one side only, with the side that has them."""
    l, r = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = l.join(r, key, "full_outer").filter("in_left is null or in_right is null")
    return both.select(key, F.when(F.col("in_left"), "left").otherwise("right").alias("only_in"))


def manifest_summary(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """O-66: one row of counts and count-by maps.  Id lists stay a table (``manifest_ids``)."""
    sets = records.groupingSets(
        [[], ["collection_category"], ["source_family"], ["deadline_status"]], "collection_category", "source_family", "deadline_status"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))

    def counts(bits: int, column: str) -> Column:
        entries = F.array_compact(F.collect_list(F.when(F.col("g") == bits, F.struct(F.col(column).alias("key"), F.col("n").alias("value")))))
        return F.map_from_entries(F.array_sort(entries))

    summary = sets.agg(
        F.coalesce(F.sum(F.when(F.col("g") == 7, F.col("n"))), F.lit(0)).alias("record_count"),
        counts(3, "collection_category").alias("collection_category_counts"),
        counts(5, "source_family").alias("source_family_counts"),
        counts(6, "deadline_status").alias("deadline_status_counts"),
    )
    return summary.withColumn("chunk_count", chunks.agg(F.count("*").alias("n")).scalar())


def manifest_ids(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest's id lists as rows (kind, id): a list of all ids would not fit one row."""
    parts = [
        records.select(F.lit("record_id").alias("kind"), F.col("record_id").alias("id")),
        chunks.select(F.lit("chunk_id").alias("kind"), F.col("chunk_id").alias("id")),
        records.select(F.lit("source_id").alias("kind"), F.col("source_id").alias("id")).distinct(),
        records.select(F.lit("fetched_at").alias("kind"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("id")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alignment(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """O-05: per kind, whether counts and id sets agree between the manifest's (kind, id) and the present ids."""
    m = manifest.groupBy("kind", "id").agg(F.count("*").alias("m"))
    p = present.groupBy("kind", "id").agg(F.count("*").alias("p"))
    both = m.join(p, ["kind", "id"], "full_outer")
    return both.groupBy("kind").agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("manifest_count"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("present_count"),
        F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("m").isNull()).alias("unexpected"),
    )


def snapshot_stats(chunks: DataFrame) -> DataFrame:
    """O-90: chunk count, distinct sources and two count maps."""
    sets = chunks.groupingSets([["collection_category"], ["source_family"]], "collection_category", "source_family").agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )

    def counts(bits: int, column: str) -> Column:
        entries = F.array_compact(F.collect_list(F.when(F.col("g") == bits, F.struct(F.col(column).alias("key"), F.col("n").alias("value")))))
        return F.map_from_entries(F.array_sort(entries))

    maps = sets.agg(counts(1, "collection_category").alias("collection_category_counts"), counts(2, "source_family").alias("source_family_counts"))
    totals = chunks.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("sources"))
    return maps.withColumn("chunk_count", totals.select("chunks").scalar()).withColumn("source_count", totals.select("sources").scalar())


def source_freshness(records: DataFrame, chunks: DataFrame, manifests: DataFrame, ref_ts: Column, stale_after_days: int = 14) -> DataFrame:
    """O-91: newest fetch per source over records, chunks and manifest rows (source_id, fetched_at)."""
    zero = F.lit(0)
    inputs = (
        records.select("source_id", "fetched_at", F.lit(1).alias("r"), zero.alias("c"), zero.alias("m"))
        .unionByName(chunks.select("source_id", "fetched_at", zero.alias("r"), F.lit(1).alias("c"), zero.alias("m")))
        .unionByName(manifests.select("source_id", "fetched_at", zero.alias("r"), zero.alias("c"), F.lit(1).alias("m")))
    )
    per_source = inputs.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_successful_ingestion"), F.sum("r").alias("record_count"), F.sum("c").alias("chunk_count"), F.sum("m").alias("_m")
    )
    age = (F.unix_micros(ref_ts) - F.unix_micros("last_successful_ingestion")) / F.lit(86_400_000_000.0)
    status = F.when(F.col("last_successful_ingestion").isNull(), "unknown").when(age > stale_after_days, "stale").otherwise("fresh")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_m") == 0, "missing or invalid manifest"),
            F.when(F.col("last_successful_ingestion").isNull(), "unknown freshness timestamp"),
            F.when(F.col("chunk_count") == 0, "no chunks found for source"),
            F.when(status == "stale", f"last ingestion is older than {stale_after_days} days"),
        )
    )
    return per_source.select("source_id", "last_successful_ingestion", "record_count", "chunk_count", status.alias("status"), warnings.alias("warnings"))


def backfill_taxonomy(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """O-83: rows without any taxonomy field take it from (source_id, category); no mapping gives a failure text."""
    names = ["collection_category", "source_family", "category_label_ko"]
    legacy = F.coalesce(*names).isNull()
    m = mapping.select("source_id", "category", *[F.col(n).alias(f"_m_{n}") for n in names], F.lit(True).alias("_known"))
    joined = df.join(broadcast_if_small(m), ["source_id", "category"], "left")
    out = joined.select(
        *[c for c in df.columns if c not in names],
        *[F.when(legacy, F.col(f"_m_{n}")).otherwise(F.col(n)).alias(n) for n in names],
        F.when(legacy & F.col("_known").isNull(), F.concat(F.lit("missing legacy taxonomy mapping for "), "source_id", F.lit(" / "), "category")).alias("failure"),
    )
    return out


def merge_by_id(batches: DataFrame, key: str, batch: str, position: str) -> DataFrame:
    """O-09: the last write of each id wins."""
    w = Window.partitionBy(key).orderBy(F.col(batch).desc(), F.col(position).desc())
    return batches.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def verify_knowledge_base(records: DataFrame, chunks: DataFrame, manifest: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """O-130: all failures as rows (check, subject, message); an empty result means verified."""
    def rows(df: DataFrame, check: str, subject: str, message: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"), message.alias("message"))

    present = manifest_ids(records, chunks)
    off = alignment(manifest, present).filter("missing > 0 or unexpected > 0 or manifest_count <> present_count")
    parts = [
        rows(rule_report(records, "record_id", record_rules(taxonomy)), "record", "record_id", F.col("message")),
        rows(rule_report(chunks, "chunk_id", chunk_rules(taxonomy)), "chunk", "chunk_id", F.col("message")),
        rows(orphan_rows(chunks, records), "orphan", "chunk_id", F.concat(F.lit("references missing record_id "), "record_id")),
        rows(records.groupBy("record_id").count().filter("count > 1"), "duplicate", "record_id", F.lit("duplicate record_id")),
        rows(chunks.groupBy("chunk_id").count().filter("count > 1"), "duplicate", "chunk_id", F.lit("duplicate chunk_id")),
        rows(off, "manifest", "kind", F.lit("manifest ids do not align")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
