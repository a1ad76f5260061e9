"""Mixing sources to target weights: systematic sampling over prefix sums.

Every row of a source has the same expected number of copies, the source's
target over its size.  The rows of a source stand in order of falling size, so
that each stretch of the running sum holds texts of like size; one random
offset per source is added, and a row is emitted once for each whole number that
the running sum crosses on it.

Nothing is gathered: running sums are taken over range partitions and their
totals, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.llm.common import broadcast_hot
from siftbase.llm.registry import query, table
from siftbase.session import written

WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in order of their names, repeated; a source gives at most CAP times its size.
WEIGHTS, CAP, SEED = (1, 2, 3), 3, 7

OUTPUT = ("size", "source_size", "target", "taken")


def _key(doc_id: str, source: str, text: str) -> Column:
    """Digest of a row's id, source and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, source, text)]
    return F.md5(F.concat(parts[0], F.lit("\x1f"), parts[1], F.lit("\x1f"), parts[2]).cast("binary"))


def running_sums(rows: DataFrame, group: str, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """Add the running sum of each value within ``group`` in ``order``, this row included; ``group`` holds no null."""
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = rows.withColumns(dict(zip(keys, order, strict=True)) | values)
    ranged = written(ranged.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id()), name)
    totals = ranged.groupBy("_part", group).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", group, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    local = Window.partitionBy("_part", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({v: F.sum(v).over(local) for v in values}).join(offsets, ["_part", group])
    return summed.withColumns({v: F.col(v) + F.col(f"_before_{v}") for v in values}).drop("_part", *keys, *[f"_before_{v}" for v in values])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to one row per source (``_group``, ``source``, ``source_size``).

    The level at which weighted shares meet the total is found in closed form:
    sources in order of cap over weight reach their cap one after the other, and
    the first that stays below fixes the level for the rest.
    """
    placed = running_sums(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("source").isNull(), F.col("source")], {"_place": F.lit(1).cast("bigint")}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    weighted = placed.withColumn("_weight", weight).withColumn("_cap", cap * F.col("source_size")).drop("_place")
    filled = written(running_sums(weighted, "_all", [F.col("_cap") / F.col("_weight"), F.col("_group")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")}, "levels"), "filled")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    if not whole.weight:
        return filled.select("_group", "source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    level = (F.lit(whole.size) - (F.col("_caps") - F.col("_cap"))) / (F.lit(whole.weight) - (F.col("_weights") - F.col("_weight")))
    ratio = F.col("_cap") / F.col("_weight")
    found = filled.where(level <= ratio).agg(F.min(F.struct(ratio.alias("r"), F.col("_group"), level.alias("level"))).alias("first")).first().first
    target = F.least(F.col("_cap").cast("double"), F.lit(float(found.level)) * F.col("_weight"))
    return filled.select("_group", "source", "source_size", "n_docs", target.alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``_key`` (digest of id, source and text), id, ``size``, ``source_size``, ``target``, ``_copies``, ``taken``.

    Size is the number of words, 0 for a null text.  Null is a source of its
    own, after the others.  A source without words has target 0.  Equal rows are
    interchangeable, so a rerun gives the same copies for the same texts.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _key(doc_id, source, text).alias("_key"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_group"),
    )
    rows = written(rows, "sizes")
    sizes = rows.groupBy("_group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wanted = written(targets(sizes).drop("source"), "targets")
    placed = running_sums(rows, "_group", [-F.col("size"), F.col("doc_id"), F.col("_key")], {"_place": F.lit(1).cast("bigint")}, "places")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_group")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    met = broadcast_hot(placed, wanted, "_group", "n_docs", rows.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("_rate") * F.col("_place") + F.col("_offset")) - F.floor(F.col("_rate") * (F.col("_place") - 1) + F.col("_offset"))
    out = met.withColumn("_rate", rate).withColumn("_offset", offset).withColumn("_copies", copies)
    return out.select("_key", "doc_id", "size", "source_size", "target", "_copies", (F.col("_copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns.  Rows with 0 copies are gone."""
    plan = mix_plan(docs, text, doc_id, source, seed)
    per_key = plan.groupBy("_key").agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    met = docs.withColumn("_key", _key(doc_id, source, text)).join(per_key, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    own = F.expr("_copies div _rows") + F.when(F.col("_nth") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return met.withColumn("_nth", nth).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select(*docs.columns)


_SQL = rf"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) AS key_,
         coalesce('s' || source, '') AS grp
  FROM documents
), sizes AS (
  SELECT grp, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY grp
), weighted AS (
  SELECT *, {CAP} * source_size AS cap, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS weight FROM sizes
), filled AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () - (sum(cap) OVER w - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, grp)
), lvl AS (
  SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, grp LIMIT 1
), targets AS (
  SELECT grp, source_size, least(cap::DOUBLE, (SELECT level FROM lvl) * weight) AS target FROM filled
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY r.grp ORDER BY r.size DESC, r.doc_id, r.key_) AS place,
         ('0x' || substr(md5('{SEED}:' || r.grp), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM rows_ r JOIN targets t USING (grp)
)
SELECT doc_id, size, source_size, target, (floor(rate * place + off) - floor(rate * (place - 1) + off))::BIGINT * size AS taken FROM placed
"""


@query("op5_mixing", _SQL)
def op5_mixing(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("_key", "_copies")
