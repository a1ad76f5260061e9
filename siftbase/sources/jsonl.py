"""JSON-lines scans and the knowledge-base sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from siftbase.operators.quality import Rule, chunk_rules, failures, manifest_ids, manifest_summary, orphans, record_rules, rule_report
from siftbase.schemas import Taxonomy
from siftbase.session import written
from siftbase.sources.versions import Versions, exists

CORRUPT = "_corrupt_record"


class ValidationError(ValueError):
    """A load or write found invalid rows; nothing was returned or written."""


INVALID, UNENDED = "invalid JSON", "must end with a final newline"


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-empty lines (``value``, ``_file``, ``_block``, ``_at``), line numbers before each block, and files without a final newline.

    Spark's text source splits a file into blocks of bytes, and a task reads the
    lines of a block in order.  Lines are stored once with the block they start
    in and an ascending number, so a line's number in its file is the number of
    lines in the blocks before, a sum over one row per block, and its place in
    its own block.  A file ends with a line feed if its lines and as many line
    feeds make up its size.  Lines of blanks count; empty ones do not, as in the
    files' own numbering.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("value"), meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), meta["file_size"].alias("_size")
    )
    lines = written(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    filled = F.col("value") != ""
    # empty lines leave gaps in _at, so lines are counted among the filled ones of their block
    blocks = lines.groupBy("_file", "_block").agg(F.count_if(filled).alias("n"), F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"), F.first("_size").alias("_size"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    unended = blocks.groupBy("_file").agg(F.sum("bytes").alias("bytes"), F.first("_size").alias("_size")).where("bytes > _size").select(F.col("_file").alias("file"))
    return lines.where(filled).drop("_size"), starts, unended


def _line_numbers(bad: DataFrame, lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``line`` of failing rows: only the blocks that hold one are numbered."""
    touched = bad.select("_file", "_block").distinct()
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))  # a block is at most a split of the scan
    local = lines.select("_file", "_block", "_at").join(touched, ["_file", "_block"], "left_semi").withColumn("_place", place)
    return bad.join(local, ["_file", "_block", "_at"]).join(starts, ["_file", "_block"]).withColumn("line", F.col("_before") + F.col("_place"))


def scan_jsonl(spark: SparkSession, paths: Sequence[str], schema: StructType, transform: Callable[[DataFrame], DataFrame] | None = None,
               rules: Sequence[Rule] = ()) -> tuple[DataFrame, DataFrame]:
    """O-01, O-03, O-140: valid rows, and failures (file, line, row_hash, message) of JSON-lines files.

    ``line`` counts the non-empty lines of the file from 1, and is null for a
    failure of the file itself.  A line that is no JSON object, one of blanks
    too, is invalid; of a valid one each broken rule is a failure.  A file that
    does not end with a line feed fails, and its rows still count.
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines, starts, unended = numbered_lines(spark, paths)
    rows = lines.withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r").isNull() | (F.trim("value") == "")
    places = ["_file", "_block", "_at"]
    broken = rows.filter(bad).select(*places, F.sha2("value", 256).alias("row_hash"), F.lit(INVALID).alias("message"))
    parsed = rows.filter(~bad).select("_r.*", *places, F.sha2("value", 256).alias("_line")).drop(CORRUPT)
    parsed = transform(parsed) if transform else parsed
    valid = parsed
    if rules:
        checked = parsed.withColumn("_failures", failures(rules))
        invalid = checked.filter(F.size("_failures") > 0).select(*places, F.col("_line").alias("row_hash"), F.explode("_failures").alias("message"))
        broken = broken.unionByName(invalid.withColumn("message", F.concat(F.lit("schema invalid: "), "message")))
        valid = checked.filter(F.size("_failures") == 0).drop("_failures")
    failed = _line_numbers(broken, lines, starts).select(F.col("_file").alias("file"), "line", "row_hash", "message")
    none = F.lit(None)
    files = unended.select("file", none.cast("bigint").alias("line"), none.cast("string").alias("row_hash"), F.lit(UNENDED).alias("message"))
    return valid.drop(*places, "_line"), failed.unionByName(files)


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """O-02: a missing file is an empty table; a line that is no JSON fails the load."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows, bad = scan_jsonl(spark, [path], schema)
    _raise_if_any(bad)
    return rows


def load_or_fail(spark: SparkSession, paths: Sequence[str], schema: StructType, rules: Sequence[Rule] = ()) -> DataFrame:
    """Fail closed: every path must exist and every row must be valid."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise ValidationError("missing: " + ", ".join(missing))
    rows, bad = scan_jsonl(spark, paths, schema, rules=rules)
    _raise_if_any(bad)
    return rows


def _raise_if_any(bad: DataFrame) -> None:
    """The count and a sample reach the driver, never the whole failure table."""
    sample = [" ".join(str(v) for v in r) for r in bad.limit(20).collect()]
    if sample:
        raise ValidationError("; ".join(sample))


def sorted_value(c: Column, t: DataType) -> Column:
    """The value with struct fields and map keys in alphabetical order at every level."""
    if isinstance(t, StructType):
        fields = sorted(t.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[sorted_value(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: sorted_value(x, t.elementType))
    if isinstance(t, MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_value(e["value"], t.valueType).alias("value"))))
    return c


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """O-08: one JSON text per row with sorted keys."""
    names = sorted(columns or df.columns)
    body = F.struct(*[sorted_value(F.col(n), df.schema[n].dataType).alias(n) for n in names])
    return F.to_json(body, {"ignoreNullFields": "false"})


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O-07: range-partitioned and sorted within partitions: file order is key order, without one global sort task."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_knowledge_base(records: DataFrame, chunks: DataFrame, path: str, taxonomy: Taxonomy | None = None) -> int:
    """O-06: check everything, then write records, chunks, ids and summary, and make them one version; its number.

    Inputs are stored first, so that what was checked is what gets written.  The
    tables are written under names that nothing reads yet, and one manifest makes
    all of them count at once: a failure before leaves the base as it was.
    """
    spark = records.sparkSession
    records, chunks = written(records, "records"), written(chunks, "chunks")
    _raise_if_any(rule_report(records, "record_id", record_rules(taxonomy)).select("record_id", "message"))
    _raise_if_any(rule_report(chunks, "chunk_id", chunk_rules(taxonomy)).select("chunk_id", "message"))
    _raise_if_any(orphans(chunks, records).select("record_id", F.lit("is referenced but missing")))
    for df, key in ((records, "record_id"), (chunks, "chunk_id")):
        _raise_if_any(df.groupBy(key).count().filter("count > 1").select(key, F.lit("is not unique")))
    versions = Versions(path)
    done = versions.numbers(spark)
    stage = f"data/{uuid.uuid4().hex}"
    ordered(records, ["source_id", "record_id"]).write.partitionBy("source_family").parquet(f"{path}/{stage}/records")
    ordered(chunks, ["source_id", "record_id", "chunk_id"]).write.partitionBy("source_family").parquet(f"{path}/{stage}/chunks")
    manifest_ids(records, chunks).write.partitionBy("kind").parquet(f"{path}/{stage}/manifest_ids")
    manifest_summary(records, chunks).write.parquet(f"{path}/{stage}/manifest")
    return versions.commit(spark, {"tables": {name: f"{stage}/{name}" for name in KB_TABLES}}, done[-1] if done else 0)


KB_TABLES = ("records", "chunks", "manifest_ids", "manifest")


def read_knowledge_base(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """One table of the latest or a given version; a reader that wants several names the version once and reads all of that."""
    found = Versions(path).read(spark, version)
    if found is None:
        raise ValidationError(f"missing: no version of a knowledge base at {path}")
    return spark.read.parquet(f"{path}/{found['tables'][name]}")


def append_audit(audit: DataFrame, path: str) -> None:
    """O-10: append-only table."""
    audit.write.mode("append").parquet(path)


def write_grouped(records: DataFrame, path: str) -> None:
    """O-11: one folder per group; empty groups never appear."""
    records.write.mode("overwrite").partitionBy("group").parquet(path)
