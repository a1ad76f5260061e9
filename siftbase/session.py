"""Session settings and the few places where a plan is cut or sized.

Everything else in the library is lazy.  ``written`` stores an intermediate
table in the cluster's shared folder (``spark.checkpoint.dir``), so that a lost
executor never loses it; ``broadcast_if_small`` measures a side before hinting.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: A side may be broadcast below both of these measured sizes.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(master: str = "local[*]", app: str = "siftbase", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: the one the cluster names.

    Only a local session, where driver and executors are one process, may do
    without; it gets a fresh folder.  On a cluster a missing setting is an error,
    since no machine's own disk is shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def intermediates(spark: SparkSession) -> str:
    """Where this application's intermediates are."""
    return f"{shared_dir(spark)}/siftbase/{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> bool:
    """Remove all intermediates of this application; results that still read them are lost.  To be called when they have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{intermediates(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Measure a side: one aggregate job whose single result row reaches the driver."""
    width = F.lit(0)
    for field in df.schema.fields:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            width = width + F.lit(8)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row.n <= max_rows and row.b <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast when the measured size allows it; a larger side is never broadcast, however small its file looks."""
    return F.broadcast(df) if is_small(df, **limits) else df.hint("merge")


def stored_side(df: DataFrame, name: str) -> DataFrame:
    """A computed side of a join with a big table: written once, then hinted by its measured size.

    Without this the planner cannot know that the side is small and would
    shuffle the big table.
    """
    return broadcast_if_small(written(df, name))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner", buckets: int = 32) -> DataFrame:
    """Equi-join that splits a hot ``key`` of ``left`` over ``buckets`` tasks.

    ``right`` is copied once per bucket, so it should hold few rows per key.
    ``spread_by`` must vary within one key; hashing it keeps the split repeatable.
    """
    salt = "_salt"
    salted_left = left.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(buckets)))
    salted_right = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    return salted_left.join(salted_right, [key, salt], how).drop(salt)


def computed_once(df: DataFrame, columns: dict, keep: list[str]) -> DataFrame:
    """Add ``columns`` so that later expressions read their values.

    The optimizer merges neighbouring projections, and a costly expression that
    is used inside a lambda would then run once per array element.  It does not
    merge across a generator, so the values pass through a one-row ``inline``.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(row))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan with fewer splits than cores (one small file); a large scan passes unchanged.

    For plain scans only: asking for the partitions of a plan with a shuffle would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def positions(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """Number the rows of each group without gathering a group in one task.

    Rows are range-partitioned by group and order and written, so that both uses
    below see the same partitions; each partition numbers its own rows and adds
    the count of the group's rows in earlier partitions.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return ranged.join(offsets, ["_part", *keys]).withColumn(name, F.col("_before") + local).drop("_part", "_before")
