"""Versioned snapshots in hash buckets, copied on write.

A version's manifest points at one folder per bucket.  An upsert reads and
rewrites only the buckets that its rows fall into; the others keep the folders
of earlier versions.  A folder goes when no kept version points at it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siftbase.session import written
from siftbase.sources.versions import Versions, names, read_paths

BUCKETS = 64


class SnapshotStore:
    """O-21: readers take the highest committed version.

    ``key``: the columns that decide a row's bucket; without them a version is one
    bucket, which every write replaces.  ``keep``: after a write only so many
    versions stay, so a reader that lasts longer than ``keep`` writes needs a
    larger number.
    """

    def __init__(self, path: str, keep: int | None = None, key: str | None = None, buckets: int = BUCKETS):
        if keep is not None and keep < 1:
            raise ValueError("keep must be at least 1")
        self.path, self.keep, self.key, self.buckets = path, keep, key, buckets if key else 1
        self._versions = Versions(path)

    def versions(self, spark: SparkSession) -> list[int]:
        return self._versions.numbers(spark)

    def manifest(self, spark: SparkSession, number: int | None = None) -> dict | None:
        """``version``, ``schema`` and ``folders`` (bucket to folder) of a version."""
        return self._versions.read(spark, number)

    def current(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        found = self.manifest(spark, number)
        return self._read(spark, found) if found else None

    def _read(self, spark: SparkSession, manifest: dict, only: set[int] | None = None) -> DataFrame:
        folders = sorted(f for b, f in manifest["folders"].items() if only is None or int(b) in only)
        return read_paths(spark, [f"{self.path}/{f}" for f in folders], StructType.fromJson(json.loads(manifest["schema"])))

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Bucket folders of ``df``, written but not committed."""
        spark, stage = df.sparkSession, f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket_of())
        if self.key:
            rows = rows.hint("rebalance", "_bucket")  # one file a bucket, or several where a bucket is large
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{stage}")
        return {n.split("=")[1]: f"{stage}/{n}" for n in names(spark, f"{self.path}/{stage}") if n.startswith("_bucket=")}

    def _commit(self, spark: SparkSession, schema: StructType, folders: dict[str, str], after: int) -> int:
        number = self._versions.commit(spark, {"schema": schema.json(), "folders": folders}, after)
        if self.keep is not None:
            self.vacuum(spark, self.keep)
        return number

    def publish(self, df: DataFrame) -> int:
        """Write a whole version; readers switch only when it has committed."""
        done = self.versions(df.sparkSession)
        return self._commit(df.sparkSession, df.schema, self._write(df), done[-1] if done else 0)

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """The next version: ``merge(old, rows)`` over the buckets that ``rows`` touch; ``old`` holds those buckets' rows, or is None before the first version.

        ``merge`` must give rows of those buckets only, as one keyed by ``key`` does.
        """
        spark = rows.sparkSession
        found = self.manifest(spark)
        rows = written(rows, "upsert")
        touched = {r.b for r in rows.select(self.bucket_of().alias("b")).distinct().collect()}  # at most a number per bucket
        if found is None:
            made, folders, after = merge(None, rows), {}, 0
        else:
            folders, after = dict(found["folders"]), found["version"]
            made = merge(self._read(spark, found, touched), rows)
        new = self._write(made)
        folders = {b: f for b, f in folders.items() if int(b) not in touched} | new
        return self._commit(spark, made.schema, folders, after)

    def vacuum(self, spark: SparkSession, keep: int) -> list[str]:
        """Keep the last ``keep`` versions; the bucket folders that no kept one points at are removed and returned."""
        return self._versions.vacuum(spark, keep, lambda m: set(m["folders"].values()))
