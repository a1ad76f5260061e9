"""Numbered versions of a table folder: one small manifest file each, and one rename that makes it count.

Data files are written first, under names that nothing reads yet.  A version
exists once its manifest has its final name, so several tables or many buckets
switch together, and a failed write leaves the version before it whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a table: changes whenever the table is written again."""
    fs, p = _fs(spark, path)
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return hashlib.sha256(repr(files).encode()).hexdigest()


class Versions:
    """Manifests ``path/_versions/000000000001.json``, ...; each is a dictionary."""

    def __init__(self, path: str):
        self.path = path
        self.folder = f"{path}/_versions"

    def numbers(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(spark, self.folder) if n.endswith(".json") and n[:DIGITS].isdigit()]

    def read(self, spark: SparkSession, number: int | None = None) -> dict | None:
        """The manifest of a version, the latest by default; None if there is none."""
        if number is None:
            numbers = self.numbers(spark)
            if not numbers:
                return None
            number = numbers[-1]
        fs, p = _fs(spark, f"{self.folder}/{number:0{DIGITS}d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": number}
        finally:
            stream.close()

    def commit(self, spark: SparkSession, body: dict, after: int) -> int:
        """Make ``body`` version ``after`` + 1; Conflict if that exists already."""
        number = after + 1
        final = f"{self.folder}/{number:0{DIGITS}d}.json"
        staged = f"{self.folder}/.{uuid.uuid4().hex}"
        fs, p = _fs(spark, staged)
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        stream.close()
        jvm = spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(final)), options)
        except Exception as e:
            fs.delete(p, False)
            if exists(spark, final):
                raise Conflict(f"version {number} of {self.path} exists") from e
            raise
        return number

    def vacuum(self, spark: SparkSession, keep: int, folders: Callable[[dict], set[str]]) -> list[str]:
        """Forget all but the last ``keep`` versions and remove the ``folders`` that only those point at; the folders removed."""
        done = self.numbers(spark)
        gone, left = done[:-keep], done[-keep:]
        if not gone:
            return []
        used = {f for n in left for f in folders(self.read(spark, n))}
        dropped = sorted({f for n in gone for f in folders(self.read(spark, n))} - used)
        for n in gone:
            delete(spark, f"{self.folder}/{n:0{DIGITS}d}.json")
        for folder in dropped:
            delete(spark, f"{self.path}/{folder}")
        return dropped


def read_paths(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    """Parquet files of several folders; no folder is an empty table."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
