"""Versions, bucketed snapshots, the one-commit sink and line-exact scans."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftbase.operators import chunking
from siftbase.sources import jsonl
from siftbase.sources.snapshots import SnapshotStore
from siftbase.sources.versions import Conflict, Versions, fingerprint
from test_operators import record_rows


def test_versions_commit_once(spark, tmp_path):
    versions = Versions(str(tmp_path))
    assert versions.read(spark) is None and versions.numbers(spark) == []
    assert versions.commit(spark, {"a": 1}, 0) == 1
    with pytest.raises(Conflict):
        versions.commit(spark, {"a": 2}, 0)
    assert versions.read(spark) == {"a": 1, "version": 1}
    assert versions.commit(spark, {"a": 3}, 1) == 2 and versions.read(spark, 1)["a"] == 1



def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = fingerprint(spark, path)
    assert fingerprint(spark, path) == first
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fingerprint(spark, path) != first


def last_wins(old, rows):
    rows = rows.withColumn("_new", F.lit(1))
    both = rows if old is None else old.withColumn("_new", F.lit(0)).unionByName(rows)
    return both.groupBy("id").agg(F.max_by("v", "_new").alias("v"))


def data_files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = SnapshotStore(str(tmp_path), key="id", buckets=16)
    store.publish(spark.range(500).select("id", F.lit("old").alias("v")))
    before, files = store.manifest(spark), data_files(tmp_path)
    assert len(before["folders"]) == 16
    changed = spark.createDataFrame([(3, "new"), (1000, "more")], "id long, v string")
    touched = {str(r.b) for r in changed.select(store.bucket_of().alias("b")).collect()}
    assert store.upsert(changed, last_wins) == 2
    after = store.manifest(spark)
    assert {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)} == touched
    assert len(data_files(tmp_path) - files) == len(touched)
    rows = {r.id: r.v for r in store.current(spark).collect()}
    assert rows == {i: "old" for i in range(500)} | {3: "new", 1000: "more"}
    assert {r.v for r in store.current(spark, 1).collect()} == {"old"}
    # untouched folders are named by both versions and stay; replaced ones go
    dropped = store.vacuum(spark, 1)
    assert sorted(dropped) == sorted(before["folders"][b] for b in touched)
    assert store.versions(spark) == [2] and store.current(spark).count() == 501


def test_failed_upsert_leaves_the_version(spark, tmp_path):
    store = SnapshotStore(str(tmp_path), key="id", buckets=4)
    store.upsert(spark.range(20).select("id", F.lit("old").alias("v")), last_wins)

    def broken(old, rows):
        return old.withColumn("v", F.raise_error(F.lit("boom")).cast("string"))

    with pytest.raises(Exception, match="boom"):
        store.upsert(spark.range(5).select("id", F.lit("new").alias("v")), broken)
    assert store.versions(spark) == [1] and {r.v for r in store.current(spark).collect()} == {"old"}


def test_upsert_of_nothing_and_of_null_keys(spark, tmp_path):
    store = SnapshotStore(str(tmp_path), key="id", buckets=4)
    empty = spark.createDataFrame([], "id long, v string")
    store.upsert(empty, last_wins)
    assert store.current(spark).count() == 0
    store.upsert(spark.createDataFrame([(None, "a"), (1, "b")], "id long, v string"), last_wins)
    store.upsert(spark.createDataFrame([(None, "c")], "id long, v string"), last_wins)
    assert sorted(((r.id, r.v) for r in store.current(spark).collect()), key=repr) == [(1, "b"), (None, "c")]


def test_sink_switches_all_tables_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    first = record_rows(spark, 3)
    assert jsonl.write_knowledge_base(first, chunking.chunk_records(first), path) == 1

    def broken(records, chunks):
        raise RuntimeError("between the tables")

    second = record_rows(spark, 5)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(jsonl, "manifest_summary", broken)
        jsonl.write_knowledge_base(second, chunking.chunk_records(second), path)
    assert [jsonl.read_knowledge_base(spark, path, t).count() for t in ("records", "manifest")] == [3, 1]
    assert jsonl.write_knowledge_base(second, chunking.chunk_records(second), path) == 2
    assert jsonl.read_knowledge_base(spark, path, "records").count() == 5
    assert jsonl.read_knowledge_base(spark, path, "records", 1).count() == 3
    with pytest.raises(jsonl.ValidationError):
        jsonl.read_knowledge_base(spark, str(tmp_path / "none"), "records")


def failures_by_hand(text, name):
    """The loader's rules: final line feed, then each non-empty line by number."""
    out = [(name, None, jsonl.UNENDED)] if text and not text.endswith("\n") else []
    for n, line in enumerate((x for x in text.split("\n") if x), 1):
        try:
            row = json.loads(line)
        except ValueError:
            out.append((name, n, jsonl.INVALID))
            continue
        if not row.get("v"):
            out.append((name, n, "schema invalid: v must not be empty"))
    return out


def test_failures_name_file_and_line(spark, tmp_path):
    good = [json.dumps({"i": i, "v": "é" * (i % 40 + 1)}, ensure_ascii=False) for i in range(400)]
    broken = list(good)
    for at, line in ((0, "{"), (7, ""), (8, ""), (9, "   "), (100, '{"i": 1, "v": ""}'), (101, '{"i": 2}'), (250, "no"), (251, "\t"), (399, "{]")):
        broken[at] = line
    texts = {"good": "\n".join(good) + "\n", "broken": "\n".join(broken) + "\n", "unended": "\n".join(good[:50]), "crlf": "\r\n".join(good[:5]) + "\r\n", "empty": "", "one": "x", "feeds": "\n\n\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    schema = StructType().add("i", "long").add("v", "string")
    rules = [("v", F.length(F.coalesce("v", F.lit(""))) > 0, "v must not be empty")]
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # many tasks a file
        ok, bad = jsonl.scan_jsonl(spark, [str(tmp_path)], schema, rules=rules)
        assert ok.columns == ["i", "v"]
        assert ok.select("i").count() == sum(len([x for x in t.split("\n") if x]) for t in texts.values()) - sum(r[1] is not None for n, t in texts.items() for r in failures_by_hand(t, n))
        got = sorted(((os.path.basename(r.file).removesuffix(".jsonl"), r.line, r.message) for r in bad.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert got == sorted((x for n, t in texts.items() for x in failures_by_hand(t, n)), key=repr)
    with pytest.raises(jsonl.ValidationError, match="final newline"):
        jsonl.load_or_fail(spark, [str(tmp_path / "unended.jsonl")], schema)
