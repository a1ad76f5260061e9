"""Keyed stream state: many events of one key in bounded pieces, and lapses that need no further event."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftbase.operators import sessions as SS
from siftbase.streaming import runs

SCHEMA = (
    "session_key string, ts timestamp, event_id long, event string, major string, target_role string, industry array<string>, region array<string>, "
    "employment_type array<string>, deadline_sensitivity string, persist boolean, consented_at timestamp, retention_days int, deletion_supported boolean"
)
START = datetime(2026, 1, 1)


def event(key, minutes, number, kind="set", persist=False, days=365, **fields):
    at = START + timedelta(minutes=minutes)
    full = {"major": None, "target_role": None, "industry": None, "deadline_sensitivity": None} | fields
    return (key, at, number, kind, full["major"], full["target_role"], full["industry"], None, None, full["deadline_sensitivity"], persist, at, days, True)


def streamed(spark, tmp_path, batches, lateness=None):
    """The result table of the stream over ``batches``, a micro-batch each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    inbox = str(tmp_path / "inbox")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    stream = runs.file_stream(spark, inbox, spark.createDataFrame([], SCHEMA).schema, 1)
    return runs.run_available(runs.preference_stream(stream, "ts", "event_id", lateness), "update", ["session_key"])


def test_one_key_with_many_events(spark, tmp_path):
    """Ten times what is sorted at once, in random order and with ties in time: the state is that of the batch form."""
    rng = random.Random(3)
    rows = []
    for i in range(10 * runs.RUN_EVENTS):
        kind = rng.choices(["set", "update", "clear"], [1, 40, 1])[0]
        given = {f: f"{f} {i}" for f in ("major", "target_role", "deadline_sensitivity") if rng.random() < (1 if kind == "set" else 0.2)}
        rows.append(event("hot" if i % 50 else f"cold {i % 7}", i // 3, i, kind, rng.random() < 0.3, 1 if i % 11 == 0 else 365, industry=[f"i{i}"] if i % 4 == 0 else None, **given))
    rng.shuffle(rows)
    now = F.lit(START + timedelta(days=60))
    columns = ["session_key", "major", "target_role", "industry", "deadline_sensitivity", "storage_scope"]
    want = SS.preference_state(spark.createDataFrame(rows, SCHEMA), ["ts", "event_id"], now).select(*columns)
    got = runs.live_preferences(streamed(spark, tmp_path, [rows]), now).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_lapse_needs_no_further_event(spark, tmp_path):
    """The watermark passes the end of one profile by events of others; profiles replaced or kept longer stay."""
    both = {"major": "m", "target_role": "r"}
    batches = [
        [event("short", 0, 1, persist=True, days=1, **both), event("renewed", 0, 2, persist=True, days=1, **both), event("long", 0, 3, persist=True, days=300, **both)],
        [event("renewed", 60, 4, "update", persist=True, days=300, major="n")],
        [event("other", 5 * 1440, 5, **both)],
        [event("other", 5 * 1440 + 1, 6, "update", major="o")],
    ]
    timed = {r.session_key: (r.major, r.storage_scope) for r in streamed(spark, tmp_path / "timed", batches, "1 hour").collect()}
    assert timed == {"short": (None, None), "renewed": ("n", "persistent"), "long": ("m", "persistent"), "other": ("o", "session")}
    untimed = {r.session_key: r.storage_scope for r in streamed(spark, tmp_path / "untimed", batches).collect()}
    assert untimed == {"short": "persistent", "renewed": "persistent", "long": "persistent", "other": "session"}


def test_the_inbox_of_the_upsert_stream_has_a_file_per_task(spark, sf_dir, tmp_path):
    import glob

    from siftbase.plans import QUERIES
    from siftbase.session import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/siftbase/snapshots-*-inbox"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        got = QUERIES["stream_upsert"](spark, str(tmp_path))
        assert got.count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (inbox,) = set(glob.glob(f"{root}/siftbase/snapshots-*-inbox")) - before
    assert len(glob.glob(f"{inbox}/part-*")) > 4
