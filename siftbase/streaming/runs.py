"""Structured Streaming forms of the keyed state, and upserts into versioned snapshots."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftbase.operators.quality import merge_by_id
from siftbase.operators.sessions import PREFERENCE_FIELDS, audit_counts, session_references, valid_preference_event
from siftbase.session import shared_dir
from siftbase.sources.snapshots import SnapshotStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path_glob: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path_glob)


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all available input and return its result table.

    Every micro-batch result is written to the shared folder; in complete mode
    the last batch is the result, in update mode the last row per key, in append
    mode all rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/siftbase/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out/*")
    if mode == "complete":
        rows = rows.filter(F.col("_batch") == rows.agg(F.max("_batch").alias("m")).scalar())
    elif mode == "update" and keys:
        newest = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
        rows = rows.join(newest, [*keys, "_batch"], "left_semi")
    return rows.drop("_batch")


def audit_count_stream(audit: DataFrame, ts: str, tier: str, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """O-132 as a stream, for update mode: every row counts, however late; the state is one row per window and tier.

    With ``lateness`` a window's state goes once it is that far behind the newest
    row, and later rows of it are dropped, which the batch form never does.
    """
    return audit_counts(audit.withWatermark(ts, lateness) if lateness else audit, ts, tier, width)


def reference_stream(events: DataFrame, order: list[str]) -> DataFrame:
    """O-133 as a stream, for update mode: the batch aggregate, kept as state per (session, url)."""
    return session_references(events, order)


#: Events of a key that are sorted in memory at once, and events of a piece in which the rest waits in the state store.
RUN_EVENTS, PIECE_EVENTS = 10_000, 256

_EVENT = ("at_micros", "seq", "event", "persist", "expires_micros", *PREFERENCE_FIELDS)


class _Preferences(StatefulProcessor):
    """Profile per session key; a lapsed persistent profile reads as absent.

    A key's events of a micro-batch are applied in order.  Up to ``RUN_EVENTS``
    of them are sorted in memory; of more, sorted runs wait in pieces in the
    state store and are merged, one piece of each run at a time.
    """

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", f"{_FIELD_TYPES}, scope string, expires bigint")
        self.waiting = handle.getMapState("waiting", "run int, piece int", "events string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, pieces = [], []
        for frame in rows:
            held += [[_plain(v) for v in e] for e in frame[list(_EVENT)].itertuples(index=False)]
            while len(held) > RUN_EVENTS:
                pieces.append(self._set_aside(len(pieces), sorted(held[:RUN_EVENTS], key=_place)))
                held = held[RUN_EVENTS:]
        runs = [self._run(number, count) for number, count in enumerate(pieces)]
        before = self._profile()
        state = before
        for event in heapq.merge(*runs, sorted(held, key=_place), key=_place):
            state = _after(state, dict(zip(_EVENT, event, strict=True)))
        if pieces:
            self.waiting.clear()
        self._lapse_at(before, state)
        if state is None:
            self.profile.clear()
        else:
            self.profile.update(tuple(state.values()))
        yield _row(key, state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._profile()
        if state is not None and state["expires"] is not None and -(-state["expires"] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.profile.clear()
            yield _row(key, None)

    def _profile(self) -> dict | None:
        return dict(zip([*PREFERENCE_FIELDS, "scope", "expires"], self.profile.get(), strict=True)) if self.profile.exists() else None

    def _lapse_at(self, before: dict | None, after: dict | None) -> None:
        """Move the key's timer from the end of the old profile to that of the new one."""
        old, new = ((-(-s["expires"] // 1000) if s and s["expires"] is not None else None) for s in (before, after))
        if self.timed and old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def _set_aside(self, run: int, events: list) -> int:
        starts = range(0, len(events), PIECE_EVENTS)
        for piece, start in enumerate(starts):
            self.waiting.updateValue((run, piece), (json.dumps(events[start : start + PIECE_EVENTS]),))
        return len(starts)

    def _run(self, run: int, pieces: int) -> Iterator[list]:
        for piece in range(pieces):
            yield from json.loads(self.waiting.getValue((run, piece))[0])

    def close(self) -> None:
        pass


_FIELD_TYPES = ", ".join(f"{f} string" if f in ("major", "target_role", "deadline_sensitivity") else f"{f} array<string>" for f in PREFERENCE_FIELDS)


def _place(event: list) -> tuple:
    return event[0], event[1]


def _after(state: dict | None, e: dict) -> dict | None:
    """The profile after an event."""
    if state is not None and state["expires"] is not None and e["at_micros"] >= state["expires"]:
        state = None
    if e["event"] == "clear":
        return None
    base = state if e["event"] == "update" and state else dict.fromkeys(PREFERENCE_FIELDS)
    merged = {f: e[f] if e[f] is not None else base[f] for f in PREFERENCE_FIELDS}
    if merged["major"] is None or merged["target_role"] is None:
        return state
    return {**merged, "scope": "persistent" if e["persist"] else "session", "expires": int(e["expires_micros"]) if e["persist"] else None}


def _row(key: Any, state: dict | None) -> pd.DataFrame:
    values = [None] * (len(PREFERENCE_FIELDS) + 2) if state is None else list(state.values())
    return pd.DataFrame([[key[0], *values]], columns=["session_key", *PREFERENCE_FIELDS, "storage_scope", "expires_micros"])


def _plain(value: Any) -> Any:
    if value is None or (isinstance(value, float) and value != value):
        return None
    return list(value) if hasattr(value, "__len__") and not isinstance(value, str) else value


def preference_stream(events: DataFrame, at: str, seq: str, lateness: str | None = None) -> DataFrame:
    """O-134 as a stream: the latest state row per session key; a null scope means no profile.

    The state of a key between micro-batches is one small row; needs the RocksDB
    state store.  Without ``lateness`` every event counts, and a lapse shows when
    the next event comes or the table is read.  With it, a timer emits the lapse
    once the newest event is that far beyond it, without an event of the key, and
    rows that come later than ``lateness`` are dropped, which the batch form
    never does.
    """
    if lateness:
        events = events.withWatermark(at, lateness)
    e = events.filter(valid_preference_event()).select(
        "session_key", "event", *PREFERENCE_FIELDS, F.coalesce("persist", F.lit(False)).alias("persist"), F.unix_micros(at).alias("at_micros"), F.col(seq).alias("seq"),
        F.coalesce(F.unix_micros("consented_at") + F.col("retention_days") * 86_400_000_000, F.lit(0).cast("bigint")).alias("expires_micros"), *([at] if lateness else []),
    )
    return e.groupBy("session_key").transformWithStateInPandas(
        statefulProcessor=_Preferences(bool(lateness)), outputStructType=f"session_key string, {_FIELD_TYPES}, storage_scope string, expires_micros bigint",
        outputMode="Update", timeMode="EventTime" if lateness else "None",
    )


def live_preferences(rows: DataFrame, now) -> DataFrame:
    """Read side of ``preference_stream`` at ``now``."""
    alive = F.col("storage_scope").isNotNull() & (F.col("expires_micros").isNull() | (F.unix_micros(now) < F.col("expires_micros")))
    return rows.filter(alive).withColumn("deadline_sensitivity", F.coalesce("deadline_sensitivity", F.lit("balanced"))).drop("expires_micros")


def upsert_stream(stream: DataFrame, store: SnapshotStore, key: str, order: Column, transform: Callable[[DataFrame], DataFrame] | None = None):
    """O-135, O-136: merge each micro-batch into the next snapshot version; a failed batch leaves the current one.

    Of the rows of one key in a batch the last by ``order``, a bigint, wins.
    A store whose ``key`` is this one rewrites only the buckets that a batch touches.
    """
    if store.key not in (None, key):
        raise ValueError(f"the store is bucketed by {store.key}, not by {key}")

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.withColumn("_batch", F.lit(1)).withColumn("_pos", order)
        if old is not None:
            rows = old.withColumn("_batch", F.lit(0)).withColumn("_pos", F.lit(0).cast("bigint")).unionByName(rows)
        return merge_by_id(rows, key, "_batch", "_pos").drop("_batch", "_pos")

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert(transform(batch) if transform else batch, merge)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{store.path}/_stream").trigger(availableNow=True).start()
