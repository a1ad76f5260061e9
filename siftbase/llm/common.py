"""Helpers that several operators of this subpackage share: written tables, whole texts as
byte arrays, word and shingle hashes, and joins that survive a hot key."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


#: Rows are cut into slices of about so many text bytes before numpy sees them: temporaries stay in the cache and memory is bounded.
SLICE_BYTES = 1 << 19

#: A key that holds more than this share of the rows is hot; there are at most 1 / HOT_SHARE such keys, so their table may be broadcast.
HOT_SHARE = 1 / 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def small_batches(spark, size: str = "8m"):
    """Arrow batches of at most ``size`` for the jobs inside; the session's own setting is put back.

    For passes whose rows are long: a batch is held by the executor and by its worker at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _allocator():
    import ctypes

    return ctypes.CDLL(None)


def _lean() -> None:
    """Let this Python worker map large arrays one by one, so that freeing one gives its memory back at once."""
    libc = _allocator()
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def _returned() -> None:
    """Give back what is free when a task ends: an idle worker holds it else as long as it lives."""
    libc = _allocator()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean_map(run):
    """A function for ``mapInArrow`` whose worker keeps no free memory."""

    def task(batches):
        _lean()
        yield from run(batches)
        _returned()

    return task


def lean_cogroup(run):
    """A function of key and two groups for ``applyInArrow`` whose worker keeps no free memory."""

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _lean()
        out = run(key, left, right)
        _returned()
        return out

    return task


def crc_bucket(doc_id: str, parts: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``parts``: the fold of a row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def kept(key, make):
    """``make()``, or what it gave an earlier task of this Python worker.  Only for what can be made again."""
    import sys
    import types

    place = sys.modules.setdefault("siftbase_worker", types.ModuleType("siftbase_worker")).__dict__
    if key not in place:
        place[key] = make()
    return place[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cut a batch into runs of whole rows of at most ``most`` text bytes (a longer row stands alone)."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _random_table(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)


_BYTE = _random_table(256, 11)
_BASE = int(_random_table(1, 12)[0]) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept for a task."""

    def __init__(self):
        self.up, self.down = powers(1 << 12), powers(1 << 12, _INVERSE)

    def of(self, n: int):
        if n >= len(self.up):
            self.up, self.down = powers(2 * n), powers(2 * n, _INVERSE)
        return self.up, self.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pw: Powers) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, from one prefix sum over the bytes."""
    up, down = pw.of(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def rolling_hashes(data: np.ndarray, width: int, pw: Powers) -> np.ndarray:
    """64-bit hash of every run of ``width`` bytes."""
    up, down = pw.of(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    each = _BYTE[data]
    each *= up[: len(data)]
    np.cumsum(each, out=prefix[1:])
    h = prefix[width:] - prefix[:-width]
    h *= down[: len(h)]
    return mixed(h)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-case A to Z, every other byte as it is."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes outside [\\x20\\x09-\\x0D], and the number of words per row."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_BLANK[data]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = word[1:-1][edges]  # a row ends a word
    last[edges - 1] = word[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words per row."""
    starts, ends, per_row = word_bounds(data, offsets)
    return span_hashes(data, starts, ends, pw), per_row


def spans_of(per_row: np.ndarray) -> np.ndarray:
    """Offsets 0, n1, n1 + n2, ... of rows with n1, n2, ... items."""
    return np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)


def windows(words: np.ndarray, per_row: np.ndarray, width: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a row; (hashes, row of each, index of its first word)."""
    factor = _random_table(width, seed)
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * factor[k]
    row = np.repeat(np.arange(len(per_row)), per_row)
    keep = np.flatnonzero(row[:n] == row[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    return mixed(h[keep]), row[keep], keep


def broadcast_hot(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` with one row per ``key`` so that no task gets the rows of a hot key.

    ``groups[size]`` counts the rows of ``left`` with the key.  Keys with more
    than ``HOT_SHARE`` of all ``total`` rows number at most 1 / HOT_SHARE, so they
    are broadcast whatever the input; the rest meet in an ordinary join, in
    which no key has more than that share.  Null keys meet nothing.
    """
    hot = groups.where(F.col(size) > max(1, int(total * HOT_SHARE)))
    cold = groups.where(F.col(size) <= max(1, int(total * HOT_SHARE)))
    names = F.broadcast(hot.select(F.col(key)))
    met = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(names, key, "left_anti").join(cold, key, how)
    return met.select(*rest.columns).unionByName(rest)


#: Bits of the filter in front of a join with wanted ids: a fixed bound, 16 MB.
FILTER_BITS = 1 << 27

#: Bits of a row of Spark's bitmap functions.
BITMAP_BITS = 32768


def split_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among ``ids``, and rows whose key certainly is not, told apart during the scan by a bitmap."""
    bits = min(FILTER_BITS, max(BITMAP_BITS, 1 << (16 * max(1, ids.count()) - 1).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    filled = ids.select(slot.alias("_slot")).groupBy(F.expr(f"_slot div {BITMAP_BITS}").alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(_slot % {BITMAP_BITS})").alias("_bits"))
    tested = rows.withColumn("_slot", slot).withColumn("_bucket", F.expr(f"_slot div {BITMAP_BITS}")).join(F.broadcast(filled), "_bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_slot % {BITMAP_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    tested = tested.withColumn("_byte", byte).withColumn("_maybe", F.coalesce(F.expr("(shiftright(_byte, cast(_slot % 8 as int)) & 1) = 1"), F.lit(False)))
    return tested.where("_maybe").select(*rows.columns), tested.where("NOT _maybe").select(*rows.columns)
