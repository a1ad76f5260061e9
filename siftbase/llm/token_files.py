"""Token ids in files of a static range asymmetric numeral system.

The ids of all documents in ascending id order form one stream, cut at document
ends into segments of about ``SEGMENT`` ids.  A segment has one frequency table
over all its ids, shared by its blocks.  Every block holds ``BLOCK`` ids in
``LANES`` interleaved lanes and can be decoded alone: the directory keeps, as a
checkpoint, where its words start, the state of each lane and a checksum of its
ids.  All lanes of all blocks of a segment are coded side by side in numpy.

Layout of a segment, little-endian: magic, counts (ids, blocks, symbols, words,
documents), symbols u32, frequencies u32, per block word offset u64 and crc u32,
lane states u64, words u32, document lengths u32, crc of all before u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftbase.llm.common import slices, utf8
from siftbase.llm.registry import query, table
from siftbase.llm.tokens import VOCABULARY, task_ids
from siftbase.session import written

SEGMENT, BLOCK, LANES = 1 << 22, 8192, 32

#: Frequencies of a table sum to 2 ** TOTAL_BITS; states stay in [2 ** 31, 2 ** 63).
TOTAL_BITS = 16
_LOW = np.uint64(1 << 31)

MAGIC = b"SBRANS01"

#: Text bytes of a range partition, which is one file.
FILE_BYTES = 32 << 20

END = 0


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.uint64)
    total = np.uint64(1 << TOTAL_BITS)
    if len(symbols) > int(total):
        raise ValueError("more distinct ids than a frequency table can hold")
    freq = 1 + counts * (total - np.uint64(len(symbols))) // counts.sum()
    freq[np.argmax(counts)] += total - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _by_step(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids as (steps, blocks * LANES); the last block is filled up with its last id."""
    blocks = max(1, -(-len(ids) // BLOCK))
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, ids.dtype)
    padded[: len(ids)] = ids
    return padded.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, blocks * LANES), blocks


def encode(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment; ``lengths`` are the ids of each document."""
    symbols, freq = frequency_table(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    below = (np.cumsum(freq) - freq).astype(np.uint64)
    wide = freq.astype(np.uint64)
    steps, blocks = _by_step(ids)
    words, used = np.zeros(steps.shape, np.uint32), np.zeros(steps.shape, bool)
    state = np.full(steps.shape[1], _LOW, np.uint64)
    for t in range(len(steps) - 1, -1, -1):
        k = place[steps[t]]
        f = wide[k]
        full = state >= (f << np.uint64(63 - TOTAL_BITS))
        used[t], words[t] = full, state & np.uint64(0xFFFFFFFF)
        state = np.where(full, state >> np.uint64(32), state)
        whole = state // f
        state = (whole << np.uint64(TOTAL_BITS)) + (state - whole * f) + below[k]
    per_block = used.reshape(len(steps), blocks, LANES).transpose(1, 0, 2)
    streams = words.reshape(len(steps), blocks, LANES).transpose(1, 0, 2)[per_block]
    offsets = np.concatenate([[0], np.cumsum(per_block.sum(axis=(1, 2)))])
    wide_ids = ids.astype("<u4")
    crcs = np.array([zlib.crc32(wide_ids[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)], "<u4")
    body = b"".join(
        [
            MAGIC,
            struct.pack("<5Q", len(ids), blocks, len(symbols), len(streams), len(lengths)),
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            offsets[:-1].astype("<u8").tobytes(),
            crcs.tobytes(),
            state.astype("<u8").tobytes(),
            streams.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document lengths of a segment, or the ids of some of its blocks; every checksum is tested."""
    if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a segment, or damaged")
    n, blocks, n_symbols, n_words, n_docs = struct.unpack_from("<5Q", data, 8)
    at = 48

    def take(count, kind):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    symbols, freq = take(n_symbols, "<u4"), take(n_symbols, "<u4")
    offsets, crcs = take(blocks, "<u8").astype(np.int64), take(blocks, "<u4")
    states, words, lengths = take(blocks * LANES, "<u8"), take(n_words, "<u4").astype(np.uint64), take(n_docs, "<u4")
    chosen = np.arange(blocks) if only is None else np.array(only, np.int64)
    at_word = offsets[chosen]
    state = states.reshape(blocks, LANES)[chosen].astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols), freq)
    below = (np.cumsum(freq) - freq).astype(np.uint64)
    wide, mask = freq.astype(np.uint64), np.uint64((1 << TOTAL_BITS) - 1)
    words = np.append(words, np.uint64(0))
    out = np.zeros((BLOCK // LANES, len(chosen), LANES), np.uint32)
    for t in range(len(out)):
        low = state & mask
        k = slot[low.astype(np.int64)]
        out[t] = symbols[k]
        state = wide[k] * (state >> np.uint64(TOTAL_BITS)) + low - below[k]
        empty = state < _LOW
        nth = np.cumsum(empty, axis=1)
        state[empty] = (state[empty] << np.uint64(32)) | words[(at_word[:, None] + nth - 1)[empty]]
        at_word = at_word + nth[:, -1]
    ids = out.transpose(1, 0, 2).reshape(len(chosen), BLOCK)
    for row, b in enumerate(chosen):
        if zlib.crc32(np.ascontiguousarray(ids[row, : max(0, min(BLOCK, n - b * BLOCK))], "<u4")) != crcs[b]:
            raise ValueError(f"block {b} is damaged")
    flat = ids.reshape(-1)
    return (flat[:n] if only is None else flat), lengths


def write_token_files(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the token files of ``docs`` and return them as read back.

    One row per segment: ``part`` (file), ``segment`` (within it), ``begin`` (ids
    of the part before it), ``n_tokens``, ``doc_ids`` and ``payload``.  Null
    texts count as empty, every document ends with id 0, null ids come first,
    rows of equal id are ordered by a hash of their text.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    ranged = rows.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    id_type = pa.int64()

    def run(batches):
        part, segment, begin = TaskContext.get().partitionId(), 0, 0
        encoder = task_ids(vocabulary)
        held, lengths, names, n = [], [], [], 0

        def close():
            nonlocal held, lengths, names, n, segment, begin
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            row = [[part], [segment], [begin], [n], [pa.concat_arrays(names).to_pylist()], [encode(ids, sizes)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "segment", "begin", "n_tokens", "doc_ids", "payload"])
            segment, begin = segment + 1, begin + n
            held, lengths, names, n = [], [], [], 0
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = encoder.rows(*utf8(batch.column("text")))
                held.append(np.insert(ids, offsets[1:], END))
                lengths.append(np.diff(offsets) + 1)
                names.append(batch.column("doc_id").cast(id_type))
                n += len(held[-1])
                if n >= SEGMENT:
                    yield close()
        if held:
            yield close()

    return written(ranged.mapInArrow(run, "part int, segment int, begin long, n_tokens long, doc_ids array<long>, payload binary"), "tokens")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = decode(row["payload"])
            ends = np.cumsum(lengths, dtype=np.int64)
            wide = ids.astype("<u4")
            crcs = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
            columns = [pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["begin"] + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of token files: id, ``start`` in the whole stream, ``n_tokens``, ``ids_crc32``; decoded from the payloads.

    Parts are numbered in stream order; there is one row per file in the sum over them.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    docs = files.select("part", "begin", "doc_ids", "payload").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    return read_documents(write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text")))
