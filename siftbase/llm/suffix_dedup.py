"""Suffix-array dedup of byte strings: which 200-byte strings start at two places or more.

A suffix for every byte would be many times the corpus.  Suffixes are therefore
kept at anchors: of the 101 strings of 100 bytes inside a 200-byte string, the
smallest by hash is the same wherever that string stands, so every string is found
at an anchor, at some distance d left of it; anchors are about 50 bytes apart.

1. Hashes of anchors (their leading token, the 100 bytes) are counted; an anchor
   whose token occurs once cannot lie in a repeated string.
2. Suffixes of the other anchors are range-partitioned by leading token, with
   splitters sampled from these tokens, and sent with the bytes on both sides.
   Equal suffixes of one task are sent once.
3. Each bucket sorts its suffixes eight bytes at a time, rightwards behind the
   token and, mirrored, leftwards before it, and takes the common lengths of
   neighbours.  For each d, strings are equal if their leftward d and rightward
   100 - d bytes fall into the same runs.  A splitter is a leading token, so equal
   tokens never lie on both sides of a boundary: a bucket checks its own first and
   last token against the splitters, and nothing else can match across them.
4. Repeated starts go back to their documents, whose covered bytes are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftbase.llm.common import Powers, mixed, rolling_hashes, runs, slices, small_batches, split_by_ids, utf8
from siftbase.llm.registry import query, table
from siftbase.session import written

#: Length of the strings, and of the leading token of a suffix.
LENGTH, TOKEN = 200, 100
_SPREAD = LENGTH - TOKEN + 1

#: Bytes of text of a group of token counts and of a bucket of suffixes.
COUNT_BYTES, BUCKET_BYTES = 64 << 20, 8 << 20

#: Bits of the filter of repeated tokens per token, and at most (64 MB, the bound of its broadcast).
SPARSITY, MOST_BITS = 16, 1 << 29

#: One repeated token in so many is a sample for the splitters.
SPLITTER_SAMPLE = 64

_SIDE = 104  # bytes of context on a side, a whole number of 8-byte words


def anchors(data: np.ndarray, offsets: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the 200-byte strings that lie within a row: token hash, position, and first and last start of a string with this anchor."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    token = rolling_hashes(data, TOKEN, pw)
    bits = np.uint64(int(n).bit_length())
    least = token >> bits
    least <<= bits
    least |= np.arange(len(token), dtype=np.uint64)
    span = 1
    while 2 * span <= _SPREAD:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = _SPREAD - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    least &= (np.uint64(1) << bits) - np.uint64(1)  # the anchor of the string at every start
    inside = np.ones(len(least), bool)
    close = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])  # too close to a row's end
    close_end = np.minimum(offsets[1:], len(least))
    inside[runs(np.maximum(close_end - close, 0), close)] = False
    starts = np.flatnonzero(inside)
    anchor = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return token[anchor[first]], anchor[first], starts[first], starts[last]


def _tokens(parts: int):
    """Leading tokens of all anchors, dealt by hash; a token is sent at most twice from one slice."""

    def run(batches):
        pw = Powers()
        for whole in batches:
            held = []
            for batch in slices(whole, "text"):
                held.append(anchors(*utf8(batch.column("text")), pw)[0])
            token, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            edges = np.searchsorted((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            sent = [np.repeat(token[edges[p] : edges[p + 1]], np.minimum(count[edges[p] : edges[p + 1]], 2)).tobytes() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sent, pa.binary())], names=["part", "tokens"])

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Tokens that occur twice or more in a group, and a sample of them."""
    token, count = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in group.column("tokens")]), return_counts=True)
    token = token[count > 1]
    sample = token[::SPLITTER_SAMPLE]
    return pa.table({"part": group.column("part")[:1], "n": pa.array([len(token)]), "tokens": pa.array([token.tobytes()], pa.binary()), "sample": pa.array([sample.view(np.int64).tolist()], pa.list_(pa.int64()))})


def _bitmaps(bits: int):
    """Filter bits of groups of tokens: where the group's bytes begin, and the bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("tokens"):
                slot = np.unique(np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
                begin = int(slot[0] >> 3) if len(slot) else 0
                marks = np.zeros((int(slot[-1] >> 3) - begin + 1) * 8 if len(slot) else 0, np.uint8)
                marks[slot - 8 * begin] = 1
                out.append((begin, np.packbits(marks).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([m for _, m in out], pa.binary())], names=["begin", "bits"])

    return run


_FACTORS = np.arange(1, _SIDE // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _name(token, low, high, left, right) -> np.ndarray:
    """Hash of whole suffixes: token, distances and both sides."""
    h = mixed(token) + low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + high.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k, word in enumerate(np.concatenate([left.view(np.uint64), right.view(np.uint64)], axis=1).T):
        h += mixed(word + _FACTORS[k])
    return mixed(h)


def _candidates(data, offsets, repeated, shift, pw):
    """Anchors with a repeated token: token, nearest and farthest start, the bytes before (nearest first) and behind, row, place in the row."""
    token, anchor, first, last = anchors(data, offsets, pw)
    slot = token >> shift
    keep = (repeated[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 > 0
    token, anchor, first, last = token[keep], anchor[keep], first[keep], last[keep]
    low, high = anchor - last, anchor - first
    sides = []
    for begin, step, length in ((anchor - 1, -1, high), (anchor + TOKEN, 1, LENGTH - TOKEN - low)):
        side = np.zeros((len(anchor), _SIDE), np.uint8)
        row = np.repeat(np.arange(len(anchor)), length)
        k = runs(length, np.zeros(len(anchor), np.int64))
        side[row, k] = data[begin[row] + step * k]
        sides.append(side)
    row = np.searchsorted(offsets, first, side="right") - 1
    return token, low.astype(np.uint8), high.astype(np.uint8), *sides, row, (anchor - offsets[row]).astype(np.uint32)


def _suffixes(shared, bits: int):
    """Suffixes of anchors with a repeated token, dealt by splitter; and where they stand in documents (``key`` filled).

    A task sends each of its different suffixes once: ``which`` numbers them, ``many`` tells whether a slice held it twice.
    """
    names = ["part", "task", "token", "low", "high", "left", "right", "which", "many", "key", "start"]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 9]

    def packed(rows):
        cells = [[x if i < 2 else (None if x is None else np.ascontiguousarray(x).tobytes()) for x in c] for i, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

    def run(batches):
        repeated, splitters = shared.value
        pw, task, codec = Powers(), TaskContext.get().partitionId(), pa.Codec("zstd")
        shift = np.uint64(64 - (bits.bit_length() - 1))
        sent, number, n_sent, turn = np.zeros(0, np.uint64), np.zeros(0, np.uint32), 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                token, low, high, left, right, row, place = _candidates(*utf8(batch.column("text")), repeated, shift, pw)
                if not len(token):
                    continue
                name = _name(token, low, high, left, right)
                name, once, inverse, many = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                at = np.searchsorted(sent, name)
                known = np.zeros(len(name), bool)
                inside = at < len(sent)
                known[inside] = sent[at[inside]] == name[inside]
                which = np.zeros(len(name), np.uint32)
                which[known] = number[at[known]]
                which[~known] = n_sent + np.arange(int((~known).sum()), dtype=np.uint32)
                n_sent += int((~known).sum())
                order = np.argsort(np.concatenate([sent, name[~known]]), kind="stable")
                sent, number = np.concatenate([sent, name[~known]])[order], np.concatenate([number, which[~known]])[order]
                key = batch.column("key").to_numpy()[row]
                rows = [(turn % (len(splitters) + 1), task, *[None] * 5, which[inverse], None, key, place)]
                turn += 1
                again = known | (many > 1)  # what stands twice in a task is repeated, wherever else it stands
                tell = np.flatnonzero(~known | again)
                part = np.searchsorted(splitters, token[once[tell]], side="right")
                by = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[by], np.arange(len(splitters) + 2))
                for p in np.flatnonzero(np.diff(edges)):
                    some = tell[by[edges[p] : edges[p + 1]]]
                    new = some[~known[some]]
                    take = once[new]
                    lefts = left[take][np.arange(_SIDE) < high[take][:, None]]
                    rights = right[take][np.arange(_SIDE) < (LENGTH - TOKEN - low[take].astype(np.int64))[:, None]]
                    sides = [np.frombuffer(codec.compress(np.ascontiguousarray(x), asbytes=True), np.uint8) for x in (lefts, rights)]
                    rows.append((p, task, token[take], low[take], high[take], *sides, np.concatenate([which[new], which[some[known[some]]]]), many[new] > 1, None, None))
                yield packed(rows)

    return run


def multikey_order(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte words within segments, and the bytes each shares with the one before.

    All segments that still hold several rows are sorted by their next word at
    once, without pivots; rows of different ``segment`` share -1.
    """
    n, width = words.shape
    order = np.argsort(segment, kind="stable")
    common = np.full(n, -1, np.int64)
    if not n:
        return order, common
    bound = np.ones(n, bool)
    bound[1:] = segment[order[1:]] != segment[order[:-1]]
    for level in range(width):
        open_ = ~bound
        live = open_.copy()
        live[:-1] |= open_[1:]  # rows in segments of two or more
        at = np.flatnonzero(live)
        if not len(at):
            break
        group = np.cumsum(bound)[at]
        word = words[order[at], level]
        by = np.lexsort((word, group))
        order[at], word = order[at[by]], word[by]
        apart = np.flatnonzero((word[1:] != word[:-1]) & (group[1:] == group[:-1]))
        bytes_ = 7 - np.floor(np.log2((word[apart + 1] ^ word[apart]).astype(np.float64))).astype(np.int64) // 8
        common[at[apart + 1]] = 8 * level + np.clip(bytes_, 0, 7)
        bound[at[apart + 1]] = True
    common[~bound] = 8 * width
    return order, common


def repeated_distances(token, low, high, left, right, many) -> np.ndarray:
    """For every suffix a row of TOKEN + 1 marks: whether the string that starts d bytes before its anchor starts elsewhere, too."""
    n = len(token)
    found = np.zeros((n, TOKEN + 1), bool)
    found[many] = True
    _, segment = np.unique(token, return_inverse=True)
    sides = []
    for side in (left, right):
        words = side.reshape(n, _SIDE // 8, 8).view(">u8")[:, :, 0].astype(np.uint64)
        order, common = multikey_order(words, segment)
        sides.append((order, common))
    (left_order, left_common), (right_order, right_common) = sides
    run = np.zeros(n, np.int64)
    for d in range(TOKEN + 1):
        active = np.flatnonzero((low <= d) & (d <= high))
        if len(active) < 2:
            continue
        run[right_order] = np.cumsum(right_common < TOKEN - d)
        key = run[active] * np.int64(n + 1)
        run[left_order] = np.cumsum(left_common < d)
        key += run[active]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        found[active, d] |= count[inverse] > 1
    found &= (np.arange(TOKEN + 1) >= low[:, None]) & (np.arange(TOKEN + 1) <= high[:, None])
    return found


def _unpacked(packed: pa.ChunkedArray, lengths: list[np.ndarray], length: np.ndarray) -> np.ndarray:
    codec = pa.Codec("zstd")
    flat = np.concatenate([np.frombuffer(codec.decompress(x.as_buffer(), int(n.sum(dtype=np.int64))), np.uint8) for x, n in zip(packed, lengths, strict=True)])
    out = np.zeros((len(length), _SIDE), np.uint8)
    out[np.arange(_SIDE) < length[:, None]] = flat
    return out


def _bucket(splitters: np.ndarray):
    """Per bucket: the marks of its repeated suffixes, task by task; places pass through."""
    schema = pa.schema([("task", pa.int64()), ("which", pa.binary()), ("marks", pa.binary()), ("key", pa.binary()), ("start", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        places = group.filter(pc.is_valid(group.column("key")))
        group = group.filter(pc.is_null(group.column("key")))
        out = pa.table({"task": places.column("task"), "which": places.column("which"), "marks": pa.nulls(len(places), pa.binary()), "key": places.column("key"), "start": places.column("start")}, schema=schema)
        if not len(group):
            return out
        columns = {c: [np.frombuffer(x.as_buffer(), k) for x in group.column(c)] for c, k in (("token", "<u8"), ("low", "u1"), ("high", "u1"), ("which", "<u4"), ("many", "?"))}
        token, low, high, many = (np.concatenate(columns[c]) for c in ("token", "low", "high", "many"))
        low, high = low.astype(np.int64), high.astype(np.int64)
        part = group.column("part")[0].as_py()
        if len(token) and ((part > 0 and token.min() < splitters[part - 1]) or (part < len(splitters) and token.max() >= splitters[part])):
            raise ValueError("a suffix lies outside its bucket")
        task = np.repeat(group.column("task").to_numpy(), [len(t) for t in columns["token"]])
        which = np.concatenate([w[: len(t)] for w, t in zip(columns["which"], columns["token"], strict=True)])
        # numbers beyond the suffixes of a row tell that an earlier suffix of the task stands there again
        again_task = np.repeat(group.column("task").to_numpy(), [len(w) - len(t) for w, t in zip(columns["which"], columns["token"], strict=True)])
        again = np.concatenate([w[len(t) :] for w, t in zip(columns["which"], columns["token"], strict=True)])
        many = many | np.isin((task << 32) | which, (again_task << 32) | again)
        left, right = _unpacked(group.column("left"), columns["high"], high), _unpacked(group.column("right"), [TOKEN - x.astype(np.int64) for x in columns["low"]], TOKEN - low)
        marks = np.packbits(repeated_distances(token, low, high, left, right, many), axis=1)
        some = np.flatnonzero(marks.any(axis=1))
        some = some[np.argsort(task[some], kind="stable")]
        edge = np.flatnonzero(np.append(True, task[some][1:] != task[some][:-1])) if len(some) else some
        ends = np.append(edge[1:], len(some))
        found = [(int(task[some[a]]), which[some[a:b]].tobytes(), marks[some[a:b]].tobytes()) for a, b in zip(edge, ends, strict=True)]
        n = len(found)
        told = pa.table({"task": pa.array([f[0] for f in found], pa.int64()), "which": pa.array([f[1] for f in found], pa.binary()), "marks": pa.array([f[2] for f in found], pa.binary()), "key": pa.nulls(n, pa.binary()), "start": pa.nulls(n, pa.binary())}, schema=schema)
        return pa.concat_tables([out, told])

    return run


_MARK_BYTES = (TOKEN + 8) // 8


def _covered(group: pa.Table) -> pa.Table:
    """Per task: marks meet the places of its suffixes; (key, begin and end of each covered run) of every document with one."""
    marked = group.filter(pc.is_valid(group.column("marks")))
    which = [np.frombuffer(x.as_buffer(), "<u4") for x in marked.column("which")]
    marks = np.zeros((1 + max((int(w.max()) for w in which), default=0), _MARK_BYTES), np.uint8)
    for w, m in zip(which, marked.column("marks"), strict=True):
        marks[w] = np.frombuffer(m.as_buffer(), np.uint8).reshape(-1, _MARK_BYTES)
    out = {}
    places = group.filter(pc.is_valid(group.column("key")))
    for w, k, p in zip(places.column("which"), places.column("key"), places.column("start"), strict=True):
        suffix, key, place = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((w, "<u4"), (k, "<i8"), (p, "<u4")))
        here = np.flatnonzero(suffix < len(marks))
        i, d = np.nonzero(np.unpackbits(marks[suffix[here]], axis=1)[:, : TOKEN + 1])
        i = here[i]
        start = place[i].astype(np.int64) - d
        order = np.lexsort((start, key[i]))
        keys, start = key[i][order], start[order]
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(keys)) - 1
        for name, a, b in zip(keys[first].tolist(), start[first].tolist(), (start[last] + LENGTH).tolist(), strict=True):
            out.setdefault(name, []).extend((a, b))
    return pa.table({"key": pa.array(list(out), pa.int64()), "spans": pa.array([np.array(v, "<i8").tobytes() for v in out.values()], pa.binary())})


def _cut(batches):
    """Remove the covered bytes of whole texts."""
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = utf8(batch.column("text"))
            rows = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                for s in spans:
                    s = np.frombuffer(s, "<i8").reshape(-1, 2)
                    np.add.at(edge, s[:, 0], 1)
                    np.subtract.at(edge, s[:, 1], 1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = own[~gone].tobytes()
                rows.append((len(own), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = [batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _spans(rows: DataFrame, size: int) -> DataFrame:
    """(key, spans) of the documents that lose bytes, written."""
    spark = rows.sparkSession
    parts = max(12, -(-size // COUNT_BYTES))
    tokens = rows.select("text").mapInArrow(_tokens(parts), "part int, tokens binary")
    again = written(tokens.groupBy("part").applyInArrow(_repeated, "part int, n long, tokens binary, sample array<long>"), "tokens")
    n_again = again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bits = min(MOST_BITS, max(1 << 16, 1 << (SPARSITY * max(n_again, 1) - 1).bit_length()))
    repeated = np.zeros(bits >> 3, np.uint8)
    for r in again.select("tokens").mapInArrow(_bitmaps(bits), "begin long, bits binary").toLocalIterator():
        repeated[r.begin : r.begin + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    buckets = max(12, -(-size // BUCKET_BYTES))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    # signed order is not the order of the tokens: the sample is shifted by half the range
    found = again.select(F.explode("sample").alias("t")).select(F.col("t").bitwiseXOR(F.lit(-(1 << 63))).alias("t")).agg(F.percentile_approx("t", shares, 10000).alias("p")).first().p
    splitters = np.unique(np.array(found or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    shared = spark.sparkContext.broadcast((repeated, splitters))

    schema = "part int, task long, token binary, low binary, high binary, left binary, right binary, which binary, many binary, key binary, start binary"
    suffixes = rows.select("key", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_suffixes(shared, bits), schema)
    told = written(suffixes.groupBy("part").applyInArrow(_bucket(splitters), "task long, which binary, marks binary, key binary, start binary"), "marks")
    spans = told.groupBy("task").applyInArrow(_covered, "key long, spans binary")
    spans = spans.groupBy("key").agg(F.collect_set("spans").alias("spans"))
    spans = written(spans, "spans")
    return spans


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``, the bytes that stay.

    Texts are UTF-8 bytes, null counts as empty, and a string never crosses
    documents.  Texts under 200 bytes lose nothing.  Repeated rows repeat each
    other; null ids and other columns do not matter.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0

    with small_batches(spark):
        spans = _spans(rows, size)
    maybe, certain = split_by_ids(rows, spans.select("key"), "key")
    met = maybe.join(spans, "key", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<binary>")).alias("spans"))
    cut = met.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("bigint")
    whole = certain.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
