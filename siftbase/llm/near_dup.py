"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document is its set of hashed word shingles.  Two sets of s and l shingles
with a Jaccard index of 0.75 differ in at most H = (s + l) / 7 shingles.  The
hashed universe is cut into m > H segments, so in one segment at least both sets
agree; documents that agree in a segment meet in a bucket.

* Size bands: m follows from H, and H from the sizes.  A document indexes itself
  for the one or two values of m that its possible partners can need.
* Subsets: it indexes its first H + 1 segments that hold anything; fewer of a
  partner's can be touched, so empty segments need no bucket.
* No content, no bucket: an empty segment, or one that a deletion empties, would
  name a bucket that all such documents share.  These index a prefix instead:
  their first s - ceil(0.75 s) + 1 shingles, rare ones before frequent ones, of
  which two similar sets share one.  Sets that only equal sets can be similar to
  (H = 0) index nothing.
* Allocation by a fixed switch: up to DELETION_SEGMENTS segments each is worth two,
  as its one-deletion neighbourhood is indexed too, which gives few, long, selective
  segments; for larger H exact segments are used.  No cost is computed from the data.
* Frequent shingles: leaving any fixed set of shingles out of all documents never
  adds a difference.  Segments are therefore built from rare shingles.  A document
  with too few of them for the pigeonhole also indexes every rare shingle, and
  its segments over all shingles.  Two such documents that meet only in the
  latter share no rare shingle, so all rare ones are differences, and a bound on
  the numbers of rare and frequent shingles discards most of them unseen.

Buckets are numpy arrays dealt by hash.  Each bucket is first compared with its
most ordinary member only (a star); then buckets whose members are still in
different components are compared across these, large ones block by block.  So a group of near copies costs
a star, and no link between different components is lost.  Before sets are
fetched, a pair must pass the bound that parity sketches give: bits in which they
differ are never more than the shingles in which the sets do.  Documents with
equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftbase.llm.common import Powers, broadcast_hot, lowered, mixed, slices, small_batches, split_by_ids, utf8, windows, word_hashes
from siftbase.llm.registry import query, table
from siftbase.session import written

WIDTH, SIMILARITY = 5, Fraction(3, 4)

#: Counters for frequent shingles, how many may count as frequent, and from which number of documents on.
COUNTERS, MOST_FREQUENT, FREQUENT = 1 << 22, 1 << 17, 64

#: Up to so many segments, one-deletion neighbourhoods are used instead of exact segments.
DELETION_SEGMENTS = 4

#: Index rows of one group of buckets.
GROUP_ROWS = 1_000_000

#: Index rows that a task holds before it deals them out.
DEALT_ROWS = 400_000

#: Members of a torn bucket that one task compares with each other or with as many others.
BLOCK = 2048

#: Kinds of bucket: segments over rare shingles, single rare shingles, segments over all shingles, shingles of a prefix.
_R, _T, _F, _P = 0, 1, 2, 3


def most_differences(total, similarity: Fraction = SIMILARITY):
    """Largest symmetric difference of two sets with ``total`` elements together: floor(total (1 - t) / (1 + t))."""
    return total * (similarity.denominator - similarity.numerator) // (similarity.denominator + similarity.numerator)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, pw: Powers, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one row after the other, and the offsets of the rows.

    A row with fewer words than ``width`` has one shingle, its whole word sequence; a row without words none.
    """
    words, per_row = word_hashes(lowered(data), offsets, pw)
    h, row, _ = windows(words, per_row, width)
    few = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(few):
        first = np.cumsum(per_row) - per_row
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            here = per_row[few] > k
            whole[here] = mixed(whole[here] * np.uint64(0x9E3779B97F4A7C15) + words[first[few[here]] + k] + np.uint64(k + 1))
        h, row = np.concatenate([h, whole]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(per_row) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def node_of(hashes: np.ndarray) -> int | None:
    """64-bit name of a set; equal sets share it.  None for the empty set."""
    if not len(hashes):
        return None
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_sketches(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per set, bit i is the parity of the number of its hashes that fall on i; between one and two bits per hash, 64 at least."""
    sizes = np.diff(offsets)
    bits = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = begin[row] + (hashes & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip(begin[:-1] >> 3, begin[1:] >> 3, strict=True)]


def sketch_difference(x: bytes, y: bytes) -> int:
    """A lower bound on the symmetric difference of two sets; the longer sketch is folded."""
    if len(x) > len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while size > 8 * len(x):
        size //= 2
        b = (b >> size) ^ (b & ((1 << size) - 1))
    return (a ^ b).bit_count()


def _slot(h):
    return (h >> np.uint64(7)) & np.uint64(COUNTERS - 1)


def _described(batches):
    """Pass one.  Per document (doc_id, n_shingles, node); at a task's end (slot, documents) of its frequent shingles."""
    pw, counters, total = Powers(), np.zeros(COUNTERS, np.int32), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            h, offsets = shingle_sets(*utf8(batch.column("text")), pw)
            np.add.at(counters, _slot(h).astype(np.int64), 1)
            total += len(h)
            n = len(offsets) - 1
            nodes = [node_of(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int64()), pa.array(parity_sketches(h, offsets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "slot", "sketch"])
    often = np.flatnonzero(counters >= 3 + 6 * total / COUNTERS)
    none = pa.nulls(len(often), pa.int64())
    columns = [none, pa.array(counters[often].astype(np.int64)), none, pa.array(often), pa.nulls(len(often), pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "slot", "sketch"])


def _levels(sizes: np.ndarray):
    """For every set size the smallest and largest H of a possible pair."""
    low = most_differences(sizes + -(-sizes * SIMILARITY.numerator // SIMILARITY.denominator))
    high = most_differences(sizes + sizes * SIMILARITY.denominator // SIMILARITY.numerator)
    return low, high


def _few(h):
    """Segments of the deletion scheme for H differences: each counts twice."""
    return (h + 2) // 2


def _log_segments(h):
    """log2 of the segments of the exact scheme for H: enough that most rows have H + 1 with content."""
    return np.ceil(np.log2(1.2 * (np.asarray(h) + 1) + 2)).astype(np.int64)


_DELETION_H = 2 * DELETION_SEGMENTS - 1


def _content(values, row, segment):
    """Sum over each (row, segment) of consecutive elements: (sum, row, segment, first element)."""
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(first)
    return np.add.reduceat(values, first) if len(first) else values[:0], row[first], segment[first], first


def _name(content, segment, level, mode):
    salt = (np.asarray(segment).astype(np.uint64) << np.uint64(12)) + (np.asarray(level).astype(np.uint64) << np.uint64(3)) + np.uint64(mode)
    return mixed(content + mixed(salt + np.uint64(0x51ED270B0A1F)))


def _exact_segments(h, row, log_m, needed, mode):
    """Bucket names (and rows) of the first ``needed`` filled segments of every row; and how many filled ones a row has."""
    segment = h >> (np.uint64(64) - log_m[row].astype(np.uint64))
    content, rows, segments, _ = _content(mixed(h), row, segment)
    starts = np.searchsorted(rows, np.arange(len(log_m)))
    nth = np.arange(len(rows)) - starts[rows]
    keep = nth < needed[rows]
    filled = np.bincount(rows, minlength=len(log_m))
    return _name(content, segments, log_m[rows] + 64, mode)[keep], rows[keep], filled


def index_entries(h: np.ndarray, offsets: np.ndarray, frequent: np.ndarray):
    """Bucket names of every set: (name, row, True for meetings over all shingles), and rare and frequent shingles per row."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    is_frequent = frequent[_slot(h).astype(np.int64)]
    n_frequent = np.bincount(row[is_frequent], minlength=n)
    low, high = _levels(sizes)
    names, rows, full = [], [], []
    lacking = np.zeros(n, bool)  # rows with a segment that holds too little to name a bucket

    def add(name, which, over_all=False):
        names.append(name)
        rows.append(which)
        full.append(np.full(len(name), over_all))

    # one-deletion neighbourhoods of few segments
    for k in range(1, DELETION_SEGMENTS + 1):
        use = (high > 0) & (_few(np.maximum(low, 0)) <= k) & (_few(np.minimum(high, _DELETION_H)) >= k) & (low <= _DELETION_H)
        mine = use[row]
        hh, rr = h[mine], row[mine]
        if not len(hh):
            continue
        segment = ((hh >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        value = mixed(hh)
        content, rows_, segments, first = _content(value, rr, segment)
        add(_name(content, segments, k, _R), rows_)
        length = np.diff(np.append(first, len(hh)))
        more = np.repeat(length > 1, length)
        add(_name(np.repeat(content, length) - value, segment, k, _R)[more], rr[more])
        lacking[rows_[length == 1]] = True
        lacking |= use & (np.bincount(rows_, minlength=n) < k)

    # exact segments
    large = (sizes > 0) & (high > _DELETION_H)
    first_log, last_log = _log_segments(np.maximum(low, _DELETION_H + 1)), _log_segments(np.maximum(high, 1))
    poor_any = np.zeros(n, bool)
    for step in range(2):
        log_m = first_log + step
        use = large & (log_m <= last_log)
        if not use.any():
            continue
        top = np.minimum(high, ((1 << log_m) - 2) * 5 // 6 - 1)  # the largest H of this m
        top = np.where(_log_segments(np.maximum(top + 1, 0)) == log_m, np.minimum(top + 1, high), top)
        needed = top + 1
        rare = use[row] & ~is_frequent
        name, which, filled = _exact_segments(h[rare], row[rare], log_m, needed, _R)
        add(name, which)
        poor = use & (filled < needed)
        poor_any |= poor
        if poor.any():
            mine = poor[row]
            name, which, filled = _exact_segments(h[mine], row[mine], log_m, needed, _F)
            add(name, which, True)
            lacking |= poor & (filled < needed)
    token = poor_any[row] & ~is_frequent
    add(_name(h[token], np.zeros(int(token.sum()), np.uint64), 0, _T), row[token])
    mine = np.flatnonzero(lacking[row])
    mine = mine[np.lexsort((h[mine], is_frequent[mine], row[mine]))]
    nth = np.arange(len(mine)) - np.searchsorted(row[mine], row[mine])
    prefix = sizes + sizes * -SIMILARITY.numerator // SIMILARITY.denominator + 1
    mine = mine[nth < prefix[row[mine]]]
    add(_name(h[mine], np.zeros(len(mine), np.uint64), 0, _P), row[mine])
    return np.concatenate(names), np.concatenate(rows), np.concatenate(full), sizes - n_frequent, n_frequent


_ENTRY = np.dtype([("name", "<u4"), ("full", "?"), ("node", "<i8"), ("rare", "<i4"), ("frequent", "<i4")])


def _indexed(frequent_slots, parts: int):
    """Pass two.  Entries of all buckets, dealt to ``parts`` groups by name; equal sets of a task are indexed once."""

    def run(batches):
        pw, seen, waiting, held = Powers(), set(), [], 0
        frequent = np.unpackbits(np.frombuffer(frequent_slots.value, np.uint8)).astype(bool)

        def dealt():
            entries = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            group = (entries[0] >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(group.astype(np.int32), kind="stable")
            edges = np.searchsorted(group[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            columns = [[] for _ in range(5)]
            for p in some:
                take = order[edges[p] : edges[p + 1]]
                columns[0].append(entries[0][take].astype("<u4").tobytes())
                columns[1].append(entries[1][take].tobytes())
                for k, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4")):
                    columns[k].append(entries[k][take].astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], names=["part", "name", "full", "node", "rare", "frequent"])

        for whole in batches:
            for batch in slices(whole, "text"):
                h, offsets = shingle_sets(*utf8(batch.column("text")), pw)
                nodes = [node_of(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                fresh = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                sizes = np.diff(offsets)
                keep = np.repeat(fresh, sizes)
                h, offsets = h[keep], np.concatenate([[0], np.cumsum(sizes[fresh])])
                if not len(h):
                    continue
                name, row, full, rare, often = index_entries(h, offsets, frequent)
                node = np.array([x for x, ok in zip(nodes, fresh, strict=True) if ok], np.int64)
                waiting.append((name, full, node[row], rare[row].astype(np.int32), often[row].astype(np.int32)))
                held += len(name)
                if held >= DEALT_ROWS:
                    yield dealt()
                    waiting, held = [], 0
        if waiting:
            yield dealt()

    return run


def _compatible(rare_a, often_a, rare_b, often_b, full):
    """Whether two sets with these numbers can differ in few enough shingles; ``full``: they share no rare shingle."""
    most = most_differences(rare_a + often_a + rare_b + often_b)
    rare = np.where(full, rare_a + rare_b, np.abs(rare_a - rare_b))
    return rare + np.abs(often_a - often_b) <= most


def _met(chunk: pa.Table) -> pa.Table:
    """One group of buckets: star pairs (kind 0), and the members of buckets of three or more (kind 1)."""
    name, full, node, rare, often = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in chunk.column(c)]) for c, kind in (("name", "<u4"), ("full", "?"), ("node", "<i8"), ("rare", "<i4"), ("frequent", "<i4")))
    _, count = np.unique(name, return_counts=True)
    order = np.argsort(name, kind="stable")
    order = order[np.repeat(count > 1, count)]
    # the most ordinary member of a bucket, the one with fewest rare shingles, comes first
    order = order[np.lexsort((node[order], -often[order], rare[order], full[order], name[order]))]
    name, full, node, rare, often = name[order], full[order], node[order], rare[order], often[order]
    bucket = name.astype(np.int64) * 2 + full
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])
    bucket, full, node, rare, often = bucket[new], full[new], node[new], rare[new], often[new]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    length = np.diff(np.append(edge, len(bucket)))
    if len(edge):  # of buckets with the same members one is enough
        members = np.add.reduceat(mixed(node.astype(np.uint64)), edge) + full[edge]
        _, once = np.unique(members, return_index=True)
        chosen = np.zeros(len(edge), bool)
        chosen[once] = True
        keep = np.repeat(chosen & (length > 1), length)
        bucket, full, node, rare, often = bucket[keep], full[keep], node[keep], rare[keep], often[keep]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else edge[:0]
        length = np.diff(np.append(edge, len(bucket)))
    head = np.repeat(edge, length)
    pair = (np.arange(len(node)) != head) & _compatible(rare[head], often[head], rare, often, full)
    a, b = np.minimum(node[head], node)[pair], np.maximum(node[head], node)[pair]
    ab = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    many = np.repeat(length > 2, length)
    part = chunk.column("part")[0].as_py()
    zero = np.zeros(len(ab), np.int32)
    return pa.table(
        {
            "kind": np.concatenate([zero, np.ones(int(many.sum()), np.int32)]),
            "a": np.concatenate([ab[:, 0], (np.int64(part) << 33) + bucket[many]]),
            "b": np.concatenate([ab[:, 1], node[many]]),
            "rare": np.concatenate([zero, rare[many].astype(np.int32)]),
            "frequent": np.concatenate([zero, often[many].astype(np.int32)]),
            "full": np.concatenate([zero.astype(bool), full[many]]),
        }
    )


def _across(batches):
    """Pairs of compatible members of different components, by bucket and pair of blocks; the rows come sorted by these."""
    rest = None

    def edges(t: pa.Table):
        keys = [t.column(c).to_numpy() for c in ("bucket", "low", "high")]
        return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))

    def pairs(t: pa.Table):
        node, label, rare, often, full, low, high, block = (t.column(c).to_numpy() for c in ("node", "label", "rare", "frequent", "full", "low", "high", "block"))
        sketch, total = t.column("sketch").to_pylist(), rare.astype(np.int64) + often
        edge = edges(t)
        found = []
        for a, b in zip(edge, np.append(edge[1:], len(node)), strict=True):
            for i in range(a, b, 256):
                s, o = slice(i, min(i + 256, b)), slice(i, b)
                ok = (label[s, None] != label[None, o]) & ((low[a] == high[a]) | (block[s, None] != block[None, o])) & (np.arange(s.start, s.stop)[:, None] < np.arange(i, b)[None, :])
                x, y = np.nonzero(ok)
                x, y = x + i, y + i
                fine = _compatible(rare[x], often[x], rare[y], often[y], full[x])
                x, y = x[fine], y[fine]
                most = most_differences(total[x] + total[y])
                fine = np.fromiter((sketch_difference(sketch[i], sketch[j]) <= h for i, j, h in zip(x, y, most, strict=True)), bool, len(x))
                found.append(np.stack([np.minimum(node[x], node[y])[fine], np.maximum(node[x], node[y])[fine]], axis=1))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        last = int(edges(t)[-1])  # the last one may go on
        if last:
            yield pairs(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _sets(batches):
    pw = Powers()
    for whole in batches:
        for batch in slices(whole, "text"):
            h, offsets = shingle_sets(*utf8(batch.column("text")), pw)
            sets = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            own = [i for i, (x, node) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if node_of(x) == node]  # ids may repeat
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "hashes"])


def _verified(batches):
    """Pairs whose sets are similar enough: 100 * intersection >= 75 * union."""
    t = SIMILARITY
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked[i] = t.denominator * common >= t.numerator * (len(x) + len(y) - common)
        at = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at))], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that it reaches.

    Every node points to its smallest neighbour, pointers are followed to their
    ends, and the links are contracted to these, until none is left.  Each step is
    an aggregate or a join on narrow rows and is written, so a lost executor costs
    one step.
    """
    labels, left = None, links.select("a", "b").where("a <> b")
    while True:
        both = left.union(left.select("b", "a"))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "pointers")
        while True:
            onward = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = written(up.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "pointers")
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            onward = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("label").alias("la")), up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = written(left.join(to_a, "a").join(to_b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "contracted")
        if left.isEmpty():
            return written(labels, "labels")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are lower-cased (A to Z) runs of non-blanks; documents link at a
    Jaccard index of 0.75 or more of their sets of 5-word shingles.  A text
    without words, null or empty, has no shingles and its own id as component.  A
    row with a null id links with nothing and has a null component.  Rows that
    share an id count as one document in components.  An empty table gives an
    empty result; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, text, doc_id)


def _near_duplicates(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    described = written(rows.mapInArrow(_described, "doc_id long, n_shingles long, node long, slot long, sketch binary"), "described")
    known = described.where("slot IS NULL").select("doc_id", "n_shingles", "node")
    sketches = described.where("node IS NOT NULL AND doc_id IS NOT NULL").select("node", "n_shingles", "sketch")
    often = described.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= FREQUENT)
    slots = np.array([r.slot for r in often.orderBy(F.desc("n"), "slot").limit(MOST_FREQUENT).select("slot").toLocalIterator()], np.int64)
    frequent = np.zeros(COUNTERS, bool)
    frequent[slots] = True
    shared = spark.sparkContext.broadcast(np.packbits(frequent).tobytes())

    linkable = known.where("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(linkable.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "classes")
    size = known.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    parts = max(1, -(-size.shingles // (2 * GROUP_ROWS)))
    entries = rows.where("doc_id IS NOT NULL").mapInArrow(_indexed(shared, parts), "part int, name binary, full binary, node binary, rare binary, frequent binary")
    met = written(entries.groupBy("part").applyInArrow(_met, "kind int, a long, b long, rare int, frequent int, full boolean"), "met")

    stars = written(met.where("kind = 0").select("a", "b").distinct(), "stars")
    members = met.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("node"), "rare", "frequent", "full")
    named = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(members.select("node")).distinct()
    sketches = written(sketches.join(named, "node").groupBy("node").agg(F.max(F.struct("n_shingles", "sketch")).alias("s")).select("node", "s.*"), "sketches")
    links = written(_linked(written(_close(stars, sketches), "close"), rows, classes), "links")
    labels = components(links)

    told = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    torn = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    told = told.join(torn, "bucket").join(sketches.select("node", "sketch"), "node")
    # a large bucket is dealt as pairs of blocks
    told = told.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    told = told.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")
    cross = told.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(_across, "a long, b long").distinct()
    more = written(_linked(written(cross.join(stars, ["a", "b"], "left_anti"), "cross"), rows, classes), "links")
    labels = components(links.union(more))

    grouped = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    grouped = written(grouped.join(smallest, "label").select("node", "n_rows", "component_id"), "grouped")
    alone = known.where("node IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.unionByName(broadcast_hot(linkable, grouped, "node", "n_rows", size.rows).select("doc_id", "n_shingles", "component_id"))


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``; only rows whose id may be are shuffled."""
    ids = written(ids, "dropped")
    maybe, certain = split_by_ids(docs, ids, doc_id)
    return certain.unionByName(maybe.join(ids.distinct(), doc_id, "left_anti"))


def _with_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted documents; a bitmap of their ids keeps the other texts out of the shuffle."""
    maybe, _ = split_by_ids(rows, wanted.select("doc_id"), "doc_id")
    return maybe.join(wanted, "doc_id").select("node", "text").mapInArrow(_sets, "node long, hashes binary")


def _near(batches):
    """Pairs whose sketches allow the similarity."""
    for batch in batches:
        total = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
        x, y, most = batch.column("x").to_pylist(), batch.column("y").to_pylist(), most_differences(total)
        at = pa.array(np.flatnonzero([sketch_difference(a, b) <= h for a, b, h in zip(x, y, most, strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    x = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("nx"))
    y = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("ny"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(_near, "a long, b long")


def _linked(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of nodes that are similar enough; the sets of these nodes are made from their texts."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(named, "node").select(F.col("first_id").alias("doc_id"), "node"), "wanted")
    sets = written(_with_sets(rows, wanted), "sets")
    x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
