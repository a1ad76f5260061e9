"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; full pieces are sequences of their own, so only
each document's remainder has to be placed.  The remainders are dealt at random
into blocks of about ``BLOCK_ITEMS``, each of which several islands solve.  An
island starts from best-fit packings in falling and in perturbed order and
breeds: a child gets whole well-filled bins of one parent, the other parent's
bins that hold any of the same documents are dissolved, and the documents thus
displaced are best-fitted again.  After each epoch the islands of a block hand
their elite to the next island.  An island stops as soon as it reaches the lower
bound on the number of bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftbase.llm.common import slices, utf8
from siftbase.llm.registry import query, table
from siftbase.llm.tokens import VOCABULARY, task_ids
from siftbase.session import written

CAPACITY, END = 2048, 0

#: Items of a block, islands per block, epochs between migrations, generations of an epoch, individuals of an island, elite that moves.
BLOCK_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4096, 3, 2, 8, 6, 2


def pieces(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, keep: bool = True) -> DataFrame:
    """One row per piece: ``_no`` (unique), ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is the ids of its whole text (null: empty) and the id ``END``.
    Longer ones than ``capacity`` are cut so that all pieces but the first are full.
    ``keep``: workers remember the parts of texts beyond a task (``task_ids``).
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        encoder, number = task_ids(vocabulary, keep), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = encoder.rows(*utf8(batch.column("text")))
                ids = np.insert(ids, offsets[1:], END).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                many = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = sizes - (many - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                begin = offsets[row] + start
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begin, begin + length, strict=True)]
                columns = [
                    pa.array(number + np.arange(len(row))), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                ]
                number += len(row)
                yield pa.RecordBatch.from_arrays(columns, names=["_no", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, "_no long, doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by the items of which no two share a bin."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum()))


def best_fit(sizes: np.ndarray, order, capacity: int, assigned: np.ndarray | None = None, loads: list[int] | None = None) -> tuple[np.ndarray, list[int]]:
    """Put the items of ``order`` one by one into the fullest bin that holds them, opening bins as needed."""
    assigned = np.full(len(sizes), -1, np.int64) if assigned is None else assigned
    loads = [] if loads is None else loads
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            left, b = capacity, len(loads)
            loads.append(0)
        else:
            left, b = room.pop(at)
        assigned[i] = b
        loads[b] += size
        if left > size:
            insort(room, (left - size, b))
    return assigned, loads


def fitness(loads, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: a part-full bin beside full ones is easier to empty."""
    return -len(loads), float(np.square(np.asarray(loads) / capacity).sum() / max(len(loads), 1))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Child of packing ``a`` with whole bins of ``b``."""
    loads_b = np.bincount(b, sizes).astype(np.int64)
    fill = loads_b / capacity
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    injected = rng.choice(well, max(1, len(well) // 3), replace=False)
    inside = np.isin(b, injected)
    keep = np.ones(int(a.max()) + 1, bool)
    keep[a[inside]] = False  # bins that hold an injected document are dissolved
    stays = keep[a]
    child = np.full(len(sizes), -1, np.int64)
    _, child[stays] = np.unique(a[stays], return_inverse=True)
    n = int(child.max()) + 1
    _, fresh = np.unique(b[inside], return_inverse=True)
    child[inside] = n + fresh
    loads = np.bincount(child[child >= 0], sizes[child >= 0]).astype(np.int64).tolist()
    displaced = np.flatnonzero(child < 0)
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    child, _ = best_fit(sizes, displaced, capacity, child, loads)
    return child


def evolve(sizes: np.ndarray, capacity: int, seed: int, migrants: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """One epoch of an island; the packings it ends with, best first."""
    if not len(sizes):
        return [np.zeros(0, np.int64)]
    rng, least = np.random.default_rng(seed), lower_bound(sizes, capacity)

    def rated(x):
        return fitness(np.bincount(x, sizes).astype(np.int64), capacity), x

    people = [rated(np.asarray(m)) for m in migrants]
    falling = np.argsort(-sizes, kind="stable")
    if not people:
        people.append(rated(best_fit(sizes, falling, capacity)[0]))
    while len(people) < population and -max(p[0] for p in people)[0] > least:
        noisy = np.argsort(-sizes * rng.uniform(0.8, 1.2, len(sizes)), kind="stable")
        people.append(rated(best_fit(sizes, noisy, capacity)[0]))
    for _ in range(generations):
        people.sort(key=lambda p: p[0], reverse=True)
        if -people[0][0][0] <= least:
            break
        children = []
        for _ in range(population // 2):
            i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
            children.append(rated(crossover(people[min(i, j)][1], people[max(i, j)][1], sizes, capacity, rng)))
        people = sorted(people + children, key=lambda p: p[0], reverse=True)[:population]
    return [p[1] for p in sorted(people, key=lambda p: p[0], reverse=True)]


def _epoch(capacity: int, epoch: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                seed = (row["block"] * 1009 + row["island"]) * 31 + epoch
                best = evolve(sizes, capacity, seed, row["migrants"])[:ELITE]
                bins = int(best[0].max()) + 1 if len(sizes) else 0
                fill = fitness(np.bincount(best[0], sizes).astype(np.int64), capacity)[1] if len(sizes) else 0.0
                columns = [[row["block"]], [row["island"]], [bins], [fill], [[b.tolist() for b in best]]]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "island", "bins", "fill", "elite"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``_no``, ``length`` and any other columns).

    Every piece gets a place, repeated rows each their own; a full piece is a
    sequence of its own (negative ids).  An empty table gives an empty result.
    """
    others = [c for c in items.columns if c not in ("_no", "sequence_id", "offset")]
    full = items.where(F.col("length") >= capacity).select(*others, (-1 - F.col("_no")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    small = items.where(F.col("length") < capacity)
    n_blocks = max(1, -(-small.count() // BLOCK_ITEMS))
    member = F.struct("length", "_no", *[c for c in others if c != "length"])
    blocks = small.groupBy(F.pmod(F.xxhash64("_no"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(member), asc=False).alias("items"))
    blocks = written(blocks, "blocks")
    sizes = blocks.select("block", F.col("items.length").alias("sizes"))
    asked = sizes.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("migrants"))
    result = None
    for epoch in range(epochs):
        if result is not None:
            moved = result.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guests"))
            met = result.join(moved, ["block", "island"]).select("block", "island", F.concat("elite", "guests").alias("migrants"))
            asked = met.join(sizes, "block").select("block", "sizes", "island", "migrants")
        spread = asked.repartition(min(n_blocks * islands, 4 * items.sparkSession.sparkContext.defaultParallelism), "block", "island")
        result = written(spread.mapInArrow(_epoch(capacity, epoch), "block long, island int, bins int, fill double, elite array<array<int>>"), "islands")
    best = result.groupBy("block").agg(F.max_by(F.col("elite")[0], F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))).alias("bins"))
    placed = blocks.join(best, "block").select("block", F.inline(F.arrays_zip("items", "bins"))).select("block", "items.*", "bins")
    sequence = (F.col("block") * BLOCK_ITEMS * 4 + F.col("bins")).alias("sequence_id")
    gathered = placed.select("*", sequence).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("_no", *others))).alias("_in"))
    before = F.expr("transform(sequence(1, size(_in)), i -> aggregate(slice(_in, 1, i - 1), 0L, (s, x) -> s + x.length))")
    laid = gathered.select("sequence_id", F.inline(F.arrays_zip("_in", before.alias("offset")))).select(*[F.col(f"_in.{c}").alias(c) for c in others], "sequence_id", "offset")
    return full.unionByName(laid)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, keep: bool = True) -> DataFrame:
    """Pack whole documents: one row per piece with its place (``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``).

    Null texts are empty ones, rows of equal id are packed each for itself, and an empty table gives an empty one.
    """
    return pack(written(pieces(docs, capacity, text, doc_id, vocabulary, keep), "pieces"), capacity)


def layouts(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, as (offset, doc_id, piece, start, length).  At most ``capacity`` of them, as each has an id."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"), F.sum("length").alias("length"))


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
