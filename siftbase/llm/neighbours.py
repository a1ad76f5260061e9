"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

A neighbour of a neighbour is likely a neighbour.  Every node keeps its best
``NEIGHBOURS`` so far; in a round it introduces its neighbours, forward and
reverse, to each other: the vectors of the members of a block of nodes come to
the block, packed in one row per block that sends them, numpy compares them, and each comparison that beats a
node's worst neighbour goes to that node's block.  Rounds end when few lists
change.  The start is one comparison within stretches of vectors that lie next
to each other on a random line.

A query keeps the best ``BEAM`` nodes it has seen and expands the best that it
has not expanded, until none is left.  What it wants scored goes to the blocks of
those nodes, packed in one row per block of queries and block of nodes, and the
cosines come back.  The beam's head is then scored on the original vectors in
double precision.

Nodes are distinct vectors, so copies cannot fill the lists of each other; each
node knows the smallest ids of its copies.  Blocks of nodes hold about ``BLOCK``
of them by a hash, so a task's memory does not grow with the input.  Vectors
travel as one byte per component; only the final scores read the originals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.llm.common import broadcast_hot, lean_cogroup, lean_map, mixed, utf8
from siftbase.llm.registry import query, table
from siftbase.session import written

#: Length of a node's list, members of a list that a round introduces, most rounds, and the share of changed entries that ends them.
NEIGHBOURS, SAMPLED, ROUNDS, CHANGED = 40, 20, 12, 0.04

#: Nodes of a block; stretches compared at the start, and the random lines they lie on.
BLOCK, LINES = 2048, 2

#: Nodes a query keeps, expands at a time and scores exactly, for each wanted neighbour; queries of a block; nodes that every query starts from beside its own.
BEAM, EXPANDED, EXACT, QUERY_BLOCK, STARTS = 128, 32, 6, 128, 16

#: Comparisons that a task holds before it keeps the nearest of each node.
FOUND = 300_000

#: Below every cosine.
NONE = np.float32(-9)

_GRAPH = "block int, node long, code binary, nbr binary, sim binary, fresh binary, kth float, n_fresh long"
_EDGES = "block int, u binary, w binary, s binary"
_STATE = "block int, query long, code binary, beam binary, sim binary, done binary, pending binary, n_open long"
_ASKS = "block int, asker int, query binary, code binary, place binary, w binary"
_NEEDS = "block int, asker int, w binary"
_SENT = "block int, node binary, code binary, kth binary"
_TOLD = "block int, query binary, w binary, s binary"

#: Queries whose questions are packed at a time, and pairs that are scored at a time.
PACKED, PAIRS = 512, 16_384


def _flat(column, kind) -> np.ndarray:
    """All values of a column of packed arrays, end to end."""
    return np.frombuffer(utf8(column)[0].tobytes(), kind)


def _rows(column, kind, width: int) -> np.ndarray:
    return _flat(column, kind).reshape(-1, width).copy()


def _packed(values: np.ndarray) -> pa.Array:
    """One packed array per row of a matrix."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)], pa.binary())


def block_of(nodes: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(nodes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(blocks)).astype(np.int32)


def _draw(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A random order of pairs that a rerun draws again."""
    return mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn))


def _nth(keys: np.ndarray) -> np.ndarray:
    """Place of each entry among those of equal key; keys are sorted."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _best(keys: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the entries with the ``most`` lowest ranks of each key, by key and rank."""
    order = np.lexsort((rank, keys))
    return order[_nth(keys[order]) < most]


def _filled(rows: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
    """Matrix of n rows with the values of each row, in order, and -1 behind them; rows are sorted."""
    out = np.full((n, width), -1, np.int64)
    out[rows, _nth(rows)] = values
    return out


def _by_block(block: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per block with its entries packed."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(block))
    packed = [pa.array([values[order[a:b]].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for values in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(block[cut], pa.int32()), *packed], names=["block", *columns])


def coded(vectors: np.ndarray) -> np.ndarray:
    """Rows of bytes: each direction as one signed byte per component, then its scale."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    top = np.abs(unit).max(axis=1)
    steps = np.rint(unit / top[:, None] * 127).astype(np.int8)
    scale = (1 / np.linalg.norm(steps.astype(np.float64), axis=1)).astype("<f4")
    return np.concatenate([steps.view(np.uint8), scale[:, None].view(np.uint8)], axis=1)


def directions(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of ``coded``."""
    return codes[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(codes[:, -4:]).view("<f4")


@dataclass
class Index:
    """A built graph.  ``nodes``: node, embedding; ``members``: node, id (the smallest of its copies); ``graph``: block, node, code, adjacent (packed ids)."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    dimension: int
    blocks: int
    n_nodes: int
    neighbours: int
    rounds: int


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """``id``, ``embedding`` of the rows that take part, and their dimension.

    Left out: null ids, vectors that are null, zero or hold a null or non-finite
    component, and vectors of another length than most have (of lengths equally
    frequent, the longest stands), since they have no cosine with the rest.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("embedding")).where("id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = common.d if common else 0
    return rows.where(F.size("embedding") == dimension), dimension


def _classes(rows: DataFrame, copies: int) -> DataFrame:
    """``node``, ``embedding``, ``id``, ``nth``: of each distinct vector, the ``copies`` smallest ids.

    The limit on the window cuts each task's rows before the shuffle, so a vector
    with very many copies sends a few rows a task.
    """
    rows = rows.withColumn("_hash", F.xxhash64("embedding")).groupBy("_hash", "embedding", "id").agg(F.lit(1).alias("_one"))
    same = Window.partitionBy("_hash", "embedding")
    ranked = rows.withColumn("nth", F.row_number().over(same.orderBy("id"))).where(F.col("nth") <= copies)
    numbered = ranked.withColumn("_at", F.monotonically_increasing_id())
    return written(numbered.withColumn("node", F.min("_at").over(same)).select("node", "embedding", "id", "nth"), "classes")


def _coded_rows(nodes: DataFrame, dimension: int, blocks: int, width: int) -> DataFrame:
    """Nodes with codes, empty lists and their places on the random lines."""
    lines = np.random.default_rng(3).standard_normal((dimension, LINES))
    schema = f"{_GRAPH}, " + ", ".join(f"line{k} double" for k in range(LINES))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dimension)
            node = batch.column("node").to_numpy()
            codes = coded(values)
            nothing = [np.full((n, width), -1, np.int64), np.full((n, width), NONE), np.zeros((n, width), np.uint8)]
            places = directions(codes) @ lines
            columns = [pa.array(block_of(node, blocks)), pa.array(node), _packed(codes), *map(_packed, nothing), pa.array(np.full(n, NONE)), pa.array(np.zeros(n, np.int64)), *[pa.array(places[:, k]) for k in range(LINES)]]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "node", "code", "nbr", "sim", "fresh", "kth", "n_fresh", *[f"line{k}" for k in range(LINES)]])

    return written(nodes.mapInArrow(lean_map(run), schema), "codes")


def _stretches(dimension: int, blocks: int, width: int, block: int):
    """Best neighbours of every vector among those next to it in its partition."""

    def compared(nodes, codes):
        x = directions(codes)
        n = len(nodes)
        most = min(width, n - 1)
        if most < 1:
            return
        for at in range(0, n, 512):
            sims = x[at : at + 512] @ x.T
            sims[np.arange(len(sims)), at + np.arange(len(sims))] = NONE
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            u = np.repeat(nodes[at : at + 512], most)
            yield _by_block(block_of(u, blocks), u=u, w=nodes[top].ravel(), s=np.take_along_axis(sims, top, 1).ravel().astype("<f4"))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            node, codes = batch.column("node").to_numpy(), _rows(batch.column("code"), np.uint8, dimension + 4)
            held.append((node, codes))
            n += len(node)
            while n >= 2 * block:
                node, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from compared(node[:block], codes[:block])
                held, n = [(node[block:], codes[block:])], n - block
        if n:
            yield from compared(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _chosen(node: np.ndarray, nbr: np.ndarray, fresh: np.ndarray, sampled: int, turn: int) -> np.ndarray:
    """Which fresh entries of each list this round introduces: the same ones whoever asks."""
    draw = _draw(np.broadcast_to(node[:, None], nbr.shape), nbr, turn)
    draw[fresh == 0] = np.uint64(2**64 - 1)
    out = np.zeros(nbr.shape, bool)
    np.put_along_axis(out, np.argsort(draw, axis=1)[:, :sampled], True, axis=1)
    return out & (fresh > 0)


def _reversed(blocks: int, width: int, sampled: int, turn: int):
    """Each list entry seen from its other end; a task sends each node at most ``sampled`` fresh and as many old ones."""

    def run(batches):
        for batch in batches:
            node, nbr, fresh = batch.column("node").to_numpy(), _rows(batch.column("nbr"), np.int64, width), _rows(batch.column("fresh"), np.uint8, width)
            chosen = _chosen(node, nbr, fresh, sampled, turn)
            send = (nbr >= 0) & (chosen | (fresh == 0))
            u, w, is_fresh = nbr[send], np.broadcast_to(node[:, None], nbr.shape)[send], chosen[send].astype(np.uint8)
            keep = _best(u * 2 + is_fresh, _draw(u, w, turn), sampled)
            yield _by_block(block_of(u[keep], blocks), u=u[keep], w=w[keep], s=is_fresh[keep])

    return run


def _members(width: int, sampled: int, turn: int):
    """Of a block: its nodes, and the fresh and old members of each node's introductions, packed in one row."""

    def run(key, graph: pa.Table, edges: pa.Table) -> pa.Table:
        node = graph.column("node").to_numpy()
        order = np.argsort(node)
        node = node[order]
        nbr, fresh = _rows(graph.column("nbr"), np.int64, width)[order], _rows(graph.column("fresh"), np.uint8, width)[order]
        chosen = _chosen(node, nbr, fresh, sampled, turn)
        u, w, is_fresh = _flat(edges.column("u"), np.int64), _flat(edges.column("w"), np.int64), _flat(edges.column("s"), np.uint8)
        n, parts = len(node), []
        at = np.searchsorted(node, u)
        for flag, forward, most in ((1, chosen, sampled), (0, (fresh == 0) & (nbr >= 0), width)):
            some = np.flatnonzero(is_fresh == flag)
            some = some[_best(at[some], _draw(u[some], w[some], turn), sampled)]
            rows = np.nonzero(forward)[0]
            parts.append(np.concatenate([_filled(rows, nbr[forward], n, most), _filled(at[some], w[some], n, sampled)], axis=1))
        row = [pa.array([int(key[0].as_py())], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (node, *parts)]]
        return pa.table(row, names=["block", "nodes", "fresh", "old"])

    return run


def _needed(blocks: int):
    """Distinct members of the introductions of each block, one row per block that holds them."""

    def run(batches):
        for batch in batches:
            for asker, *lists in zip(*[batch.column(c).to_pylist() for c in ("block", "fresh", "old")], strict=True):
                w = np.unique(np.concatenate([np.frombuffer(ids or b"", np.int64) for ids in lists]))
                w = w[w >= 0]
                asks = _by_block(block_of(w, blocks), w=w)
                yield pa.RecordBatch.from_arrays([asks.column("block"), pa.array(np.full(asks.num_rows, asker, np.int32)), asks.column("w")], names=["block", "asker", "w"])

    return run


def _sent(dimension: int):
    """The vectors of a block's nodes for every block that needs some, packed in one row for each."""

    def run(key, needs: pa.Table, graph: pa.Table) -> pa.Table:
        ids = graph.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        codes, kth = _rows(graph.column("code"), np.uint8, dimension + 4)[order], graph.column("kth").to_numpy()[order].astype("<f4")
        askers, packed = [], []
        for asker, w in zip(needs.column("asker").to_pylist(), needs.column("w").to_pylist(), strict=True) if len(ids) else []:
            at = np.searchsorted(ids, np.frombuffer(w, np.int64))
            askers.append(asker)
            packed.append((ids[at].tobytes(), codes[at].tobytes(), kth[at].tobytes()))
        columns = [pa.array(askers, pa.int32()), *[pa.array([p[i] for p in packed], pa.binary()) for i in range(3)]]
        return pa.table(columns, names=["block", "node", "code", "kth"])

    return run


def _cut(u, w, s, width):
    """Distinct (u, w), the ``width`` nearest of each u."""
    order = np.lexsort((w, u))
    u, w, s = u[order], w[order], s[order]
    once = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.zeros(0, bool)
    u, w, s = u[once], w[once], s[once]
    keep = _best(u, -s, width)
    return u[keep], w[keep], s[keep]


def _introduced(dimension: int, blocks: int, width: int, sampled: int):
    """Compare the members of every node of a block; keep what beats the worst neighbour of either end."""

    def run(key, lists: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = _flat(vectors.column("node"), np.int64)
        order = np.argsort(ids)
        ids = ids[order]
        x = directions(_rows(vectors.column("code"), np.uint8, dimension + 4)[order])
        kth = _flat(vectors.column("kth"), np.float32)[order]
        fresh, old = _rows(lists.column("fresh"), np.int64, 2 * sampled), _rows(lists.column("old"), np.int64, width + sampled)
        best, found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)], []
        for at in range(0, len(fresh), 128):
            a = fresh[at : at + 128]
            b = np.concatenate([a, old[at : at + 128]], axis=1)
            i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
            i, j = np.minimum(i, len(ids) - 1), np.minimum(j, len(ids) - 1)
            sims = x[i] @ x[j].transpose(0, 2, 1)
            ok = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :])
            ok[:, :, : a.shape[1]] &= np.triu(np.ones((a.shape[1], a.shape[1]), bool), 1)  # a pair of two fresh members once
            ok &= (sims > kth[i][:, :, None]) | (sims > kth[j][:, None, :])
            r, p, q = np.nonzero(ok)
            u, w, s = i[r, p], j[r, q], sims[r, p, q]
            for one, other in ((u, w), (w, u)):
                better = s > kth[one]
                found.append((one[better], other[better], s[better]))
            if sum(len(f[0]) for f in found) > FOUND or at + 128 >= len(fresh):
                best = _cut(*(np.concatenate(c) for c in zip(best, *found, strict=True)), width)
                found = []
        u, w = ids[best[0]] if len(ids) else best[0], ids[best[1]] if len(ids) else best[1]
        return pa.Table.from_batches([_by_block(block_of(u, blocks), u=u, w=w, s=best[2].astype("<f4"))])

    return run


def _merged(dimension: int, width: int, sampled: int, turn: int):
    """Lists of a block with the better of what they hold and what was found; entries that were introduced are no longer fresh."""

    def run(key, graph: pa.Table, edges: pa.Table) -> pa.Table:
        node = graph.column("node").to_numpy()
        order = np.argsort(node)
        node, n = node[order], len(node)
        nbr, sim, fresh = (_rows(graph.column(c), kind, width)[order] for c, kind in (("nbr", np.int64), ("sim", np.float32), ("fresh", np.uint8)))
        fresh[_chosen(node, nbr, fresh, sampled, turn)] = 0
        held = nbr >= 0
        rows = np.nonzero(held)[0]
        u = np.concatenate([rows, np.searchsorted(node, _flat(edges.column("u"), np.int64))])
        w = np.concatenate([nbr[held], _flat(edges.column("w"), np.int64)])
        s = np.concatenate([sim[held], _flat(edges.column("s"), np.float32)])
        f = np.concatenate([fresh[held], np.ones(len(u) - len(rows), np.uint8)])
        later = np.arange(len(u)) >= len(rows)
        first = np.lexsort((later, w, u))
        u, w, s, f = u[first], w[first], s[first], f[first]
        once = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.zeros(0, bool)
        u, w, s, f = u[once], w[once], s[once], f[once]
        keep = _best(u, -s, width)
        u, w, s, f = u[keep], w[keep], s[keep], f[keep]
        place = _nth(u)
        nbr, sim, fresh = np.full((n, width), -1, np.int64), np.full((n, width), NONE), np.zeros((n, width), np.uint8)
        nbr[u, place], sim[u, place], fresh[u, place] = w, s, f
        code = graph.column("code").combine_chunks().take(pa.array(order))
        columns = [pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(node), code, _packed(nbr), _packed(sim), _packed(fresh), pa.array(sim[:, -1]), pa.array(fresh.sum(axis=1, dtype=np.int64))]
        return pa.table(columns, names=["block", "node", "code", "nbr", "sim", "fresh", "kth", "n_fresh"])

    return run


def _adjacent(width: int):
    """Each list with the nearest of the nodes that list this one: the edges of a walk."""

    def run(key, graph: pa.Table, edges: pa.Table) -> pa.Table:
        node = graph.column("node").to_numpy()
        order = np.argsort(node)
        node = node[order]
        nbr = _rows(graph.column("nbr"), np.int64, width)[order]
        at, w, s = np.searchsorted(node, _flat(edges.column("u"), np.int64)), _flat(edges.column("w"), np.int64), _flat(edges.column("s"), np.float32)
        keep = _best(at, -s, width)
        both = np.concatenate([nbr, _filled(at[keep], w[keep], len(node), width)], axis=1)
        block = pa.array(np.full(len(node), key[0].as_py(), np.int32))
        return pa.table([block, pa.array(node), graph.column("code").combine_chunks().take(pa.array(order)), _packed(both)], names=["block", "node", "code", "adjacent"])

    return run


def _backward(blocks: int, width: int):
    """All list entries from their other end, the nearest ``width`` of each node and task."""

    def run(batches):
        for batch in batches:
            node, nbr, sim = batch.column("node").to_numpy(), _rows(batch.column("nbr"), np.int64, width), _rows(batch.column("sim"), np.float32, width)
            held = nbr >= 0
            u, w, s = nbr[held], np.broadcast_to(node[:, None], nbr.shape)[held], sim[held]
            keep = _best(u, -s, width)
            yield _by_block(block_of(u[keep], blocks), u=u[keep], w=w[keep], s=s[keep])

    return run


def build(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", copies: int = 6, neighbours: int = NEIGHBOURS, sampled: int = SAMPLED,
    rounds: int = ROUNDS, changed: float = CHANGED, block: int = BLOCK,
) -> Index:
    """The neighbour graph of all usable vectors of ``rows`` (see ``usable``).

    ``copies`` ids of each distinct vector are kept, the smallest.  Rows of equal
    id and vector count once; rows of equal id and different vectors stand for
    themselves.  An empty table gives an empty graph; other columns are left out.
    """
    used, dimension = usable(rows, vec_id, embedding)
    classes = _classes(used, copies)
    nodes = classes.where("nth = 1").select("node", "embedding")
    n = nodes.count()
    blocks = max(1, -(-n // block))
    start = _coded_rows(nodes, dimension, blocks, neighbours)
    lines = []
    for k in range(LINES):
        ranged = start.select("node", "code", f"line{k}").repartitionByRange(blocks, f"line{k}").sortWithinPartitions(f"line{k}").select("node", "code")
        lines.append(ranged.mapInArrow(lean_map(_stretches(dimension, blocks, neighbours, block)), _EDGES))
    found = lines[0]
    for more in lines[1:]:
        found = found.unionByName(more)
    columns = [c.split()[0] for c in _GRAPH.split(", ")]

    def merge(graph, edges, turn):
        made = graph.select(*columns).groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(lean_cogroup(_merged(dimension, neighbours, sampled, turn)), _GRAPH)
        return written(made, "graph")

    graph, turn = merge(start, found, 0), 0
    while turn < rounds and (graph.agg(F.sum("n_fresh")).first()[0] or 0) > changed * n * neighbours:
        turn += 1
        back = graph.select("node", "nbr", "fresh").mapInArrow(lean_map(_reversed(blocks, neighbours, sampled, turn)), _EDGES)
        listed = graph.select("block", "node", "nbr", "fresh").groupBy("block").cogroup(back.groupBy("block"))
        lists = written(listed.applyInArrow(lean_cogroup(_members(neighbours, sampled, turn)), "block int, nodes binary, fresh binary, old binary"), "members")
        needs = lists.select("block", "fresh", "old").mapInArrow(lean_map(_needed(blocks)), _NEEDS)
        vectors = needs.groupBy("block").cogroup(graph.select("block", "node", "code", "kth").groupBy("block")).applyInArrow(lean_cogroup(_sent(dimension)), _SENT)
        met = lists.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(lean_cogroup(_introduced(dimension, blocks, neighbours, sampled)), _EDGES)
        graph = merge(graph, met, turn)
    back = graph.select("node", "nbr", "sim").mapInArrow(lean_map(_backward(blocks, neighbours)), _EDGES)
    walk = graph.select("block", "node", "code", "nbr").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lean_cogroup(_adjacent(neighbours)), "block int, node long, code binary, adjacent binary")
    return Index(nodes, classes.select("node", "id"), written(walk, "walk"), dimension, blocks, n, neighbours, turn)


def _next(beam: np.ndarray, done: np.ndarray, expanded: int) -> np.ndarray:
    """The nearest entries of each beam that are not expanded yet; beams are in order of nearness."""
    free = (beam >= 0) & (done == 0)
    return free & (np.cumsum(free, axis=1) <= expanded)


def _asking(beam_width: int, expanded: int):
    """(node, block) of the nodes that the queries of a batch expand next."""

    def run(batches):
        for batch in batches:
            beam, done = _rows(batch.column("beam"), np.int64, beam_width), _rows(batch.column("done"), np.uint8, beam_width)
            some = _next(beam, done, expanded)
            block = np.broadcast_to(batch.column("block").to_numpy()[:, None], beam.shape)[some]
            pairs = np.unique(np.stack([block.astype(np.int64), beam[some]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0].astype(np.int32))], names=["node", "block"])

    return run


def _distinct_nodes(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(told.column("node").to_numpy(), return_index=True)


def _walked(beam_width: int, expanded: int, width: int):
    """Mark what is expanded and note its neighbours that the beam does not hold."""

    def run(key, state: pa.Table, told: pa.Table) -> pa.Table:
        ids, first = _distinct_nodes(told)
        adjacent = _rows(told.column("adjacent"), np.int64, 2 * width)[first]
        beam, done = _rows(state.column("beam"), np.int64, beam_width), _rows(state.column("done"), np.uint8, beam_width)
        some = _next(beam, done, expanded)
        done[some] = 1
        row = np.nonzero(some)[0]
        near = adjacent[np.searchsorted(ids, beam[some])] if len(ids) else np.zeros((0, 2 * width), np.int64)
        q, w = np.repeat(row, 2 * width), near.ravel()
        q, w = q[w >= 0], w[w >= 0]
        order = np.lexsort((w, q))
        q, w = q[order], w[order]
        once = np.append(True, (q[1:] != q[:-1]) | (w[1:] != w[:-1])) if len(q) else np.zeros(0, bool)
        q, w = q[once], w[once]
        known = np.zeros(len(q), bool)
        for r in np.unique(q):
            mine = slice(*np.searchsorted(q, [r, r + 1]))
            known[mine] = np.isin(w[mine], beam[r])
        q, w = q[~known], w[~known]
        ends = np.searchsorted(q, np.arange(len(beam) + 1))
        pending = pa.array([w[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        columns = {c: state.column(c) for c in state.column_names} | {"done": _packed(done), "pending": pending}
        return pa.table(list(columns.values()), names=list(columns))

    return run


def _asked(dimension: int, blocks: int):
    """What the queries of a batch want scored, one row per block of queries and block of nodes."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PACKED):
                batch = whole.slice(at, PACKED)
                w = _flat(batch.column("pending"), np.int64)
                if not len(w):
                    continue
                row = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column("pending")).to_numpy(zero_copy_only=False) // 8)
                asker, to = batch.column("block").to_numpy()[row], block_of(w, blocks)
                order = np.lexsort((w, row, to, asker))
                w, row, asker, to = w[order], row[order], asker[order], to[order]
                cut = np.flatnonzero(np.append(True, (asker[1:] != asker[:-1]) | (to[1:] != to[:-1])))
                query, codes = batch.column("query").to_numpy(), _rows(batch.column("code"), np.uint8, dimension + 4)
                packed = []
                for a, b in zip(cut, np.append(cut[1:], len(w)), strict=True):
                    own, place = np.unique(row[a:b], return_inverse=True)
                    packed.append([query[own].tobytes(), codes[own].tobytes(), place.astype(np.int32).tobytes(), w[a:b].tobytes()])
                columns = [pa.array(to[cut], pa.int32()), pa.array(asker[cut], pa.int32()), *[pa.array([p[i] for p in packed], pa.binary()) for i in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ASKS.split(", ")])

    return run


def _answered(dimension: int):
    """The cosines of a block's nodes and the queries that ask for them."""

    def run(key, asks: pa.Table, graph: pa.Table) -> pa.Table:
        ids = graph.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = directions(_rows(graph.column("code"), np.uint8, dimension + 4)[order])
        told = []
        for ask in asks.to_pylist() if len(ids) else []:
            query, place, w = (np.frombuffer(ask[c], kind) for c, kind in (("query", np.int64), ("place", np.int32), ("w", np.int64)))
            own = directions(np.frombuffer(ask["code"], np.uint8).reshape(-1, dimension + 4))
            at = np.minimum(np.searchsorted(ids, w), len(ids) - 1)
            here = ids[at] == w
            at, place, w = at[here], place[here], w[here]
            s = [np.einsum("ij,ij->i", x[at[i : i + PAIRS]], own[place[i : i + PAIRS]]) for i in range(0, len(w), PAIRS)]
            told.append((ask["asker"], query[place].tobytes(), w.tobytes(), np.concatenate([np.zeros(0, np.float32), *s]).astype("<f4").tobytes()))
        columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
        return pa.table(columns, names=["block", "query", "w", "s"])

    return run


def _scored(beam_width: int):
    """Keep the nearest of what the beams hold and what was scored for them."""

    def run(key, state: pa.Table, told: pa.Table) -> pa.Table:
        beam, sim, done = (_rows(state.column(c), kind, beam_width) for c, kind in (("beam", np.int64), ("sim", np.float32), ("done", np.uint8)))
        ids = state.column("query").to_numpy()
        by_id = np.argsort(ids)
        row = by_id[np.searchsorted(ids, _flat(told.column("query"), np.int64), sorter=by_id)]
        w, s = _flat(told.column("w"), np.int64), _flat(told.column("s"), np.float32)
        order = np.argsort(row, kind="stable")
        row, w, s = row[order], w[order], s[order]
        ends = np.searchsorted(row, np.arange(len(beam) + 1))
        for r in np.unique(row):
            mine = slice(ends[r], ends[r + 1])
            both, sims, flags = np.concatenate([beam[r], w[mine]]), np.concatenate([sim[r], s[mine]]), np.append(done[r], np.zeros(ends[r + 1] - ends[r], np.uint8))
            top = np.lexsort((both, -sims))[:beam_width]
            beam[r], sim[r], done[r] = both[top], sims[top], flags[top]
        n_open = ((beam >= 0) & (done == 0)).sum(axis=1).astype(np.int64)
        columns = {c: state.column(c) for c in state.column_names}
        columns |= {"beam": _packed(beam), "sim": _packed(sim), "done": _packed(done), "pending": pa.array([b""] * len(beam), pa.binary()), "n_open": pa.array(n_open)}
        return pa.table(list(columns.values()), names=list(columns))

    return run


def _begun(dimension: int, blocks: int, beam_width: int, starts: list[int], codes: list[bytes]):
    """Beams of the common starts, which every query scores where it is; pending is the query's own node, if it is one."""
    order = np.argsort(np.array(starts, np.int64))
    ids, x = np.array(starts, np.int64)[order], directions(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, dimension + 4)[order])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dimension)
            query, own = batch.column("query").to_numpy(), coded(values)
            pending = [np.array([s] if s is not None and s not in starts else [], np.int64).tobytes() for s in batch.column("start").to_pylist()]
            beam, sim = np.full((n, beam_width), -1, np.int64), np.full((n, beam_width), NONE)
            near = np.stack([np.einsum("ij,j->i", directions(own), v) for v in x], axis=1) if len(ids) else np.zeros((n, 0), np.float32)
            top = np.argsort(-near, axis=1, kind="stable")[:, :beam_width]
            beam[:, : top.shape[1]], sim[:, : top.shape[1]] = ids[top], np.take_along_axis(near, top, 1)
            columns = [
                pa.array(block_of(query, blocks)), pa.array(query), _packed(own), _packed(beam), _packed(sim), _packed(np.zeros((n, beam_width), np.uint8)),
                pa.array(pending, pa.binary()), pa.array((beam >= 0).sum(axis=1).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _heads(beam_width: int, most: int):
    def run(batches):
        for batch in batches:
            beam = _rows(batch.column("beam"), np.int64, beam_width)[:, :most]
            ids = np.broadcast_to(batch.column("query").to_numpy()[:, None], beam.shape)
            yield pa.RecordBatch.from_arrays([pa.array(ids[beam >= 0]), pa.array(beam[beam >= 0])], names=["query", "node"])

    return run


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(index: Index, queries: DataFrame, k: int = 5, beam: int = BEAM, expanded: int = EXPANDED, exact: int = EXACT, query_block: int = QUERY_BLOCK, starts: int = STARTS) -> DataFrame:
    """``query``, ``node``, ``score``: the ``k`` * ``exact`` nearest nodes that a greedy walk finds for each query, scored exactly.

    ``queries`` has ``query`` (long, distinct), ``embedding`` (of the index's
    dimension, no null, not zero) and ``start`` (a node to begin at, or null).
    Every query also begins at ``starts`` nodes spread over the graph by a hash.
    Without queries or nodes the result is empty.
    """
    queries = written(queries.select("query", "embedding", "start"), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    common = index.graph.select("node", "code").orderBy(F.xxhash64("node"), "node").limit(starts).collect()
    begun = _begun(index.dimension, blocks, beam, [r.node for r in common], [bytes(r.code) for r in common])
    codes = index.graph.select("block", "node", "code").groupBy("block")

    def score(state):
        asks = state.select("block", "query", "code", "pending").mapInArrow(lean_map(_asked(index.dimension, index.blocks)), _ASKS)
        told = asks.groupBy("block").cogroup(codes).applyInArrow(lean_cogroup(_answered(index.dimension)), _TOLD)
        return written(state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lean_cogroup(_scored(beam)), _STATE), "beams")

    state = score(queries.mapInArrow(lean_map(begun), _STATE))
    while (state.agg(F.sum("n_open")).first()[0] or 0) > 0:
        wanted = state.select("block", "beam", "done").mapInArrow(lean_map(_asking(beam, expanded)), "node long, block int")
        near = wanted.join(index.graph.select("node", "adjacent"), "node")
        walked = state.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(lean_cogroup(_walked(beam, expanded, index.neighbours)), _STATE)
        state = score(written(walked, "walked"))
    pairs = state.select("query", "beam").mapInArrow(lean_map(_heads(beam, k * exact)), "query long, node long")
    asked = queries.select("query", F.col("embedding").alias("_asked"))
    met = pairs.join(index.nodes, "node").join(asked, "query")
    return met.select("query", "node", cosine("_asked", "embedding").alias("score"))


def nearest(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", **parameters) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest other rows found for the usable rows that meet ``queries`` (over ``id``).

    Nearest first, ties to the smaller id; all others if there are fewer than
    ``k``.  Copies of a vector are one node of the graph: its walk is made once,
    and its ``k + 1`` smallest ids stand for it, of which a query drops its own.
    Rows that ``usable`` leaves out neither ask nor answer.
    """
    index = build(rows, vec_id, embedding, copies=k + 1, **parameters)
    used, _ = usable(rows, vec_id, embedding)
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("embedding"))
    ids = hashed(used.where(queries)).groupBy("_hash", "embedding", "id").agg(F.lit(1).alias("_one")).drop("_one")
    asked = written(ids.join(hashed(index.nodes), ["_hash", "embedding"]).select("id", "node"), "asked")
    sizes = asked.groupBy("node").agg(F.count("*").alias("n_asked"))
    own = index.nodes.join(sizes.select("node"), "node")
    found = search(index, own.select(F.col("node").alias("query"), "embedding", F.col("node").alias("start")), k)
    itself = own.select(F.col("node").alias("query"), "node", cosine("embedding", "embedding").alias("score"))
    every = found.where("query <> node").unionByName(itself).join(index.members, "node")
    ranked = every.withColumn("_nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("_nth") <= k + 1)
    lists = ranked.groupBy(F.col("query").alias("node")).agg(F.array_sort(F.collect_list(F.struct("_nth", "id", "score"))).alias("found"))
    told = broadcast_hot(asked, written(lists.join(sizes, "node"), "found"), "node", "n_asked", asked.count())
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return told.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "_x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
