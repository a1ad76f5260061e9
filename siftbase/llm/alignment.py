"""Alignment of two tokenizers' ids over the same bytes.

Both encode a blank and the text.  The cumulative byte ends of the ids are keys
of two end-to-index dictionaries; their common keys, sorted, slice both id lists
into groups, and within a group every pair of tokens whose byte ranges overlap
is a link.  A slice of rows is one stream of ids, since both tokenizers end where
a text ends; numpy expands its links and writes its groups.

Corpus-wide counts of linked id pairs never meet the documents whole: rows go in
chunks of some megabytes of text, a chunk sends each of its distinct pairs once
with its number of links, Spark sums them, and the sums come back to the chunks
that hold the pair.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from siftbase.llm.common import Powers, runs, slices, small_batches, utf8
from siftbase.llm.registry import query, table
from siftbase.llm.tokens import Ids
from siftbase.session import written

#: The two vocabularies: a byte-level BPE of the tokenizers library and a BPE with byte fallback of sentencepiece.
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

#: Text bytes of a chunk of rows, whose links are counted together, and parts of texts whose ids a task remembers.
CHUNK_BYTES, REMEMBERED = 8 << 20, 1 << 18

#: The character by which the second vocabulary writes a blank.
BLANK_MARK = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is visible Latin-1, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every token of a vocabulary, end to end, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[runs(self.lengths[ids], self.starts[ids])]


class Pieces(Ids):
    """Ids of the sentencepiece vocabulary, each distinct part of the texts encoded once.

    Texts come with a blank in front, which the library adds itself.  No piece
    holds a blank behind another character, so no merge crosses the place before
    a blank that follows none.
    """

    def __init__(self, vocabulary: str = SECOND, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=vocabulary)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in self.pieces):
            raise ValueError("a piece holds a blank behind another character")
        self.blank = self.model.piece_to_id(BLANK_MARK)
        self.size, self.remembered, self.powers = len(self.pieces), remembered, Powers()
        self._forget()

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        blank = data == 0x20
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[offsets] = True
        cut[-1] = False
        return np.flatnonzero(cut)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [data[a + 1 : b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        ids = [x or [self.blank] for x in self.model.encode(parts, num_threads=1)]  # the library adds no blank to nothing
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


class Pair:
    """The two tokenizers and their vocabularies; one object per task."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        self.first, self.second = Ids(first, REMEMBERED, added=False), Pieces(second)  # strings of added tokens are ordinary text
        byte = byte_level()
        entries = self.first.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            tokens[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.a = Vocabulary(tokens)
        is_byte = self.second.model.is_byte
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if is_byte(i) else p.replace(BLANK_MARK, " ").encode() for i, p in enumerate(self.second.pieces)])


def groups_of(a_ends: list[int], b_ends: list[int], i: int = 0, j: int = 0) -> tuple[list[int], list[int]]:
    """Of one text, for each common end in order: how many tokens of either list end there or before, ``i`` and ``j`` more."""
    a_at, b_at = dict(zip(a_ends, range(i + 1, i + 1 + len(a_ends)))), dict(zip(b_ends, range(j + 1, j + 1 + len(b_ends))))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of every link, in order: of each first token, the run of second tokens that overlap it, which never leaves its group."""
    a_begins, b_begins = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    first, stop = np.searchsorted(b_ends, a_begins, side="right"), np.searchsorted(b_begins, a_ends, side="left")
    return np.repeat(np.arange(len(a_ends)), stop - first), runs(stop - first, first)


class Digits:
    """Decimal texts of the numbers below ``n``."""

    def __init__(self, n: int):
        self.width = len(str(n - 1))
        numbers = np.arange(n)
        self.lengths = np.array([len(str(i)) for i in numbers], np.int64)
        self.marks = np.zeros((n, self.width), np.uint8)
        for k in range(self.width):
            have = self.lengths > k
            self.marks[have, k] = 48 + numbers[have] // 10 ** (self.lengths[have] - 1 - k) % 10

    def joined(self, numbers: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all numbers, each with its separator behind it (0: none), and where each ends."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths + (separators > 0))
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        begins = ends - lengths - (separators > 0)
        for k in range(self.width):
            have = lengths > k
            out[begins[have] + k] = self.marks[numbers[have], k]
        out[ends[separators > 0] - 1] = separators[separators > 0]
        return out, ends


class Slice:
    """Alignment of a slice of texts: numbers and groups per text, and the distinct links of each with their times."""

    def __init__(self, batch: pa.RecordBatch, column: str, pair: Pair, digits: Digits):
        texts = batch.column(column).to_pylist()
        n = len(texts)
        data, offsets = utf8(pa.array([f" {t}" if t else "" for t in texts], pa.string()))
        spans, streams = [], []
        for vocabulary, encoder in ((pair.a, pair.first), (pair.b, pair.second)):
            ids, at = encoder.rows(data, offsets)
            ids = ids.astype(np.int64)
            ends = np.append(0, np.cumsum(vocabulary.lengths[ids]))
            spans.append((vocabulary.bytes_of(ids), ends[at]))
            streams.append((ids, at))
        good = np.diff(offsets) > 0
        if not all(len(x) == len(data) and (x == data).all() for x, _ in spans):  # some text is not given back; see which
            for i in np.flatnonzero(good):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                good[i] = all(x[at[i] : at[i + 1]].tobytes() == own for x, at in spans)
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, np.diff(at))], np.diff(at) * good) for ids, at in streams)
        a_ends, b_ends = np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b])
        a_list, b_list, a_to, b_to, n_groups, i, j = a_ends.tolist(), b_ends.tolist(), [], [], np.zeros(n, np.int64), 0, 0
        for k in np.flatnonzero(good):
            x, y = i + int(n_a[k]), j + int(n_b[k])
            a_own, b_own = groups_of(a_list[i:x], b_list[j:y], i, j)
            n_groups[k] = len(a_own)
            a_to += a_own
            b_to += b_own
            i, j = x, y
        a_to, b_to = np.array(a_to, np.int64), np.array(b_to, np.int64)
        self.numbers = [n_a, n_b, n_groups]
        self.groups = self._written(a, b, a_to, b_to, np.cumsum(n_groups), digits)
        i, j = links_of(a_ends, b_ends)
        text_of = np.repeat(np.arange(n), n_a)[i]
        self.numbers.append(np.bincount(text_of, minlength=n))
        size = len(pair.b.lengths)
        if len(pair.a.lengths) * size >= 1 << 40:
            raise ValueError("the vocabularies have more pairs than a number of 40 bits can tell apart")
        each, self.times = np.unique((text_of << 40) + a[i] * size + b[j], return_counts=True)
        self.pairs, self.links = each & ((1 << 40) - 1), np.bincount(each >> 40, minlength=n)

    @staticmethod
    def _written(a, b, a_to, b_to, last_group, digits) -> pa.Array:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        a_place, b_place = np.arange(len(a)) + np.repeat(b_to - n_b, n_a), np.arange(len(b)) + np.repeat(a_to, n_b)
        numbers, separators = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        numbers[a_place], numbers[b_place] = a, b
        separators[a_to + b_to - n_b - 1], separators[a_to + b_to - 1] = ord("|"), ord(";")
        final = last_group[np.diff(last_group, prepend=0) > 0]
        separators[(a_to + b_to)[final - 1] - 1] = 0
        out, ends = digits.joined(numbers, separators)
        tokens = np.append(0, (a_to + b_to))[last_group]
        offsets = np.append(0, np.append(0, ends)[tokens]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(last_group), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _bag(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and their times as planes of bytes, which compress."""
    steps = np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.concatenate([*steps.T, *times.astype("<u4").view(np.uint8).reshape(-1, 4).T]).tobytes()


def _unbagged(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    steps, times = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in (planes[:4], planes[4:]))
    return np.cumsum(steps), times


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str = FIRST, second: str = SECOND, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Align every whole text: one row per row of ``docs``; to be written before it is used twice.

    ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (ids of
    both in order, ``a1,a2|b1;a3|b2,b3``) are the result; ``chunk``, ``place``,
    ``bag`` and, in the first row of each chunk, ``pairs`` and ``pair_links`` say
    which linked pairs each row holds, for ``link_counts`` and ``link_sums``.

    Texts that are null or empty, or that a tokenizer does not give back byte for
    byte, have no tokens: zeros and an empty string.  Rows of equal id stay rows
    of their own, a null id stays null, other columns are left out, and an empty
    table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [("chunk", T.StringType()), ("place", T.IntegerType()), ("doc_id", rows.schema["doc_id"].dataType), *[(k, T.LongType()) for k in NUMBERS]]
    fields += [("groups", T.StringType()), *[(k, T.BinaryType()) for k in ("bag", "pairs", "pair_links")]]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        pair, part, nth, held, size = None, TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal nth, held, size
            pairs, local = np.unique(np.concatenate([s.pairs for _, s in held]), return_inverse=True)
            links = np.bincount(local, weights=np.concatenate([s.times for _, s in held]), minlength=len(pairs)).astype("<i8")
            at, place = 0, 0
            wide = len(pair.b.lengths)
            for batch, s in held:
                n = batch.num_rows
                ends = at + np.cumsum(s.links)
                bags = [_bag(local[a:b], s.times[a - at : b - at]) for a, b in zip(ends - s.links, ends, strict=True)]
                once = [pa.array([x.tobytes() if place == 0 else None] + [None] * (n - 1), pa.binary()) for x in ((pairs // wide << 32 | pairs % wide).astype("<i8"), links)]
                columns = [pa.array([f"{part}-{nth}"] * n), pa.array(range(place, place + n), pa.int32()), batch.column("doc_id"), *map(pa.array, s.numbers), s.groups, pa.array(bags, pa.binary()), *once]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at, place = at + len(s.pairs), place + n
            nth, held, size = nth + 1, [], 0

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                if pair is None:
                    pair = Pair(first, second)
                    digits = Digits(max(len(pair.a.lengths), len(pair.b.lengths)))
                held.append((batch, Slice(batch, "text", pair, digits)))
                size += batch.column("text").nbytes
                if size >= chunk_bytes:
                    yield from close()
        if held:
            yield from close()

    return rows.mapInArrow(run, schema)


def _chunk_pairs(batches):
    for batch in batches:
        for chunk, pairs, links in zip(*(batch.column(k).to_pylist() for k in ("chunk", "pairs", "pair_links")), strict=True):
            pairs, links = np.frombuffer(pairs, "<i8"), np.frombuffer(links, "<i8")
            columns = [pa.array([chunk] * len(pairs), pa.string()), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(links)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "at", "a_id", "b_id", "n"])


def chunk_pairs(alignment: DataFrame) -> DataFrame:
    """``chunk``, ``at`` (the pair's number in its chunk), ``a_id``, ``b_id``, ``n``: each distinct linked pair of each chunk, once."""
    return alignment.where("place = 0").select("chunk", "pairs", "pair_links").mapInArrow(_chunk_pairs, "chunk string, at int, a_id int, b_id int, n long")


def told_pairs(alignment: DataFrame) -> DataFrame:
    """``chunk_pairs`` with ``total``, the links of the whole corpus that hold the pair; a pair has a row per chunk at most."""
    total = F.sum("n").over(Window.partitionBy("a_id", "b_id"))
    return written(chunk_pairs(alignment).withColumn("total", total).drop("n"), "pairs")


def link_counts(told: DataFrame) -> DataFrame:
    """The corpus-wide map between the vocabularies: ``a_id``, ``b_id``, ``n`` and ``best`` (no pair of this ``b_id`` has more links)."""
    counts = told.groupBy("a_id", "b_id").agg(F.max("total").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))  # a b_id has at most a vocabulary of partners


def _summed(key, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Sums over the links of each row of one chunk."""
    n = told.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = told.column("at").to_numpy()
    total[at], best[at] = told.column("total").to_numpy(), told.column("best").to_numpy()
    sums = []
    for bag in docs.column("bag").to_pylist():
        places, times = _unbagged(bag)
        sums.append((int((total[places] * times).sum()), int((best[places] * times).sum())))
    columns = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
    return pa.table([docs.column("chunk"), docs.column("place"), *columns], names=["chunk", "place", "count_sum", "n_best"])


def link_sums(alignment: DataFrame, told: DataFrame) -> DataFrame:
    """``chunk``, ``place``, ``count_sum`` and ``n_best`` of every row of a written ``align``; ``told`` is its ``told_pairs``.

    A chunk and the counts of its pairs meet in one task; both are bounded by the
    text of a chunk, whatever the input.  The highest count of each second id is
    a row per id of a vocabulary, so it is broadcast.
    """
    highest = written(told.groupBy("b_id").agg(F.max("total").alias("_most")), "highest")
    marked = told.join(F.broadcast(highest), "b_id").select("chunk", "at", "total", (F.col("total") == F.col("_most")).cast("long").alias("best"))
    rows = alignment.select("chunk", "place", "bag")
    return rows.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(_summed, "chunk string, place int, count_sum long, n_best long")


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with small_batches(spark):
        made = align(docs).withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))).drop("groups")
        made = written(made, "alignment")
        sums = link_sums(made, told_pairs(made))
        shown = made.select("chunk", "place", "doc_id", *NUMBERS, "groups_sha256").join(sums, ["chunk", "place"])
        return written(shown.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"), "aligned")
