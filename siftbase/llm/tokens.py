"""Token ids of whole texts by the tokenizers library, at the cost of its distinct pieces.

The pattern that splits a text before the merges never joins bytes across some
places that are cheap to see: before a single blank between visible characters,
round a single line feed between them, and between a letter or digit and the
punctuation after it.  Merges never cross the pattern's pieces, so the ids of a
text are those of the parts between such places, one after the other.  A task
hands each distinct part to the tokenizer once.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers

from siftbase.llm.common import Powers, kept, runs, span_hashes

#: The vocabulary that the token queries use; a parameter of every function here.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Distinct parts that a task remembers; beyond them it starts afresh.
REMEMBERED, FEWER = 1 << 20, 1 << 18

_LETTER, _PUNCT, _BLANK, _LINE, _LATIN = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _PUNCT
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_low:_high] = _LETTER
_CLASS[0x20], _CLASS[0x0A], _CLASS[0xC3] = _BLANK, _LINE, _LATIN


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts: row starts, and the places named above."""
    n = len(data)
    kind = np.zeros(n + 3, np.uint8)
    kind[2 : n + 2] = _CLASS[data]
    cut = np.zeros(n + 1, bool)
    if n:
        two_back, before, here, after = kind[:n], kind[1 : n + 1], kind[2 : n + 2], kind[3 : n + 3]
        accented = np.zeros(n, bool)  # the byte before ends a letter of the block after C3
        raw = np.zeros(n + 1, np.uint8)
        raw[1:] = data
        accented[:] = (two_back == _LATIN) & (raw[:n] >= 0x80) & (raw[:n] != 0x97) & (raw[:n] != 0xB7)
        solid_before = ((before & (_LETTER | _PUNCT)) > 0) | accented
        solid_after = (after & (_LETTER | _PUNCT | _LATIN)) > 0
        alone = ((here & (_BLANK | _LINE)) > 0) & solid_before & solid_after
        cut[:n] = alone | ((here == _PUNCT) & ((before == _LETTER) | accented))
        cut[1:][alone & (here == _LINE)] = True
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Ids:
    """Token ids of rows of text; one object per task."""

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = REMEMBERED, added: bool = True):
        """``added``: the strings of the vocabulary's added tokens get their ids wherever a text holds them, as the library does; else they are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else []
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        self.size, self.remembered, self.powers = self.tokenizer.get_vocab_size(), remembered, Powers()
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self):
        self.keys = np.zeros(4 * self.remembered, np.uint64)
        self.where = np.zeros(4 * self.remembered, np.int32)
        self.n = 0
        self.flat = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.flat_begin = np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of every hash among the remembered parts, -1 if new."""
        mask = np.uint64(len(self.keys) - 1)
        found = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), h & mask
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            found[left[hit]] = self.where[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], (slot[more] + np.uint64(1)) & mask
        return found

    def _insert(self, h: np.ndarray, at: np.ndarray):
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        while len(h):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.keys[slot[one]], self.where[slot[one]] = h[one], at[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, at, slot = h[rest], at[rest], slot[rest]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + np.uint64(1)) & mask, slot)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has.  Parts of plain characters share a call, with line feeds between them."""
        n = len(starts)
        kind = _CLASS[data]
        solid = (kind & (_LETTER | _PUNCT | _LATIN)) > 0
        solid[1:] |= (kind[:-1] == _LATIN) & (data[1:] >= 0x80)
        odd = np.concatenate([[0], np.cumsum(~solid)])
        first = np.where((data[starts] == 0x20) & (ends - starts > 1), starts + 1, starts)
        plain = (odd[ends] == odd[first]) & (len(self.line) == 1)
        counts, ids = np.zeros(n, np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = int(plain.sum())
        for at in range(0, n_plain, 20_000):
            group = order[at : min(at + 20_000, n_plain)]
            lengths = ends[group] - starts[group] + 1
            joined = np.full(int(lengths.sum()), 0x0A, np.uint8)
            places = np.cumsum(lengths) - lengths
            joined[runs(lengths - 1, places)] = data[runs(lengths - 1, starts[group])]
            got = np.array(self.tokenizer.encode(joined.tobytes().decode(), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(got == self.line[0])
            if len(stops) != len(group):
                raise ValueError("the vocabulary joins line feeds with other characters")
            counts[group] = np.diff(stops, prepend=-1) - 1
            ids.append(got[got != self.line[0]])
        rest = order[n_plain:]
        for at in range(0, len(rest), 2000):
            group = rest[at : at + 2000]
            got = self.tokenizer.encode_batch([data[starts[i] : ends[i]].tobytes().decode() for i in group], add_special_tokens=False)
            counts[group] = [len(e.ids) for e in got]
            ids.append(np.array([i for e in got for i in e.ids], np.int64))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[runs(counts, begin)], counts

    def _remember(self, data, starts, ends, h):
        """Encode the distinct parts among these and keep them."""
        h, first = np.unique(h, return_index=True)
        ids, counts = self._encode(data, starts[first], ends[first])
        self._insert(h, self.n + np.arange(len(h)))
        self.n += len(h)
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        self.flat_begin = np.concatenate([self.flat_begin, self.flat_begin[-1] + np.cumsum(counts)])

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self._with_added(cuts(data, offsets), data, offsets)

    def _with_added(self, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Cut round the added tokens too, and nowhere inside them."""
        if not self.added:
            return starts
        text, found = data.tobytes(), []
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                end = at + len(token)
                row = np.searchsorted(offsets, at, side="right")
                if end <= offsets[min(row, len(offsets) - 1)] and not any(a < end and at < b for a, b in found):
                    found.append((at, end))
                at = text.find(token, at + 1)
        for at, end in found:
            starts = np.concatenate([starts[(starts <= at) | (starts >= end)], [at, end]])
        return np.unique(starts[starts < len(data)]) if found else starts

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one row after the other, and the offsets of the rows among them."""
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        h = span_hashes(data, starts, ends, self.powers)
        h[h == 0] = 1
        if self.n > self.remembered:
            self._forget()
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            self._remember(data, starts[new], ends[new], h[new])
            found[new] = self._find(h[new])
        begin = self.flat_begin[found]
        lengths = self.flat_begin[found + 1] - begin
        ids = self.flat[runs(lengths, begin)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]


def task_ids(vocabulary: str = VOCABULARY, keep: bool = True) -> Ids:
    """The encoder of this Python worker; later tasks in it find its parts again.

    Without ``keep`` it is one of a task's own, with a smaller memory that goes
    with the task: for jobs after which other stages need the worker's memory.
    """
    return kept(("ids", vocabulary), lambda: Ids(vocabulary)) if keep else Ids(vocabulary, FEWER)
