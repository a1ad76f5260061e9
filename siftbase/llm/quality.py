"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed character n-grams are counted, one over the trusted
texts and one over all texts.  A document's score is the mean over its n-grams of
log(p_target / p_raw), so its length does not matter, and a document is kept if
its score reaches a threshold: a fixed number, drawn from nothing random.  The
threshold is the one that best separates trusted from other labelled rows, by a
histogram of their scores.  Beside it stand base rules on counts of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftbase.llm.common import Powers, mixed, slices, span_hashes, utf8, windows, word_bounds
from siftbase.llm.registry import query, table
from siftbase.session import stored_side

#: Hash space and lengths of the character n-grams, additive smoothing.
FEATURES, ORDERS, SMOOTHING = 1 << 18, (3, 4), 0.5

#: Base rules: fewest words, and the largest share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 50, 50, 3

SYMBOLS = "#*$%&|<>"

#: Width of a bin of scores, and what a trusted row lost weighs against another row caught.
BIN, CLEAN_WEIGHT = 0.001, 2.0

OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@dataclass
class Verdict:
    ratios: np.ndarray  # natural logarithm of p_target / p_raw of every feature
    threshold: float


def _ngrams(data: np.ndarray, offsets: np.ndarray):
    """Feature and row of every hashed character n-gram that lies within a row, order by order."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(points)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for order in ORDERS:
        if n < order:
            continue
        h = np.full(n - order + 1, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h = (h ^ points[k : n - order + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        inside = row[: n - order + 1] == row[order - 1 :]
        feature = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (FEATURES.bit_length() - 1))).astype(np.int64)
        yield feature[inside], row[: n - order + 1][inside]


def _counted(batches):
    """Per task: (feature, n in trusted rows of fold 0, of fold 1, n in all rows) of every feature that occurs."""
    target, raw = np.zeros((2, FEATURES), np.int64), np.zeros(FEATURES, np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for feature, row in _ngrams(*utf8(batch.column("text"))):
                raw += np.bincount(feature, minlength=FEATURES)
                for k in (0, 1):
                    target[k] += np.bincount(feature[fold[row] == k], minlength=FEATURES)
    some = np.flatnonzero(raw)
    columns = [pa.array(some.astype(np.int32)), pa.array(target[0][some]), pa.array(target[1][some]), pa.array(raw[some])]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "target_0", "target_1", "raw"])


def ratios(marked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-ratios from all rows of (text, fold; -1 for untrusted): of fold 0, of fold 1, of both.  At most FEATURES rows reach the driver."""
    names = ("target_0", "target_1", "raw")
    got = marked.mapInArrow(_counted, "feature int, target_0 long, target_1 long, raw long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    counts = np.zeros((3, FEATURES))
    for k, name in enumerate(names):
        counts[k, got.column("feature").to_numpy()] = got.column(name).to_numpy()

    def share(n):
        return np.log(n + SMOOTHING) - np.log((n + SMOOTHING).sum())

    return tuple(share(t) - share(counts[2]) for t in (counts[0], counts[1], counts[0] + counts[1]))


def scores(data: np.ndarray, offsets: np.ndarray, log_ratios: np.ndarray) -> np.ndarray:
    """Mean log-ratio of every row; 0 for a row without an n-gram."""
    rows = len(offsets) - 1
    total, count = np.zeros(rows), np.zeros(rows)
    for feature, row in _ngrams(data, offsets):
        total += np.bincount(row, log_ratios[feature], minlength=rows)
        count += np.bincount(row, minlength=rows)
    return total / np.maximum(count, 1)


_WORD_CHAR = np.zeros(256, np.int64)
_WORD_CHAR[0:0x80] = 1
_WORD_CHAR[0xC0:] = 1
_WORD_CHAR[[32, 9, 10, 11, 12, 13]] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def base_counts(data: np.ndarray, offsets: np.ndarray, pw: Powers) -> dict[str, np.ndarray]:
    """The counts behind the base rules, per row."""
    rows = len(offsets) - 1

    def summed(marks):
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])

    starts, ends, per_row = word_bounds(data, offsets)
    # lines start at every row and after every line feed, and end at the next line feed or the row's end
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(feeds + 1, offsets[:-1]).astype(np.int64)
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, line_start)], offsets[line_row + 1])
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    distinct = np.unique(span_hashes(data, line_start, line_end, pw) ^ mixed(line_row.astype(np.uint64)), return_index=True)[1]
    dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[distinct], minlength=rows)
    # words in repeated windows
    h, row, at = windows(span_hashes(data, starts, ends, pw), per_row, REPEAT_WIDTH)
    h ^= mixed(row.astype(np.uint64))
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]] if len(h) else False
    again = at[order[same[1:] | same[:-1]]] if len(h) else at
    covered = np.zeros(len(starts) + REPEAT_WIDTH, bool)
    for k in range(REPEAT_WIDTH):
        covered[again + k] = True
    word_row = np.repeat(np.arange(rows), per_row)
    return {
        "n_words": per_row.astype(np.int64),
        "word_chars": summed(_WORD_CHAR[data]),
        "n_symbols": summed(_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(word_row[covered[: len(starts)]], minlength=rows),
    }


def judged(docs: DataFrame, verdict: Verdict, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its base counts, ``base_failed``, ``score`` and ``kept``.

    A null text has no words and fails the base rules; texts count whole.
    Columns of these names are replaced, other columns pass, an empty table stays empty.
    """
    docs = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    shared = docs.sparkSession.sparkContext.broadcast((verdict.ratios, verdict.threshold))  # plain values: workers need no copy of this package
    added = [T.StructField(c, T.LongType()) for c in OUTPUT[:5]] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        pw, verdict = Powers(), Verdict(*shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = utf8(batch.column(text))
                counts = base_counts(data, offsets, pw)
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                score = scores(data, offsets, verdict.ratios)
                columns = [pa.array(counts[c].astype(np.int64)) for c in OUTPUT[:5]] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= verdict.threshold))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Verdict:
    """Ratios of trusted rows (quality 1, not toxic) against all rows, and the threshold between trusted and other labelled rows.

    With several labels for one id the worst counts.  All labelled rows take
    part: while their measured table is small it is broadcast and no text moves,
    beyond that it is a merge join.  The threshold is set on scores of rows that
    did not teach the ratios they are scored with: trusted rows form two folds,
    and either is scored by the other's, as unseen rows will be.  Without any
    trusted or any other labelled row the threshold keeps everything.
    """
    worst = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("_good"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    marked = stored_side(worst, "worst")
    half = F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(2)).cast("int")
    joined = rows.join(marked, "_id", "left").select("text", F.coalesce(F.col("_good") == 1, F.lit(False)).alias("trusted"), F.col("_good").isNotNull().alias("labelled"), half.alias("half"))
    *by_fold, log_ratios = ratios(joined.select("text", F.when(F.col("trusted"), F.col("half")).otherwise(-1).alias("fold")))
    free = Verdict(log_ratios, -np.inf)
    told = [judged(joined.where(F.col("labelled") & (F.col("half") == k)), Verdict(by_fold[1 - k], -np.inf)) for k in (0, 1)]
    told = told[0].unionByName(told[1]).where("NOT base_failed")
    bins = told.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "trusted").agg(F.count("*").alias("n")).toArrow().to_pylist()
    good, other = sum(b["n"] for b in bins if b["trusted"]), sum(b["n"] for b in bins if not b["trusted"])
    if not good or not other:
        return free
    per_bin = {}
    for b in bins:
        per_bin[b["bin"]] = per_bin.get(b["bin"], 0.0) + b["n"] * (-CLEAN_WEIGHT / good if b["trusted"] else 1 / other)
    at = sorted(per_bin)
    gains = np.cumsum([0.0] + [per_bin[k] for k in at])[:-1]  # of rejecting all bins below
    best = at[int(np.argmax(gains))] * BIN
    return Verdict(log_ratios, best)


@query("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
