"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every labelled text, per task in one
array per language and then by a Spark aggregate, so the counts cover all rows
and the driver gets at most languages x FEATURES numbers.  The smoothed
log-probability matrix is broadcast.  Scoring takes a batch of texts as one
array of characters, looks up the matrix row of every n-gram that occurs and
sums the rows of each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftbase.llm.common import crc_bucket, lowered, slices, utf8
from siftbase.llm.registry import query, table

#: Size of the hash space, the lengths of the n-grams, and the additive smoothing.
FEATURES, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5

UNDETERMINED = "und"

#: One row in so many is held out of training by the registered query.
FOLDS = 5


@dataclass
class Model:
    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray  # FEATURES x languages, natural logarithms


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (A to Z lowered) and the offsets of the rows among them."""
    points = np.frombuffer(lowered(data).tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def _features(points: np.ndarray, offsets: np.ndarray):
    """For each order: the feature of the n-gram at every character, and the places where it would leave its row."""
    n = len(points)
    for order in ORDERS:
        h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h[: n - k] = (h[: n - k] ^ points[k:]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        outside = np.concatenate([offsets[1:] - k for k in range(1, order)]) if order > 1 else np.zeros(0, np.int64)
        yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (FEATURES.bit_length() - 1)), outside[outside >= 0]


def _counted(batches):
    """Per task: one row (lang, feature, n) for every feature that occurs, and (lang, -1, texts)."""
    counts, texts = {}, {}
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = utf8(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            points, offsets = _characters(data, offsets)
            row_code = np.repeat(code, np.diff(offsets))
            total = np.zeros(len(names) * FEATURES, np.int64)
            for features, outside in _features(points, offsets):
                total += np.bincount(features + row_code * FEATURES, minlength=len(total))
                np.subtract.at(total, features[outside] + row_code[outside] * FEATURES, 1) if len(outside) else None
            for k, name in enumerate(names):
                counts[name] = counts.get(name, 0) + total[k * FEATURES : (k + 1) * FEATURES]
                texts[name] = texts.get(name, 0) + int((code == k).sum())
    for name, total in counts.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], texts[name]))], names=["lang", "feature", "n"]
        )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every row with a text and a language; without any such row the model knows no language."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names, code = np.unique(np.array(counts.column("lang").to_pylist(), dtype=object), return_inverse=True)
    feature, n = counts.column("feature").to_numpy(), counts.column("n").to_numpy()
    total = np.zeros((FEATURES, max(len(names), 1)))
    texts = np.ones(max(len(names), 1))
    seen = feature >= 0
    if len(names):
        total[feature[seen], code[seen]] = n[seen]
        texts[code[~seen]] = n[~seen]
    matrix = np.log(total + SMOOTHING) - np.log((total + SMOOTHING).sum(axis=0))
    return Model([str(x) for x in names], np.log(texts / texts.sum()), matrix.astype(np.float32))


def scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Log-probability of every row under every language."""
    out = np.tile(model.priors, (len(offsets) - 1, 1))
    points, offsets = _characters(data, offsets)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for features, outside in _features(points, offsets):
            each = model.matrix[features]
            each[outside] = 0
            out[full] += np.add.reduceat(each, offsets[full], axis=0, dtype=np.float64)
    return out


_ALPHA = np.zeros(256, np.int64)
_ALPHA[[*range(65, 91), *range(97, 123)]] = 1


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    found = before[offsets[1:]] > before[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 1)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")))
    return found


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``, the posterior probability of the language.

    Whole texts count.  A null text, one without a letter (empty texts too), or
    any text under a model without languages is ``und`` with score 0.  Columns of
    these two names are replaced, other columns pass; an empty table stays empty.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.priors, model.matrix))  # plain values: workers need no copy of this package
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = Model(*shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = utf8(batch.column(text))
                logs = scores(data, offsets, model)
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                known = has_letter(data, offsets) & (len(model.languages) > 0)
                names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=schema.names)

    return docs.mapInArrow(run, schema)


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_bucket("doc_id", FOLDS) == 0, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")
