"""Each stage of the pipeline on repeated and null ids, null and empty texts, ties, clashing columns, unlabelled and empty tables."""

import numpy as np
import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = words(rng, 100)
    close = base.split()
    close[50] = "changed"
    return base, " ".join(close), words(rng, 90), words(rng, 80)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "aa", "s", 1, "x", "y") for i, t in rows], SCHEMA).repartition(2)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_keeps_unrelated_rows_that_share_an_id(spark, texts):
    base, close, other, more = texts
    docs = table(spark, [(1, base), (2, close), (2, other), (3, other), (3, other), (None, close), (None, more), (5, None), (5, None), (6, ""), (7, "one two"), (7, "one two")])
    out = cp.near(spark, docs, "")
    assert out.columns == docs.columns
    assert kept(out) == sorted([(1, base), (2, other), (None, more), (5, None), (5, None), (6, ""), (7, "one two")], key=repr)


def test_near_keeps_a_null_id_if_it_is_alone(spark, texts):
    base, close, *_ = texts
    assert kept(cp.near(spark, table(spark, [(None, base), (None, close)]), ""))[0][0] is None
    assert len(kept(cp.near(spark, table(spark, [(None, base), (9, close)]), ""))) == 1
    assert kept(cp.near(spark, table(spark, [(None, base), (9, close)]), "")) == [(9, close)]


def test_language_keeps_unlabelled_tables(spark, texts):
    rows = [(1, texts[0], None), (1, None, None), (None, "12 34", None)]
    docs = spark.createDataFrame([(i, t, g, "s", 1, "x", "y") for i, t, g in rows], SCHEMA)
    assert kept(cp.language(spark, docs, "")) == sorted([(i, t) for i, t, _ in rows], key=repr)
    labelled = spark.createDataFrame([(i, t, "aa", "s", 1, "x", "y") for i, t, _ in rows], SCHEMA)
    assert kept(cp.language(spark, labelled, "")) == [(1, texts[0])]


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_other_stages_on_awkward_rows(spark, texts):
    base, close, other, more = texts
    rows = [(1, base), (1, base + " "), (None, other), (2, None), (3, ""), (4, more), (4, close)]
    docs = table(spark, rows)
    exact = kept(cp.exact(spark, docs, ""))
    assert len(exact) == 5 and (1, base + " ") in exact and (None, other) in exact
    mixed = cp.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and set(kept(mixed)) <= set(rows)
    pieces = cp.packing(spark, docs, "")
    assert pieces.count() == len(rows) and pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
