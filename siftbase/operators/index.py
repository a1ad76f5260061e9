"""Term index over chunks: one row per chunk, postings as an array.

All per-chunk work happens inside the row, so building the index needs no
shuffle.  ``store_index`` writes it once; retrieval then reads only the columns
that each step needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftbase.functions import text as T
from siftbase.operators.vocabulary import ANSWER_SIGNALS, NOISE_SIGNALS
from siftbase.session import computed_once, written

TITLE_WEIGHT, CATEGORY_WEIGHT = 3, 2


def boilerplate_label(normalized: Column, noise: Sequence[str] = NOISE_SIGNALS, answer: Sequence[str] = ANSWER_SIGNALS) -> Column:
    """O-29: label, scores and matched signals of text that is already in search form."""

    def matched(words: Sequence[str]) -> Column:
        rows = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(_plain(w)).alias("n")) for w in words])
        return F.transform(F.filter(rows, lambda r: F.contains(normalized, r["n"])), lambda r: r["w"])

    noise_hits, answer_hits = matched(noise), matched(answer)
    noise_n, answer_n = F.size(noise_hits), F.size(answer_hits)
    label = (
        F.when((answer_n > 0) & (noise_n > 0), "mixed").when(answer_n > 0, "answerable").when(noise_n > 0, "boilerplate_only").otherwise("answerable")
    )
    return F.struct(
        label.alias("label"),
        noise_n.alias("boilerplate_score"),
        (answer_n * 2).alias("answer_signal_score"),
        noise_hits.alias("matched_boilerplate_signals"),
        answer_hits.alias("matched_answer_signals"),
    )


def boilerplate_class(lowered: Column, noise: Sequence[str] = NOISE_SIGNALS, answer: Sequence[str] = ANSWER_SIGNALS) -> Column:
    """The label alone, from lower-cased text.

    A blank inside a signal stands for any run of separators, so the text needs
    no full normalising.
    """

    def occurs(word: str) -> Column:
        parts = _plain(word).split(" ")
        found = F.contains(lowered, F.lit(parts[0]))
        return found & lowered.rlike((T.SEPARATORS + "+").join(f"\\Q{p}\\E" for p in parts)) if len(parts) > 1 else found

    def any_of(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [occurs(w) for w in words])

    has_noise, has_answer = any_of(noise), any_of(answer)
    return F.when(has_noise & has_answer, "mixed").when(has_noise, "boilerplate_only").otherwise("answerable")


def _plain(word: str) -> str:
    """Search form of a literal signal."""
    kept = word.lower()
    for mark in "()[]{}<>.,;:!?\"'\\/|":
        kept = kept.replace(mark, " ")
    return " ".join(kept.split())


def boilerplate_penalty(label: Column) -> Column:
    return F.when(label == "boilerplate_only", 2.0).when(label == "mixed", 0.2).otherwise(0.0)


def build_index(chunks: DataFrame, use_nfkc: bool = True) -> DataFrame:
    """O-28: ``postings`` of (term, tf, in_title, in_category), ``token_count`` and the columns retrieval filters on.

    tf counts fields, not occurrences: 1 for text, 1 for the source name, 3 for
    the title and 2 for the category; ``token_count`` is the sum, at least 1.
    """
    fields = ("text", "source_name", "title", "category")
    head = ["chunk_id", "source_id", "collection_category", "source_family", "deadline_status", "deadline_raw_text", "posted_at", "fetched_at"]
    lowered = {f"_n_{name}": T.lower_nfkc(name, use_nfkc) for name in fields}
    staged = computed_once(chunks, lowered, head)
    # no signal contains a line break, so the fields joined by blanks classify like the fields joined by line breaks
    label = boilerplate_class(F.concat_ws(" ", "_n_title", "_n_category", "_n_text"))
    staged = computed_once(staged, {**{f"_{name}": T.search_terms(f"_n_{name}") for name in fields}, "boilerplate_label": label}, head)
    text, source, title, category = (F.col(f"_{n}") for n in ("text", "source_name", "title", "category"))
    staged = computed_once(
        staged,
        {"_text": text, "_source": source, "_title": title, "_category": category, "_special": F.array_union(F.array_union(source, title), category)},
        [*head, "boilerplate_label"],
    )
    text, source, title, category, special = (F.col(n) for n in ("_text", "_source", "_title", "_category", "_special"))

    def special_posting(term: Column) -> Column:
        in_title, in_category = F.array_contains(title, term), F.array_contains(category, term)
        tf = (
            F.array_contains(text, term).cast("int") + F.array_contains(source, term).cast("int")
            + in_title.cast("int") * TITLE_WEIGHT + in_category.cast("int") * CATEGORY_WEIGHT
        )
        return F.struct(term.alias("term"), tf.alias("tf"), in_title.alias("in_title"), in_category.alias("in_category"))

    def text_posting(term: Column) -> Column:
        return F.struct(term.alias("term"), F.lit(1).alias("tf"), F.lit(False).alias("in_title"), F.lit(False).alias("in_category"))

    count = F.size(text) + F.size(source) + F.size(title) * TITLE_WEIGHT + F.size(category) * CATEGORY_WEIGHT
    return staged.select(
        *head, "boilerplate_label",
        F.greatest(count, F.lit(1)).cast("bigint").alias("token_count"),
        # most terms stand in the text only; the membership tests run on the few terms of the short fields
        F.concat(F.transform(F.array_except(text, special), text_posting), F.transform(special, special_posting)).alias("postings"),
    )


def store_index(index: DataFrame) -> DataFrame:
    """Write the index in the shared folder; later steps read single columns of it."""
    return written(index, "index")


def corpus_stats(index: DataFrame) -> DataFrame:
    """O-88: chunk count and mean length (at least 1), over the unfiltered corpus."""
    return index.agg(
        F.count("*").alias("n_chunks"),
        F.greatest(F.lit(1.0), F.coalesce(F.sum("token_count").cast("double") / F.count("*"), F.lit(1.0))).alias("avg_length"),
    )


def term_stats(index: DataFrame) -> DataFrame:
    """O-88: document frequency per term; the partial aggregate absorbs hot terms before the shuffle."""
    return index.select(F.explode("postings.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
