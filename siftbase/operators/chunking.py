"""Records to chunks: greedy packing of paragraphs and sentences inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftbase.functions import text as T
from siftbase.session import computed_once

MAX_CHARACTERS = 1_200
SENTENCE_END = rf"(?<=[.!?。！？]){T.SPACE}+"
NORMAL, SLICE = -1, -2


def _slices(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _piece(text: Column, group: Column, glue: str) -> Column:
    return F.struct(text.alias("text"), group.cast("int").alias("group"), F.lit(glue).alias("glue"))


def _pieces(paragraphs: Column, limit: int) -> Column:
    """Packing units in order.

    Units of one group may share a chunk: all plain paragraphs form one group,
    each long paragraph its own; slices of a long sentence stay alone.
    """

    def of_paragraph(p: Column, i: Column) -> Column:
        def of_sentence(s: Column) -> Column:
            sliced = F.transform(_slices(s, limit), lambda x: _piece(x, F.lit(SLICE), ""))
            return F.when(F.length(s) > limit, sliced).otherwise(F.array(_piece(s, i, " ")))

        sentences = F.flatten(F.transform(F.split(p, SENTENCE_END), of_sentence))
        return F.when(F.length(p) > limit, sentences).otherwise(F.array(_piece(p, F.lit(NORMAL), "\n\n")))

    return F.flatten(F.transform(paragraphs, of_paragraph))


def split_text(df: DataFrame, text: str, keep: list[str], limit: int = MAX_CHARACTERS) -> DataFrame:
    """O-31, O-103: rows of (``keep``, chunk_ordinal, text); an empty text gives none."""
    if limit <= 0:
        raise ValueError("limit must be a positive integer")
    paragraphs = F.filter(F.transform(F.split(T.trim_all(F.col(text)), r"\n{2,}"), T.trim_all), lambda p: p != "")
    staged = computed_once(df, {"_paragraphs": paragraphs}, keep)
    staged = computed_once(staged, {"_pieces": _pieces(F.col("_paragraphs"), limit)}, keep)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(-9).alias("group"))

    def step(state: Column, p: Column) -> Column:
        joined = F.concat(state["open"], p["glue"], p["text"])
        fits = (state["group"] == p["group"]) & (p["group"] != SLICE) & (F.length(state["open"]) + F.length(p["glue"]) + F.length(p["text"]) <= limit)
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.when(fits, F.struct(state["done"].alias("done"), joined.alias("open"), p["group"].alias("group"))).otherwise(
            F.struct(closed.alias("done"), p["text"].alias("open"), p["group"].alias("group"))
        )

    chunks = F.aggregate("_pieces", empty, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return staged.select(*keep, F.posexplode(chunks).alias("chunk_ordinal", "text"))


def chunk_records(records: DataFrame, limit: int = MAX_CHARACTERS) -> DataFrame:
    """Records (M1) to chunks (M2) with hashed chunk ids (O-30)."""
    keep = [c for c in records.columns if c not in ("raw_text", "cleaned_text")]
    parts = split_text(records, "cleaned_text", keep, limit)
    anchor = F.coalesce(F.get("citation_anchors", F.lit(0))["url"], F.col("canonical_url"))
    return parts.withColumn("chunk_id", T.sha_id("source_id", "content_hash", anchor, "chunk_ordinal"))
