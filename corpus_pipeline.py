"""From raw documents to packed sequences: five stages, each one operator of ``siftbase.llm``.

Every stage takes the table that the previous one kept, decides over all of it
and returns it without what it rejects; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftbase.llm.common import split_by_ids
from siftbase.llm.exact_dedup import exact_dedup
from siftbase.llm.language_id import UNDETERMINED, identify, train
from siftbase.llm.mixing import mix
from siftbase.llm.near_dup import near_duplicates, without
from siftbase.llm.packing import best_fit_packing
from siftbase.session import written

#: Below this posterior probability a document's language counts as unknown.
MIN_LANGUAGE_SCORE = 0.5

#: No stage-by-stage SQL can train the classifier, verify the join or breed packings; tests compare with brute force.
ORACLE_SQL = None


#: Bytes of an Arrow batch for the session that runs the pipeline: executors and their workers hold a few at a time.
BATCH_BYTES = "8m"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; null and letterless texts and uncertain ones go.

    Where no row has a language there is nothing to tell apart, and all rows
    stay.  Rows are judged one by one, whatever their ids.
    """
    _bounded(spark)
    model = train(docs)
    if not model.languages:
        return docs
    told = identify(docs, model)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, blanks aside; all null and empty texts are one text.  Ids may repeat or be null."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


#: Digest of a row's id and text, by which the near-duplicate stage tells rows apart.
ROW = "_row"


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, a null id last.

    Groups are of rows, not of ids: rows that share an id but not a text stand
    for themselves, and of rows equal in both one stays.  Texts without words
    are in no group, so all of them stay, repeated ones too.
    """
    rows = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    groups = written(near_duplicates(rows, doc_id=ROW).where("n_shingles > 0").select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    members = groups.groupBy(ROW).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))
    placed = written(members.join(rows.select(ROW, "doc_id").distinct(), ROW).withColumn("place", place), "members")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    dropped = placed.join(first, "component_id").where(F.col("place") != F.col("first")).select(ROW)
    kept = without(rows, dropped, ROW)
    repeated = placed.where("n > 1").select(ROW)
    maybe, alone = split_by_ids(kept, repeated, ROW)
    once = maybe.join(repeated, ROW, "left_semi").dropDuplicates([ROW])
    return alone.unionByName(maybe.join(repeated, ROW, "left_anti")).unionByName(once).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for; null is a source of its own, and rows of equal id stay rows of their own."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences; a null text is an empty one."""
    _bounded(spark)
    return best_fit_packing(docs, keep=False)  # a worker's memory is for the next stage


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
