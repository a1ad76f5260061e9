"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only those rows shuffle.

Pass one counts, for each slot of a Bloom filter, how many rows hash to it and
keeps a bit for every slot with two or more; it moves slot numbers, never rows.
Pass two tests each row's slots against the bits during the scan: a row that
misses one bit is certainly unique and passes straight through, the others
shuffle by the SHA-256 of their normalised text, which decides.

The filter's size follows the number of rows up to ``max_filter_bytes``, the
proven bound of its broadcast.  Beyond that more unique rows take the shuffle;
the result does not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftbase.llm.common import broadcast_hot
from siftbase.llm.registry import query, table
from siftbase.session import written

#: The characters that equality ignores: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: Bits of a row of Spark's bitmap functions.
_BUCKET = 32768

#: Slots a row sets, and slots per row of input.
SLOTS, SPARSITY = 2, 16

MAX_FILTER_BYTES = 64 << 20

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _slots(sha: str, bits: int) -> list[Column]:
    """Independent slots of a row, taken from different parts of its digest."""
    return [F.pmod(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("bigint"), F.lit(bits)) for k in range(SLOTS)]


def repeated_slots(hashed: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass one: (bucket, bits) of the slots that two or more rows share."""
    slots = hashed.select(F.explode(F.array(*_slots(sha, bits))).alias("_slot")).groupBy("_slot").agg(F.count("*").alias("_n"))
    seen = slots.where("_n >= 2").select(F.expr(f"_slot div {_BUCKET}").alias("_bucket"), F.pmod("_slot", F.lit(_BUCKET)).alias("_bit"))
    return seen.groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))


def marked(hashed: DataFrame, filled: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass two: add ``_maybe``, true where all slots of a row are set."""
    out = hashed.withColumn("_maybe", F.lit(True))
    for slot in _slots(sha, bits):
        out = out.withColumn("_slot", slot).withColumn("_bucket", F.expr(f"_slot div {_BUCKET}")).join(F.broadcast(filled), "_bucket", "left")
        byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_slot % {_BUCKET}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.expr("shiftright(_byte, cast(_slot % 8 as int)) & 1") == 1
        out = out.withColumn("_byte", byte).withColumn("_maybe", F.col("_maybe") & F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_bits", "_byte")
    return out


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they agree after deleting blanks; a null text counts as
    empty, so null and blank texts are one group.  Of equal texts the one with
    the most code points stays, then the smallest id (null ids last); of rows
    that still tie, exactly one.  An empty table gives an empty result.  Input
    columns named like an output column are replaced; other columns pass.
    """
    columns = [c for c in docs.columns if c not in OUTPUT]
    hashed = docs.select(*columns).withColumn("text_sha256", F.sha2(normalised(F.col(text)).cast("binary"), 256)).withColumn("_points", F.coalesce(F.char_length(text), F.lit(0)))
    total = docs.count()
    bits = min(max(_BUCKET, 1 << (SPARSITY * total - 1).bit_length() if total else 0), 8 * max_filter_bytes)
    filled = written(repeated_slots(hashed, "text_sha256", bits), "bloom")
    tested = marked(hashed, filled, "text_sha256", bits)

    unique = tested.where(~F.col("_maybe")).select(*columns, F.col(doc_id).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    maybe = written(tested.where("_maybe").drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "maybe")
    best = F.max(F.struct(F.col("_points"), F.bitwise_not(doc_id).alias("_low"), (-F.col("_row")).alias("_first"), F.col(doc_id).alias("_keep")))
    groups = maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("_best"))
    groups = written(groups.select("text_sha256", "group_size", F.col("_best._keep").alias("keep_id"), (-F.col("_best._first")).alias("_keep_row")), "groups")
    met = broadcast_hot(maybe, groups, "text_sha256", "group_size", total)
    repeated = met.select(*columns, "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), "text_sha256")
    return unique.unionByName(repeated)


_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""


@query("op2_exact_dedup", _SQL)
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
