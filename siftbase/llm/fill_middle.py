"""Fill-in-middle transformation: a text is cut in three and its middle goes to the end.

The cuts come from one match: ``fullmatch`` of ``(unit)*`` by the regex library
keeps every repetition of its group, so ``ends(1)`` of the match holds the end
of each unit; its length is n, and the two cuts are two of its entries.  Which
entries, and which form a row takes, follows from a digest of its id alone, so a
rerun on any cluster gives the same rows.

A retained repetition costs some 150 bytes.  A text of more than ``MATCHED``
units is therefore matched in stretches of so many units, one after the other,
which finds the same ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftbase.llm.common import slices, small_batches
from siftbase.llm.registry import query, table
from siftbase.session import written

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: One code point, line feeds included.
UNIT = r"(?s:.)"

#: Per cent of the rows that stay plain, and per cent of the others that put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20

#: Units that one match retains.
MATCHED = 1 << 18

OUTPUT = {"n": T.LongType(), "form": T.StringType(), "prefix": T.StringType(), "middle": T.StringType(), "suffix": T.StringType(), "output": T.StringType()}


def _draws(doc_id: str, seed: int) -> Column:
    """The first four 8-digit groups of the SHA-256 of seed and id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


class Units:
    """Ends of the units of a text, from the repetitions that a match retains."""

    def __init__(self, unit: str = UNIT, matched: int = MATCHED):
        import regex

        self.whole = regex.compile(f"({unit})*")
        self.stretch = regex.compile(f"({unit}){{1,{matched}}}+")
        self.matched = matched

    def ends(self, text: str) -> list[int]:
        """End of every unit; ValueError for a text that is no sequence of units."""
        if len(text) <= self.matched:
            match = self.whole.fullmatch(text)
            if match is None:
                raise ValueError("the text is no sequence of units")
            return match.ends(1)
        out, at = [], 0
        while at < len(text):
            match = self.stretch.match(text, at)
            if match is None or match.end() == at:
                raise ValueError("the text is no sequence of units")
            out += match.ends(1)
            at = match.end()
        return out


def rearranged(text: str, draws: list[int], units: Units, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> tuple:
    """(n, form, prefix, middle, suffix, output) of one text; a plain row has no parts."""
    ends = units.ends(text)
    n = len(ends)
    if not text or any(s in text for s in sentinels) or draws[2] % 100 >= 100 - plain:
        return n, "plain", None, None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    first, last = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = sentinels
    if draws[3] % 100 < suffix_first:
        return n, "spm", prefix, middle, suffix, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", prefix, middle, suffix, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = UNIT, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT, seed: int = 1, matched: int = MATCHED,
) -> DataFrame:
    """Every row of ``docs`` with ``n``, ``form``, ``prefix``, ``middle``, ``suffix`` and ``output``; whole texts, no shuffle.

    ``form`` is plain (the text as it is; prefix, middle and suffix are null),
    psm or spm.  A null text counts as empty, and an empty one is plain with n 0;
    so is a text that holds a sentinel (plain, with its n).  A null id draws as
    the empty string.  Rows of equal id draw alike, each for its own text.
    Columns of these six names are replaced, all others pass; an empty table
    stays empty.  A ``unit`` that does not tile a text is an error.
    """
    docs = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in OUTPUT.items()]])
    wanted = docs.withColumn("_draws", _draws(doc_id, seed))

    def run(batches):
        units = Units(unit, matched)
        for whole in batches:
            for batch in slices(whole, text):
                texts, draws = batch.column(text).to_pylist(), batch.column("_draws").to_pylist()
                made = [rearranged(t or "", d, units, sentinels, plain, suffix_first) for t, d in zip(texts, draws, strict=True)]
                columns = [pa.array([row[k] for row in made], pa.int64() if k == 0 else pa.string()) for k in range(len(OUTPUT))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return wanted.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` of ``form`` was made from.

    The parts hold no sentinel and none can arise where a part meets one, since
    sentinels do not overlap each other; so splitting finds the three parts.
    """
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), draws AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op11_fill_middle", _SQL)
def op11_fill_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    length = lambda part: F.length(part).cast("bigint")
    digests = made.select(
        "doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
    with small_batches(spark):
        return written(digests, "fill_middle")
