"""Column functions over text: normalising, terms, cleaning, ids, redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------
# White space as web scripts understand it; Java's \s is ASCII only.
WIDE_SPACE = r"\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = rf"[\s{WIDE_SPACE}]"
CONTROL = r"\x00-\x1f\x7f"
ORNAMENTS = "“”‘’`´·•★☆▶▷◀◁◆◇■□▲△▼▽|"
ASCII_PUNCTUATION = r"""()\[\]{}<>.,;:!?"'\\/"""
TOKEN = r"[\p{L}\p{N}]+"
HANGUL_RUN = "[가-힣]+"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
UNIT_SEPARATOR = "\u001f"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
STUDENT_ID = r"(?<!\d)(?:19|20)\d{6,8}(?!\d)"
GAP = rf"[-\s{WIDE_SPACE}]?"
PHONE_NUMBER = rf"(?:\+82{GAP})?(?:0\d{{1,2}}|1\d{{2}}){GAP}\d{{3,4}}{GAP}\d{{4}}"
PHONE = rf"(?<!\d){PHONE_NUMBER}(?![A-Za-z0-9_])"

BEARER_HEADER = r"(?i)Authorization\s*:\s*Bearer\s+[^\s,;]+"

# Characters that Unicode normal form KC surely leaves alone; any other
# character sends its row to the Python worker.
NFKC_SAFE = (
    r"\x00-\x7F\x{00A1}-\x{00A7}\x{00A9}\x{00AB}-\x{00AE}\x{00B0}\x{00B1}\x{00B6}\x{00B7}\x{00BB}"
    r"\x{00BF}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}"
    r"\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
)
# The same question for Latin texts alone, as a class that is quick to test.
NFKC_LATIN_SUSPECT = (
    r"[^\x00-\x{017E}]|[\x{00A0}\x{00A8}\x{00AA}\x{00AF}\x{00B2}\x{00B3}\x{00B4}\x{00B5}\x{00B8}\x{00B9}\x{00BA}\x{00BC}\x{00BD}\x{00BE}]"
    r"|[\x{0132}\x{0133}\x{013F}\x{0140}\x{0149}]"
)
NEGATION_MARKERS = ("아니", "않", "없", "못", "지 않", "아닙니다", "없습니다", "하지 않")
NEGATION_BEFORE = 12
NEGATION_AFTER = 16
# ----------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column | str) -> Column:
    """Unicode normal form KC.  Only rows with a character outside the safe set travel to Python."""
    c = col(c)
    needs = c.rlike(NFKC_LATIN_SUSPECT) & c.rlike(f"[^{NFKC_SAFE}]")
    return F.coalesce(_nfkc_batch(F.when(needs, c)), c)


def trim_all(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space to one blank, ends trimmed.

    A single blank is left out of the pattern: it would be replaced by itself,
    once per word.
    """
    return F.trim(F.regexp_replace(col(c), rf"{SPACE}{{2,}}|[\t\n\x0B\f\r{WIDE_SPACE}]", " "))


def normalize_search_text(c: Column | str, use_nfkc: bool = True) -> Column:
    """O-22: comparable form of text for search."""
    return separators_to_blank(lower_nfkc(c, use_nfkc))


def lower_nfkc(c: Column | str, use_nfkc: bool = True) -> Column:
    return F.lower(nfkc(c) if use_nfkc else col(c))


SEPARATOR_SET = CONTROL + ORNAMENTS + ASCII_PUNCTUATION + r"\s" + WIDE_SPACE
SEPARATORS = f"[{SEPARATOR_SET}]"


def separators_to_blank(lowered: Column) -> Column:
    """Every run of control characters, ornaments, ASCII punctuation and white space becomes one blank."""
    return F.trim(F.regexp_replace(lowered, f"{SEPARATORS}{{2,}}|[{SEPARATOR_SET}&&[^ ]]", " "))


def tokens(normalized: Column | str) -> Column:
    """O-23: runs of letters and digits.

    Separators are neither, so lower-cased text gives the same tokens as text in
    search form.
    """
    return F.regexp_extract_all(col(normalized), F.lit(TOKEN), F.lit(0))


def hangul_ngrams(normalized: Column | str, sizes: Sequence[int] = (2, 3)) -> Column:
    """O-24: distinct character n-grams of each Hangul run."""
    runs = F.regexp_extract_all(col(normalized), F.lit(HANGUL_RUN), F.lit(0))
    usable = [s for s in sizes if isinstance(s, int) and s > 0]
    if not usable:
        return F.array().cast("array<string>")

    def sized(run: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1)))
        return F.when(F.length(run) >= n, F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(run: Column) -> Column:
        return F.concat(*[sized(run, n) for n in usable])

    return F.array_distinct(F.flatten(F.transform(runs, grams)))


def search_terms(normalized: Column | str, sizes: Sequence[int] = (2, 3)) -> Column:
    """O-25: tokens and n-grams as a set."""
    return F.array_union(tokens(normalized), hangul_ngrams(normalized, sizes))


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """Words of a fixed list that occur in ``c``, in list order."""
    c = col(c)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def sha_id(*parts: Column | str) -> Column:
    """O-30: SHA-256 over the parts joined by the unit separator; a null part counts as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def clean_inline(c: Column | str) -> Column:
    return collapse(c)


def clean_block(c: Column | str) -> Column:
    """O-32: clean every line, drop empty ones."""
    lines = F.split(F.regexp_replace(col(c), r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, collapse), lambda line: line != ""), "\n")


def drop_lines(c: Column | str, exact: Sequence[str], patterns: Sequence[str] = ()) -> Column:
    """O-33: remove site-furniture lines given as exact texts and patterns."""

    def keep(line: Column) -> Column:
        ok = ~line.isin(*exact) if exact else F.lit(True)
        for p in patterns:
            ok = ok & ~line.rlike(p)
        return ok

    return F.array_join(F.filter(F.split(col(c), "\n"), keep), "\n")


def labelled_value(body: Column | str, label: str, all_labels: Sequence[str], max_length: int = 200) -> Column:
    """O-34: the lines after ``label`` up to the next label, or null when empty or too long."""

    def after(lines: Column) -> Column:
        at = F.array_position(lines, F.lit(label)).cast("int")
        return F.when(at > 0, F.slice(lines, at + 1, F.size(lines)))

    def joined(rest: Column) -> Column:
        stops = [F.array_position(rest, F.lit(x)) for x in all_labels]
        until = F.coalesce(F.array_min(F.array(*[F.when(s > 0, s - 1) for s in stops])), F.size(rest)).cast("int") if stops else F.size(rest)
        return collapse(F.array_join(F.filter(F.slice(rest, 1, until), lambda line: line != ""), " "))

    lines = F.transform(F.split(col(body), r"\r?\n"), trim_all)
    value = _bound(_bound(lines, after), joined)
    kept = _bound(value, lambda v: F.when((F.length(v) > 0) & (F.length(v) <= max_length), v))
    return F.when(F.contains(col(body), F.lit(label)), kept)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def promote_title(title: Column | str, body: Column | str, generic: Sequence[str], label: str, all_labels: Sequence[str]) -> Column:
    """O-35: replace a generic title by the labelled title of the body."""
    title = col(title)
    return F.when(trim_all(title).isin(*generic), F.coalesce(labelled_value(body, label, all_labels), title)).otherwise(title)


def strip_hit_suffix(title: Column | str) -> Column:
    """O-36: remove a trailing view counter."""
    return F.trim(F.regexp_replace(col(title), r"(?i)\s+Hit\s+\d+(?:\s+New)?$", ""))


def title_or_keyword_line(title: Column | str, body: Column | str, keyword_pattern: str) -> Column:
    """O-36: the title, else the first body line with a keyword."""
    title = clean_inline(title)
    line = F.get(F.filter(F.split(clean_block(body), "\n"), lambda x: x.rlike(keyword_pattern)), F.lit(0))
    return strip_hit_suffix(F.when(title != "", title).otherwise(F.coalesce(line, F.lit(""))))


def normalize_safety_text(c: Column | str, use_nfkc: bool = True) -> Column:
    """O-37: comparable form of text for the safety rules."""
    c = nfkc(c) if use_nfkc else col(c)
    return collapse(F.lower(F.regexp_replace(c, ZERO_WIDTH, "")))


def redact_personal_data(c: Column | str) -> Column:
    """O-38: e-mail, then student number, then phone.

    The cheap tests keep the costly patterns away from texts without an at sign
    or a run of four digits, which none of them can match.
    """
    c = col(c)
    c = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "[redacted_email]")).otherwise(c)
    numbers = F.regexp_replace(F.regexp_replace(c, STUDENT_ID, "[redacted_student_id]"), PHONE, "[redacted_phone]")
    return F.when(c.rlike(r"\d{4}"), numbers).otherwise(c)


def has_personal_data(c: Column | str) -> Column:
    """The detection form of O-38, which is wider on phones (no left or right guard)."""
    c = col(c)
    return (F.contains(c, F.lit("@")) & c.rlike(EMAIL)) | (c.rlike(r"\d{4}") & c.rlike(f"{PHONE_NUMBER}|{STUDENT_ID}"))


def negated_near(normalized: Column, phrase: Column) -> Column:
    """O-39: a negation marker stands close to the first occurrence of ``phrase``.

    Both arguments are in safety form; citation markers are ignored.
    """
    plain = F.regexp_replace(normalized, r"\[\d+\]", "")
    at = F.instr(plain, phrase)
    start = F.greatest(at - NEGATION_BEFORE, F.lit(1))
    stop = at + F.length(phrase) + NEGATION_AFTER
    window = F.substring(plain, start, stop - start)
    hit = F.exists(F.array(*[F.lit(m) for m in NEGATION_MARKERS]), lambda m: F.contains(window, m))
    return (at > 0) & hit


def sanitize_prompt_text(c: Column | str, secret_prefix: str = "[A-Z]+_[A-Z_]*KEY") -> Column:
    """O-40: control characters to blanks, secret assignments masked, lines cleaned."""
    c = F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    c = F.regexp_replace(c, rf"{secret_prefix}\s*=\s*[^\s]+", "[redacted_env_config]")
    return clean_block(c)


def escape_markup(c: Column | str) -> Column:
    """O-41."""
    c = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def unescape_markup(c: Column | str) -> Column:
    c = F.replace(col(c), F.lit("&lt;"), F.lit("<"))
    c = F.replace(c, F.lit("&gt;"), F.lit(">"))
    c = F.replace(c, F.lit("&quot;"), F.lit('"'))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def compact_whitespace(c: Column | str) -> Column:
    """O-42: blanks and tabs to one blank, white space around line breaks removed."""
    c = F.regexp_replace(col(c), r"[\t ]+", " ")
    return trim_all(F.regexp_replace(c, f"{SPACE}*\n{SPACE}*", "\n"))


def strip_unsafe_blocks(c: Column | str) -> Column:
    """O-42: drop script, style and iframe blocks with their content."""
    for tag in ("script", "style", "iframe"):
        c = F.regexp_replace(col(c), rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return c


def preference_text(c: Column | str) -> Column:
    """O-43: lower case, punctuation and symbols to blanks."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[\s\x{00A0}\x{3000}\p{P}\p{S}]+", " "))


def preference_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def citation_markers(c: Column | str) -> Column:
    """O-44: numbers of ``[n]`` markers in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))


MARKDOWN_IMAGE = r"!\[[^\n]*?\]\([^\n)]*\)"
MARKDOWN_LINK = r"(?<!!)\[[^\n]+?\]\([^\n)]*\)"
AUTOLINK = r"<(?:(?:https?://|mailto:)[^\s<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})>"
RAW_URL = r"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)[^\s<>()]+"
RAW_TAG = r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?>"


def visible_text(c: Column | str) -> Column:
    """O-45: blank out everything in which a citation marker would not be shown."""
    c = F.regexp_replace(col(c), r"\r\n?", "\n")
    fenced = F.regexp_replace(c, r"(?ms)^```.*?^```", " ")
    c = F.when(fenced != c, fenced).otherwise(F.regexp_replace(c, r"(?ms)^~~~.*?^~~~", " "))
    for pattern in (r"`[^`\n]*`", MARKDOWN_IMAGE, MARKDOWN_LINK, AUTOLINK, RAW_URL, RAW_TAG):
        c = F.regexp_replace(c, pattern, " ")
    return c


def visible_markers(c: Column | str) -> Column:
    return citation_markers(visible_text(c))


def redact_secrets(c: Column | str, key_names: str = "[A-Z][A-Z_]*_API_KEY", min_token: int = 24) -> Column:
    """O-46: bearer headers, assignments to ``key_names``, long tokens."""
    c = F.regexp_replace(col(c), BEARER_HEADER, "Authorization: Bearer [redacted]")
    c = F.regexp_replace(c, rf"({key_names})\s*=\s*[^\s,;]+", "$1=[redacted]")
    return F.regexp_replace(c, f"[A-Za-z0-9_-]{{{min_token},}}", "[redacted]")


def has_hangul(c: Column | str) -> Column:
    """O-47."""
    return col(c).rlike("[가-힣]")
