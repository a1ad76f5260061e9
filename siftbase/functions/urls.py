"""Column functions over URLs.  Hosts, paths and parameter names are arguments."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from siftbase.functions.text import col, sha_id

# --- fixed values -----------------------------------------------------------
CREDENTIAL_KEY = r"(?i)token|password|passwd|session|jsessionid|authorization|auth"
ATTACHMENT = r"(?i)(?:\.pdf$|\.hwp$|\.hwpx$|\.docx?$|\.xlsx?$|\.pptx?$|\.zip$|file|attach|download|down|bbsFile)"
PDF_LINK = r"\.pdf(?:$|[?#])|pdf|PDF"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# ----------------------------------------------------------------------------


def protocol(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME, 1))


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), URL, 2)


def user_info(url: Column | str) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column | str) -> Column:
    p = F.regexp_extract(col(url), URL, 3)
    return F.when((p == "") & (authority(url) != ""), "/").otherwise(p)


def query(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(url), URL, 4), r"^\?", "")


def fragment(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(url), URL, 5), "^#", "")


def is_https(url: Column | str) -> Column:
    return (protocol(url) == "https") & (host(url) != "")


def is_official(url: Column | str, hosts: Sequence[str], paths: Sequence[str] | None = None) -> Column:
    """O-49: https, an allowed host and, when given, an allowed path."""
    ok = is_https(url) & host(url).isin(*hosts)
    return ok & path(url).isin(*paths) if paths else ok


def in_scope(url: Column | str, scope: Column | str) -> Column:
    """O-50: same host, and the path equals or lies below the scope's path."""
    base = F.regexp_replace(path(scope), "/+$", "")
    p = path(url)
    return (host(url) == host(scope)) & ((p == path(scope)) | F.startswith(p, F.concat(base, F.lit("/"))))


def canonical(url: Column | str) -> Column:
    """O-51: drop user-info and fragment, lower the scheme and host, empty path to ``/``."""
    origin = F.concat(protocol(url), F.lit("://"), F.lower(F.regexp_replace(authority(url), r"^.*@", "")))
    return F.when(authority(url) != "", F.concat(origin, path(url), F.regexp_extract(col(url), URL, 4)))


@F.pandas_udf(StringType())
def _join_batch(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h.strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype="object")


def resolve(href: Column | str, base: Column | str) -> Column:
    """O-51: absolute form of a link.

    Absolute links and links from the root stay in the JVM; the rest (relative
    paths) go to Python in Arrow batches.
    """
    href, base = F.trim(col(href)), col(base)
    origin = F.concat(protocol(base), F.lit("://"), authority(base))
    easy = (
        F.when(href.rlike(SCHEME), href)
        .when(href.rlike("^//"), F.concat(protocol(base), F.lit(":"), href))
        .when(href.rlike(r"^/") & ~href.rlike(r"/\.\.?(/|$)"), F.concat(origin, href))
    )
    hard = _join_batch(F.when(easy.isNull(), base), F.when(easy.isNull(), href))
    return F.coalesce(easy, hard)


def query_keys(url: Column | str) -> Column:
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.regexp_replace(p, "=.*$", ""))


def query_value(url: Column | str, key: str) -> Column:
    return F.regexp_extract(query(url), rf"(?:^|&){key}=([^&]*)", 1)


def has_credential_key(url: Column | str) -> Column:
    """O-52."""
    return F.exists(query_keys(url), lambda k: k.rlike(CREDENTIAL_KEY))


def has_valid_id(url: Column | str, rules: Sequence[tuple[str, Sequence[str], str]]) -> Column:
    """O-53: ``rules`` are (path pattern, parameter names, value pattern); the first matching path decides."""
    out = F.when(F.lit(False), F.lit(False))
    for path_pattern, keys, value_pattern in rules:
        found = F.lit(False)
        for key in keys:
            found = found | query_value(url, key).rlike(value_pattern)
        out = out.when(F.lower(path(url)).rlike(path_pattern), found)
    return out.otherwise(F.lit(False))


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_detailed(url: Column | str) -> Column:
    """O-54: at least two path segments, a query or a fragment."""
    valid = (protocol(url) != "") & (authority(url) != "")
    return valid & ((F.size(path_segments(url)) > 1) | (F.size(query_keys(url)) > 0) | (fragment(url) != ""))


def is_attachment(url: Column | str) -> Column:
    """O-55: by path and query."""
    return F.concat(path(url), F.lit("?"), query(url)).rlike(ATTACHMENT)


def is_pdf_attachment(url: Column | str, label: Column | str) -> Column:
    return F.concat_ws(" ", col(url), col(label)).rlike(PDF_LINK)


def candidate_key(raw: Column | str, normalized: Column | str, pair: tuple[str, str] | None = None, pair_label: str = "pair") -> Column:
    """O-58: id pair, else first number, else 16 hex digits of a hash."""
    raw, normalized = col(raw), col(normalized)
    named = F.regexp_extract(raw, r"(?i)(?:idx|seq|no|id)=?(\d{1,10})", 1)
    loose = F.regexp_extract(raw, r"(?:^|[^\d])(\d{1,10})(?:[^\d]|$)", 1)
    fallback = F.substring(sha_id(raw, normalized), 1, 16)
    key = F.when(named != "", named).when(loose != "", loose).otherwise(fallback)
    if pair is None:
        return key
    first, second = (query_value(normalized, k) for k in pair)
    return F.when((first != "") & (second != ""), F.concat_ws(":", F.lit(pair_label), first, second)).otherwise(key)


def is_unsafe_markdown_url(url: Column | str) -> Column:
    """O-61: script-like schemes, other schemes than http(s), user-info; relative: ``//``, backslash, control characters."""
    u = col(url)
    absolute = u.rlike(SCHEME)
    bad_absolute = ~protocol(u).isin("http", "https") | (user_info(u) != "")
    bad_relative = F.startswith(u, F.lit("//")) | F.contains(u, F.lit("\\")) | u.rlike(r"[\x00-\x1f\x7f]")
    return u.rlike(r"(?i)^(?:javascript|data|file|vbscript):") | F.when(absolute, bad_absolute).otherwise(bad_relative)


def board_of(url: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """O-145: ``rules`` are (lower-case path pattern, board); first match wins, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, board in rules:
        out = out.when(F.lower(path(url)).rlike(pattern), F.lit(board))
    return out


def board_mismatch(url: Column | str, declared: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """O-145: failure text when the path requires another board."""
    expected = board_of(url, rules)
    return F.when(expected.isNotNull() & (expected != col(declared)), F.concat(F.lit("detail_url path requires board "), expected))


def source_label(source_id: Column | str, url: Column | str, labels: Sequence[tuple[str, str, str]], default: str = "확인된 출처") -> Column:
    """O-62: ``labels`` are (id part, host, label); first match wins."""
    out = F.when(F.lit(False), F.lit(default))
    for part, host_name, label in labels:
        out = out.when(F.contains(F.coalesce(col(source_id), F.lit("")), F.lit(part)) | (host(url) == host_name), F.lit(label))
    return out.otherwise(F.lit(default))
