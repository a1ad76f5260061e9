"""Registered queries: text, URL and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftbase.functions import dates as D, text as T, urls as U
from siftbase.plans import corpus as C
from siftbase.plans.registry import query, table

WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    lines = rf"list_transform(string_split(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(10)), lambda l: {sql_collapse('l')})"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


def sql_redact(x: str) -> str:
    """Look-around free form: the guard before a number is captured and put back; two passes reach neighbours."""
    x = f"regexp_replace({x}, '{T.EMAIL}', '[redacted_email]', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^0-9])(?:19|20)[0-9]{{6,8}}([^0-9]|$)', '\1[redacted_student_id]\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^0-9]){T.PHONE_NUMBER}($|[^A-Za-z0-9_])', '\1[redacted_phone]\2', 'g')"
    return x


@query("clean_block", f"SELECT doc_id, {sql_clean(chr(39) + '  ' + chr(39) + ' || replace(text, chr(10), chr(13) || chr(10))')} AS cleaned FROM documents")
def clean_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return d.select("doc_id", T.clean_block(raw).alias("cleaned"))


@query("chrome_lines_exact", r"""SELECT doc_id, array_to_string(list_filter(string_split('목록' || chr(10) || text || chr(10) || '공지사항', chr(10)),
   lambda l: l NOT IN ('목록', '공지사항') AND NOT regexp_matches(l, '^.+님, 환영합니다\.$') AND NOT regexp_matches(l, '^[A-Z][a-z]{1,3}\.$')), chr(10)) AS kept FROM documents""")
def chrome_lines_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("목록\n"), F.col("text"), F.lit("\n공지사항"))
    return d.select("doc_id", T.drop_lines(body, ["목록", "공지사항"], [r"^.+님, 환영합니다\.$", r"^[A-Z][a-z]{1,3}\.$"]).alias("kept"))


_LABELS = ["제목", "기간", "장소", "내용"]


@query("labelled_title", r"""WITH posts AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '채용설명회' ELSE 'post ' || CAST(doc_id AS VARCHAR) END AS title,
         CASE WHEN doc_id % 2 = 0 THEN '제목' || chr(10) || source || '  ' || lang || chr(10) || '기간' || chr(10) ELSE '기간' || chr(10) END || text AS body FROM documents),
parts AS (SELECT *, list_transform(regexp_split_to_array(body, '\r?\n'), lambda l: trim(l)) AS lines FROM posts),
located AS (SELECT *, coalesce(list_position(lines, '제목'), 0) AS p FROM parts),
rest AS (SELECT *, CASE WHEN p > 0 THEN lines[p + 1:] ELSE [] END AS tail FROM located),
cut AS (SELECT *, coalesce(list_min(list_filter(list_transform(['제목', '기간', '장소', '내용'], lambda x: list_position(tail, x)), lambda v: v IS NOT NULL AND v > 0)), len(tail) + 1) AS stop FROM rest),
val AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(tail[1:stop - 1], lambda l: l <> ''), ' '), '\s+', ' ', 'g')) AS v FROM cut)
SELECT doc_id, CASE WHEN p > 0 AND v <> '' AND length(v) <= 200 THEN v END AS value,
       CASE WHEN title = '채용설명회' THEN coalesce(CASE WHEN p > 0 AND v <> '' AND length(v) <= 200 THEN v END, title) ELSE title END AS promoted FROM val""")
def labelled_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    posts = d.select(
        "doc_id",
        F.when(i % 3 == 0, "채용설명회").otherwise(F.concat(F.lit("post "), i)).alias("title"),
        F.concat(F.when(i % 2 == 0, F.concat(F.lit("제목\n"), "source", F.lit("  "), "lang", F.lit("\n기간\n"))).otherwise("기간\n"), "text").alias("body"),
    )
    return posts.select(
        "doc_id", T.labelled_value("body", "제목", _LABELS).alias("value"), T.promote_title("title", "body", ["채용설명회"], "제목", _LABELS).alias("promoted")
    )


@query("title_cleanup", r"""SELECT doc_id, trim(regexp_replace(split_part(text, '.', 1) || '  Hit ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ' New' ELSE '' END, '(?i)\s+Hit\s+\d+(?:\s+New)?$', '')) AS title FROM documents""")
def title_cleanup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit("  Hit "), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, " New").otherwise(""))
    return d.select("doc_id", T.strip_hit_suffix(raw).alias("title"))


@query("record_ids", f"""WITH {C.CHUNKS_SQL} SELECT chunk_id, sha256(source_id || chr(31) || canonical_url || chr(31) || title || chr(31) || coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%S.000Z'), '') || chr(31) || content_hash) AS record_hash,
   sha256(source_id || chr(31) || content_hash || chr(31) || canonical_url || chr(31) || '0') AS chunk_hash FROM chunks""")
def record_ids(spark, sf_dir):
    c = C.chunks(spark, sf_dir)
    posted = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.select(
        "chunk_id",
        T.sha_id("source_id", "canonical_url", "title", posted, "content_hash").alias("record_hash"),
        T.sha_id("source_id", "content_hash", "canonical_url", F.lit(0)).alias("chunk_hash"),
    )


@query("redact_email", f"SELECT doc_id, regexp_replace(text, '{T.EMAIL}', '[redacted_email]', 'g') AS redacted FROM documents")
def redact_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", T.EMAIL, "[redacted_email]").alias("redacted"))


@query("redact_all", f"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, {sql_redact('text')} AS redacted FROM documents
UNION ALL SELECT 'w' || CAST(doc_id AS VARCHAR), {sql_redact("replace(replace(text, ' ', chr(160)), '-', chr(12288))")} FROM documents
UNION ALL SELECT * FROM (WITH {C.REQUESTS_SQL} SELECT request_id, {sql_redact('query')} FROM requests)""")
def redact_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    wide = table(spark, sf_dir, "documents").select(F.concat(F.lit("w"), F.col("doc_id")).alias("id"), F.translate("text", " -", "\u00a0\u3000").alias("text"))
    both = docs.unionByName(wide).unionByName(C.requests(spark, sf_dir).select(F.col("request_id").alias("id"), F.col("query").alias("text")))
    return both.select("id", T.redact_personal_data("text").alias("redacted"))


def sql_safety(x: str) -> str:
    return sql_collapse(f"lower(regexp_replace({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'))")


def sql_negated(norm: str, phrase: str) -> str:
    plain = rf"regexp_replace({norm}, '\[\d+\]', '', 'g')"
    at = f"instr({plain}, {phrase})"
    window = f"substr({plain}, greatest({at} - 12, 1), {at} + length({phrase}) + 16 - greatest({at} - 12, 1))"
    return f"({at} > 0 AND len(list_filter({C.sql_list(T.NEGATION_MARKERS)}, lambda m: contains({window}, m))) > 0)"


@query("negation_window", f"WITH {C.REQUESTS_SQL}, n AS (SELECT request_id, {sql_safety('query')} AS t FROM requests) SELECT request_id, {sql_negated('t', chr(39) + '보장' + chr(39))} AS negated, contains(t, '보장') AS present FROM n")
def negation_window(spark, sf_dir):
    norm = C.requests(spark, sf_dir).select("request_id", T.normalize_safety_text("query").alias("t"))
    return norm.select("request_id", T.negated_near(F.col("t"), F.lit("보장")).alias("negated"), F.contains("t", F.lit("보장")).alias("present"))


@query("prompt_text", r"""WITH s AS (SELECT page_id, html || chr(7) || ' API_SERVICE_KEY = abc' || CAST(page_id AS VARCHAR) || ' end' AS t FROM pages),
c AS (SELECT page_id, """ + sql_clean(r"regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[A-Z]+_[A-Z_]*KEY\s*=\s*[^\s]+', '[redacted_env_config]', 'g')") + """ AS x FROM s)
SELECT page_id, x AS sanitized, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM c""")
def prompt_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    raw = F.concat("html", F.lit("\x07 API_SERVICE_KEY = abc"), F.col("page_id"), F.lit(" end"))
    clean = p.select("page_id", T.sanitize_prompt_text(raw).alias("sanitized"))
    return clean.select("page_id", "sanitized", T.escape_markup("sanitized").alias("escaped"))


@query("unescape_round_trip", "SELECT page_id, html AS back FROM pages")
def unescape_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.escape_markup("html").alias("e"))
    return p.select("page_id", T.unescape_markup("e").alias("back"))


@query("strip_blocks", r"""SELECT page_id, trim(regexp_replace(regexp_replace(
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe>', '', 'g'),
 '[\t ]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS stripped FROM pages""")
def strip_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.compact_whitespace(T.strip_unsafe_blocks("html")).alias("stripped"))


@query("preference_tokens", r"""SELECT request_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(query), '[\s\x{00A0}\x{3000}\p{P}\p{S}]+', ' ', 'g')), ' '), lambda t: t <> ''), '|') AS tokens
 FROM (WITH """ + C.REQUESTS_SQL + " SELECT * FROM requests)")
def preference_tokens(spark, sf_dir):
    norm = C.requests(spark, sf_dir).select("request_id", T.preference_text("query").alias("t"))
    return norm.select("request_id", F.array_join(T.preference_tokens(F.col("t")), "|").alias("tokens"))


def sql_visible(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?ms)^```.*?^```', ' ', 'g'), '`[^`\n]*`', ' ', 'g')"
    x = rf"regexp_replace({x}, '!\[[^\n]*?\]\([^\n)]*\)', ' ', 'g')"
    x = rf"regexp_replace({x}, '\[[^\n]+?\]\([^\n)]*\)', ' ', 'g')"
    x = rf"regexp_replace({x}, '{T.AUTOLINK}', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(?:https?://|www\.)[^\s<>()]+', ' ', 'g')"
    return rf"regexp_replace({x}, '{T.RAW_TAG}', ' ', 'g')"


@query("citation_markers", f"""WITH {C.ANSWERS_SQL} SELECT request_id, array_to_string(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS raw_ids,
 array_to_string(list_transform(regexp_extract_all({sql_visible('answer')}, '\\[(\\d+)\\]', 1), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS visible_ids FROM answers""")
def citation_markers(spark, sf_dir):
    a = C.answers(spark, sf_dir)
    return a.select(
        "request_id",
        F.array_join(T.citation_markers("answer").cast("array<string>"), ",").alias("raw_ids"),
        F.array_join(T.visible_markers("answer").cast("array<string>"), ",").alias("visible_ids"),
    )


@query("redact_secrets", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' Authorization: Bearer x' || CAST(doc_id AS VARCHAR) || ', SERVICE_API_KEY=abc',
 '(?i)Authorization\s*:\s*Bearer\s+[^\s,;]+', 'Authorization: Bearer [redacted]', 'g'), '([A-Z][A-Z_]*_API_KEY)\s*=\s*[^\s,;]+', '\1=[redacted]', 'g'), '[A-Za-z0-9_-]{24,}', '[redacted]', 'g') AS redacted FROM documents""")
def redact_secrets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat("text", F.lit(" Authorization: Bearer x"), F.col("doc_id"), F.lit(", SERVICE_API_KEY=abc"))
    return d.select("doc_id", T.redact_secrets(raw).alias("redacted"))


@query("hangul_presence", f"WITH {C.ANSWERS_SQL} SELECT request_id, regexp_matches(answer, '[가-힣]') AS has_hangul FROM answers")
def hangul_presence(spark, sf_dir):
    return C.answers(spark, sf_dir).select("request_id", T.has_hangul("answer").alias("has_hangul"))


# --- dates --------------------------------------------------------------------
def deadline_rows(spark, sf_dir):
    """Conversation turns with a deadline phrase appended to the whole text."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn")
    return c.select("conv_id", "turn", F.concat("text", F.lit(" "), C.pick(C.DEADLINE_TEXTS, n % len(C.DEADLINE_TEXTS))).alias("t"),
                    C.pick(D_STATUSES, n % 3).alias("stored"))


D_STATUSES = ("unknown", "active", "expired")
_DL = f"""rows AS (SELECT conv_id, turn, text || ' ' || {C.sql_pick(C.DEADLINE_TEXTS, f'(conv_id * 7 + turn) % {len(C.DEADLINE_TEXTS)}')} AS raw, {C.sql_pick(D_STATUSES, '(conv_id * 7 + turn) % 3')} AS stored FROM conversations)"""
_DAY = "(?:3[01]|[12][0-9]|0?[1-9])"
_MON = "(?:0?[1-9]|1[0-2])"
_SHORT = rf"(?:^|[^0-9])((?:~|마감(?:일)?\s*[:：]?\s*|접수\s*(?:기한|마감)\s*[:：]?\s*)(0?[1-9]|1[0-2])[.\-/월]\s*{_DAY}(?:일)?)"
_VAGUE = rf"(?:^|[^0-9.-])({_MON}[.\-/월]\s*{_DAY}(?:일)?(?:\s*[~–-]\s*{_MON}?[.\-/월]?\s*{_DAY}(?:일)?)?)"
DEADLINE_SQL = rf"""
WITH {_DL}, norm AS (SELECT *, {sql_collapse('raw')} AS t FROM rows),
found AS (
  SELECT *, regexp_extract(t, '{D.OPEN_ENDED}') AS open_ended, regexp_extract(t, '{D.D_DAY}') AS d_day, regexp_extract(t, '{D.D_DAY}', 1) AS d_sign, regexp_extract(t, '{D.D_DAY}', 2) AS d_count,
     regexp_extract(t, '{_SHORT}', 1) AS short, regexp_extract(t, '{_SHORT}', 2) AS short_month, regexp_extract(t, '{D.LABELLED_DATE}') AS full_text,
     regexp_extract(regexp_replace(t, '마감\s*(일|기한|기간)', '', 'g'), '(?:^|[^일])((?:접수\s*)?마감(?:됨|완료)?)', 1) AS closed, regexp_extract(t, '{_VAGUE}', 1) AS vague
  FROM norm),
dated AS (
  SELECT *, '2024-' || lpad(short_month, 2, '0') || '-' || lpad(regexp_extract(short, '{_MON}[.\-/월]\s*(3[01]|[12][0-9]|0?[1-9])', 1), 2, '0') AS short_date,
     regexp_extract(full_text, '{D.FULL_DATE}', 1) || '-' || lpad(regexp_extract(full_text, '{D.FULL_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(full_text, '{D.FULL_DATE}', 3), 2, '0') AS full_date
  FROM found),
ruled AS (
  SELECT *, CASE WHEN open_ended <> '' THEN 'active' WHEN d_day <> '' THEN CASE WHEN d_sign = '-' AND CAST(d_count AS HUGEINT) > 0 THEN 'active' ELSE 'expired' END
     WHEN short <> '' THEN CASE WHEN short_date >= '2024-06-01' THEN 'active' ELSE 'expired' END WHEN full_text <> '' THEN CASE WHEN full_date >= '2024-06-01' THEN 'active' ELSE 'expired' END
     WHEN closed <> '' THEN 'expired' ELSE 'unknown' END AS status,
     CASE WHEN open_ended <> '' THEN open_ended WHEN d_day <> '' THEN regexp_replace(d_day, '\s+', '', 'g') WHEN short <> '' THEN short WHEN full_text <> '' THEN full_text WHEN closed <> '' THEN trim(closed)
          WHEN vague <> '' THEN vague END AS deadline_raw_text,
     CASE WHEN open_ended <> '' OR d_day <> '' THEN NULL WHEN short <> '' THEN short_date WHEN full_text <> '' THEN full_date END AS deadline_date FROM dated)
"""


@query("deadline_rules", DEADLINE_SQL + "SELECT conv_id, turn, status, deadline_raw_text, deadline_date FROM ruled")
def deadline_rules(spark, sf_dir):
    return deadline_rows(spark, sf_dir).select("conv_id", "turn", D.classify_deadline("t", C.ref_ts()).alias("d")).select("conv_id", "turn", "d.*")


@query("effective_status", DEADLINE_SQL + "SELECT conv_id, turn, CASE WHEN status = 'unknown' THEN stored ELSE status END AS status FROM ruled")
def effective_status(spark, sf_dir):
    return deadline_rows(spark, sf_dir).select("conv_id", "turn", D.effective_status("t", "stored", C.ref_ts()).alias("status"))


@query("deadline_keywords", rf"WITH {_DL} SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '{D.CLOSED_WORDS}') THEN 'expired' WHEN regexp_matches(raw, '{D.OPEN_WORDS}') THEN 'active' ELSE 'unknown' END AS status FROM rows")
def deadline_keywords(spark, sf_dir):
    return deadline_rows(spark, sf_dir).select("conv_id", "turn", D.classify_deadline_keywords("t").alias("status"))


@query("deadline_last_date", rf"""WITH {_DL}, m AS (SELECT *, regexp_extract_all(raw, '{D.LOOSE_FULL_DATE}') AS fulls, regexp_extract(raw, '(\d{{1,2}})[.\-/](\d{{1,2}})', 1) AS m1, regexp_extract(raw, '(\d{{1,2}})[.\-/](\d{{1,2}})', 2) AS d1 FROM rows),
dd AS (SELECT *, CASE WHEN len(fulls) > 0 THEN regexp_extract(fulls[-1], '{D.LOOSE_FULL_DATE}', 1) || '-' || lpad(regexp_extract(fulls[-1], '{D.LOOSE_FULL_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(fulls[-1], '{D.LOOSE_FULL_DATE}', 3), 2, '0')
   WHEN m1 <> '' THEN '2024-' || lpad(m1, 2, '0') || '-' || lpad(d1, 2, '0') END AS day FROM m)
SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '채용시까지|상시채용') THEN 'active' WHEN day IS NULL THEN 'unknown'
  WHEN TRY_CAST(day || ' 23:59:59' AS TIMESTAMP) - INTERVAL 9 HOUR < {C.REF_SQL} THEN 'expired' ELSE 'active' END AS status FROM dd""")
def deadline_last_date(spark, sf_dir):
    return deadline_rows(spark, sf_dir).select("conv_id", "turn", D.classify_deadline_last_date("t", C.ref_ts()).alias("status"))


@query("posted_dates", rf"""WITH {_DL} SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '{D.FULL_DATE}') THEN regexp_extract(raw, '{D.FULL_DATE}', 1) || '-' || lpad(regexp_extract(raw, '{D.FULL_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(raw, '{D.FULL_DATE}', 3), 2, '0') || 'T00:00:00.000Z' END AS posted_at FROM rows""")
def posted_dates(spark, sf_dir):
    return deadline_rows(spark, sf_dir).select("conv_id", "turn", D.posted_date("t").alias("posted_at"))


@query("recency", f"""WITH {C.CHUNKS_SQL} SELECT chunk_id,
  CASE WHEN status = 'active' THEN 0.35 WHEN date_diff('day', coalesce(posted_at, fetched_at), {C.REF_SQL}) <= 30 THEN 0.2 WHEN date_diff('day', coalesce(posted_at, fetched_at), {C.REF_SQL}) <= 180 THEN 0.1 ELSE 0.0 END AS boost,
  round(CASE WHEN posted_at IS NULL THEN 0.35 ELSE greatest(0.0, least(1.0, 1.0 - date_diff('day', posted_at, {C.REF_SQL}) / 120.0)) END, 6) AS posted_recency,
  CASE status WHEN 'active' THEN 'open' WHEN 'expired' THEN 'closed' ELSE 'unknown' END AS display FROM chunks""")
def recency(spark, sf_dir):
    c = C.chunks(spark, sf_dir).withColumn("status", D.effective_status("deadline_raw_text", "deadline_status", C.ref_ts()))
    return c.select(
        "chunk_id",
        D.freshness_boost(F.col("status"), F.col("posted_at"), F.col("fetched_at"), C.ref_ts()).alias("boost"),
        F.round(D.recency(F.col("posted_at"), C.ref_ts(), 120), 6).alias("posted_recency"),
        D.relabel_status("status").alias("display"),
    )


@query("hit_counts", r"SELECT event_id, CASE WHEN regexp_matches(trim(v), '^\d+$') THEN CAST(trim(v) AS BIGINT) END AS hits FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Hit 7' ELSE ' ' || CAST(event_id AS VARCHAR) || ' ' END AS v FROM events)")
def hit_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, "Hit 7").otherwise(F.concat(F.lit(" "), F.col("event_id"), F.lit(" ")))
    return e.select("event_id", D.hit_count(v).alias("hits"))


# --- URLs ---------------------------------------------------------------------
URL_TAILS = ("", "?token=abc&x=1", "/view.aspx?idx=12", "/guide.pdf", "?file=7#page=2", "/a/b?rcdx=" + "ab12" * 6)


def links(spark, sf_dir):
    """Page URLs with a tail that varies by id."""
    p = table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", r"[?#].*$", "")
    return p.select("page_id", F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.concat(base, C.pick(URL_TAILS, F.col("page_id") % 6))).alias("url"))


_LINKS = f"links AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN url ELSE regexp_replace(url, '[?#].*$', '') || {C.sql_pick(URL_TAILS, 'page_id % 6')} END AS url FROM pages)"
_U = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(n: int) -> str:
    return f"regexp_extract(url, '{_U}', {n})"


_PARTS = f"""parts AS (SELECT *, lower({_part(1)}) AS protocol, lower(regexp_replace(regexp_replace({_part(2)}, '^.*@', ''), ':[0-9]*$', '')) AS host,
  CASE WHEN {_part(3)} = '' THEN '/' ELSE {_part(3)} END AS path, regexp_replace({_part(4)}, '^[?]', '') AS query, regexp_replace({_part(5)}, '^#', '') AS fragment FROM links)"""


@query("url_parts", f"""WITH {_LINKS}, {_PARTS} SELECT page_id, protocol, host, path, query, fragment, protocol = 'https' AND host <> '' AS https,
  protocol || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM parts""")
def url_parts(spark, sf_dir):
    u = links(spark, sf_dir)
    return u.select("page_id", U.protocol("url").alias("protocol"), U.host("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"),
                    U.fragment("url").alias("fragment"), U.is_https("url").alias("https"), U.canonical("url").alias("canonical"))


@query("url_checks", f"""WITH {_LINKS}, {_PARTS}, keyed AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: regexp_replace(p, '=.*$', '')) AS keys FROM parts)
SELECT page_id, len(list_filter(keys, lambda k: regexp_matches(k, '{U.CREDENTIAL_KEY}'))) > 0 AS credential,
  CASE WHEN regexp_matches(lower(path), '/view[.]aspx$') THEN regexp_matches(regexp_extract(query, '(?:^|&)idx=([^&]*)', 1), '^[0-9]+$') WHEN regexp_matches(lower(path), '/b$') THEN regexp_matches(regexp_extract(query, '(?:^|&)rcdx=([^&]*)', 1), '^[A-Fa-f0-9]{{24,}}$') ELSE false END AS valid_id,
  len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 1 OR len(keys) > 0 OR fragment <> '' AS detailed,
  regexp_matches(path || '?' || query, '{U.ATTACHMENT}') AS attachment, host LIKE '%example.com' AND starts_with(path, '/en/') AND host = 'm.example.com' AS in_scope,
  CASE WHEN regexp_matches(lower(path), '/view[.]aspx$') THEN 'board-a' WHEN regexp_matches(lower(path), '[.]pdf$') THEN 'board-b' END AS board FROM keyed""")
def url_checks(spark, sf_dir):
    u = links(spark, sf_dir)
    return u.select(
        "page_id", U.has_credential_key("url").alias("credential"),
        U.has_valid_id("url", [(r"/view[.]aspx$", ["idx"], r"^\d+$"), (r"/b$", ["rcdx"], r"^[A-Fa-f0-9]{24,}$")]).alias("valid_id"),
        U.is_detailed("url").alias("detailed"), U.is_attachment("url").alias("attachment"), U.in_scope("url", F.lit("https://m.example.com/en/")).alias("in_scope"),
        U.board_of("url", [(r"/view[.]aspx$", "board-a"), (r"[.]pdf$", "board-b")]).alias("board"),
    )


BAD_LINKS = ("javascript:alert(1)", "//cdn.example.com/x", "a\\b", "ftp://x.example.com/", "https://user:pw@example.com/", "http://ok.example.com/", "relative/path", "data:text/html,x")


@query("url_safety", f"""WITH l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {C.sql_pick(BAD_LINKS, f'page_id % {len(BAD_LINKS)}')} END AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '{U.SCHEME}', 1) AS scheme FROM l)
SELECT page_id, CASE WHEN scheme <> '' THEN lower(scheme) NOT IN ('http', 'https') OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') ELSE starts_with(url, '//') OR contains(url, chr(92)) END AS unsafe FROM p""")
def url_safety(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(C.pick(BAD_LINKS, F.col("page_id") % len(BAD_LINKS)))
    return p.select("page_id", U.is_unsafe_markdown_url(url).alias("unsafe"))


@query("candidate_keys", f"""WITH {_LINKS} SELECT page_id, CASE WHEN regexp_extract(url, '(?i)(?:idx|seq|no|id)=?([0-9]{{1,10}})', 1) <> '' THEN regexp_extract(url, '(?i)(?:idx|seq|no|id)=?([0-9]{{1,10}})', 1)
  WHEN regexp_extract(url, '(?:^|[^0-9])([0-9]{{1,10}})(?:[^0-9]|$)', 1) <> '' THEN regexp_extract(url, '(?:^|[^0-9])([0-9]{{1,10}})(?:[^0-9]|$)', 1) ELSE substr(sha256(url || chr(31) || url), 1, 16) END AS key FROM links""")
def candidate_keys(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.candidate_key("url", "url").alias("key"))


@query("source_labels", f"""WITH {_LINKS}, {_PARTS} SELECT page_id, CASE WHEN host = 'spam-farm.example.org' THEN 'Farm' WHEN contains('page' || CAST(page_id % 10 AS VARCHAR), 'page3') THEN 'Third' ELSE '확인된 출처' END AS label FROM parts""")
def source_labels(spark, sf_dir):
    u = links(spark, sf_dir).withColumn("source_id", F.concat(F.lit("page"), F.col("page_id") % 10))
    return u.select("page_id", U.source_label("source_id", "url", [("none-such", "spam-farm.example.org", "Farm"), ("page3", "no.example.org", "Third")]).alias("label"))
