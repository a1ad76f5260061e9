"""Column functions over dates, ages and deadline texts.

"Now" is always an argument; nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftbase.functions.text import col, collapse

# --- fixed values -----------------------------------------------------------
DAY = r"(?:3[01]|[12]\d|0?[1-9])"
MONTH = r"(?:0?[1-9]|1[0-2])"
OPEN_ENDED = r"채용\s*시\s*까지|채용시까지|상시(?:채용|모집)?"
D_DAY = r"(?i)D\s*([+-])\s*(\d+)"
PROSE_D_DAY = r"(?i)(?<![A-Za-z])D\s*([+-])\s*(\d+)"  # in whole pages: the d that ends a word before a phone number is none
SHORT_DATE = (
    r"(?<!\d)(?:~|마감(?:일)?\s*[:：]?\s*|접수\s*(?:기한|마감)\s*[:：]?\s*)(0?[1-9]|1[0-2])[.\-/월]\s*" + DAY + r"(?:일)?"
)
CLOSED = r"(?<!일)(?:접수\s*)?마감(?:됨|완료)?(?!\s*(?:일|기한|기간))"
LABELLED_DATE = (
    r"(?:(?:~\s*|마감(?:일)?\s*[:：]?\s*|접수\s*(?:기한|마감)\s*[:：]?\s*|일시\s*[:：]?\s*)20\d{2}[.\-/년]\s*"
    + MONTH + r"[.\-/월]\s*" + DAY + r"(?:일)?|20\d{2}[.\-/년]\s*" + MONTH + r"[.\-/월]\s*" + DAY + r"(?:일)?\s*마감)"
)
VAGUE_MONTH_DAY = (
    r"(?<![\d.-])" + MONTH + r"[.\-/월]\s*" + DAY + r"(?:일)?(?:\s*[~–-]\s*" + MONTH + r"?[.\-/월]?\s*" + DAY + r"(?:일)?)?"
)
FULL_DATE = r"(20\d{2})[.\-/년]\s*(\d{1,2})[.\-/월]\s*(\d{1,2})"
MONTH_DAY = r"(?:0?[1-9]|1[0-2])[.\-/월]\s*(3[01]|[12]\d|0?[1-9])"
LOOSE_FULL_DATE = r"(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})"
CLOSED_WORDS = r"(?i)모집\s*없음|마감|종료|closed|expired"
OPEN_WORDS = r"모집기간연장|모집중|신청\s*가능|~\s*\d{1,2}/\d{1,2}|채용시까지"
FRESHNESS_ACTIVE, FRESHNESS_MONTH, FRESHNESS_HALF_YEAR = 0.35, 0.2, 0.1
UNKNOWN_RECENCY = 0.35
# ----------------------------------------------------------------------------


def ref_date(ref_ts: Column) -> Column:
    return F.date_format(ref_ts, "yyyy-MM-dd")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _date_parts(c: Column, pattern: str) -> Column:
    return F.when(
        c.rlike(pattern),
        _iso(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3)),
    )


def classify_deadline(text: Column | str, ref_ts: Column, d_day_pattern: str = D_DAY) -> Column:
    """O-63: six ordered rules; a struct of status, raw text and date."""
    t = collapse(text)
    today = ref_date(ref_ts)

    def result(status: Column, raw: Column, date: Column | None = None) -> Column:
        return F.struct(
            status.alias("status"),
            raw.alias("deadline_raw_text"),
            (date if date is not None else F.lit(None).cast("string")).alias("deadline_date"),
        )

    def by_date(date: Column) -> Column:
        return F.when(date >= today, "active").otherwise("expired")

    open_ended = F.regexp_extract(t, OPEN_ENDED, 0)
    d_day = F.regexp_extract(t, d_day_pattern, 0)
    d_sign, d_count = F.regexp_extract(t, d_day_pattern, 1), F.regexp_extract(t, d_day_pattern, 2).cast("decimal(38,0)")
    short = F.regexp_extract(t, SHORT_DATE, 0)
    short_date = _iso(F.substring(today, 1, 4), F.regexp_extract(t, SHORT_DATE, 1), F.regexp_extract(short, MONTH_DAY, 1))
    full = F.regexp_extract(t, LABELLED_DATE, 0)
    full_date = _date_parts(full, FULL_DATE)
    closed = F.regexp_extract(t, CLOSED, 0)
    vague = F.regexp_extract(t, VAGUE_MONTH_DAY, 0)
    return (
        F.when(open_ended != "", result(F.lit("active"), open_ended))
        .when(d_day != "", result(F.when((d_sign == "-") & (d_count > 0), "active").otherwise("expired"), F.regexp_replace(d_day, r"\s+", "")))
        .when(short != "", result(by_date(short_date), short, short_date))
        .when(full != "", result(by_date(full_date), full, full_date))
        .when(closed != "", result(F.lit("expired"), F.trim(closed)))
        .when(vague != "", result(F.lit("unknown"), vague))
        .otherwise(result(F.lit("unknown"), F.lit(None).cast("string")))
    )


def _status_only(text: Column, ref_ts: Column) -> Column:
    """The status part of ``classify_deadline``."""
    t = collapse(text)
    today = ref_date(ref_ts)
    short_date = _iso(
        F.substring(today, 1, 4), F.regexp_extract(t, SHORT_DATE, 1), F.regexp_extract(F.regexp_extract(t, SHORT_DATE, 0), MONTH_DAY, 1)
    )
    open_d_day = (F.regexp_extract(t, D_DAY, 1) == "-") & (F.regexp_extract(t, D_DAY, 2).cast("decimal(38,0)") > 0)
    full_date = _date_parts(F.regexp_extract(t, LABELLED_DATE, 0), FULL_DATE)
    return (
        F.when(t.rlike(OPEN_ENDED), "active")
        .when(t.rlike(D_DAY), F.when(open_d_day, "active").otherwise("expired"))
        .when(t.rlike(SHORT_DATE), F.when(short_date >= today, "active").otherwise("expired"))
        .when(t.rlike(LABELLED_DATE), F.when(full_date >= today, "active").otherwise("expired"))
        .when(t.rlike(CLOSED), "expired")
        .otherwise("unknown")
    )


def effective_status(raw_text: Column | str, stored: Column | str, ref_ts: Column) -> Column:
    """O-64: the status at ``ref_ts``; the stored one when the text does not tell."""
    raw_text, stored = col(raw_text), col(stored)
    status = _status_only(raw_text, ref_ts)
    return F.when(F.coalesce(raw_text, F.lit("")) == "", stored).when(status == "unknown", stored).otherwise(status)


def classify_deadline_last_date(raw: Column | str, ref_ts: Column, offset_hours: int = 9) -> Column:
    """O-65a: last full date, else the short date; open until 23:59:59 at the given offset."""
    raw = col(raw)
    full_all = F.regexp_extract_all(raw, F.lit(LOOSE_FULL_DATE), F.lit(0))
    last = F.when(F.size(full_all) > 0, F.element_at(full_all, -1))
    short = r"(\d{1,2})[.\-/](\d{1,2})"
    short_date = F.when(
        raw.rlike(short),
        _iso(F.substring(ref_date(ref_ts), 1, 4), F.regexp_extract(raw, short, 1), F.regexp_extract(raw, short, 2)),
    )
    date = F.coalesce(_date_parts(last, LOOSE_FULL_DATE), short_date)
    end = F.try_to_timestamp(F.concat(date, F.lit(" 23:59:59"))) - F.expr(f"INTERVAL {offset_hours} HOURS")
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "unknown")
        .when(raw.rlike("채용시까지|상시채용"), "active")
        .when(date.isNull(), "unknown")
        .when(end < ref_ts, "expired")
        .otherwise("active")
    )


def classify_deadline_keywords(text: Column | str) -> Column:
    """O-65b: closed words win over open words."""
    text = col(text)
    return F.when(text.rlike(CLOSED_WORDS), "expired").when(text.rlike(OPEN_WORDS), "active").otherwise("unknown")


def posted_date(text: Column | str) -> Column:
    """O-65c: first ``yyyy.m.d``-like date as an ISO text at midnight UTC, else null."""
    d = _date_parts(col(text), FULL_DATE)
    return F.when(d.isNotNull(), F.concat(d, F.lit("T00:00:00.000Z")))


def age_days(ts: Column, ref_ts: Column) -> Column:
    micros = F.unix_micros(ref_ts) - F.unix_micros(ts)
    return F.greatest(F.lit(0.0), micros.cast("double") / F.lit(86_400_000_000.0))


def freshness_boost(status: Column, posted_at: Column, fetched_at: Column, ref_ts: Column) -> Column:
    """O-65d."""
    age = age_days(F.coalesce(posted_at, fetched_at), ref_ts)
    return (
        F.when(status == "active", FRESHNESS_ACTIVE)
        .when(age <= 30, FRESHNESS_MONTH)
        .when(age <= 180, FRESHNESS_HALF_YEAR)
        .otherwise(0.0)
    )


def recency(ts: Column, ref_ts: Column, horizon_days: float) -> Column:
    """O-65e: linear decay to 0 over the horizon; unknown age has a fixed value."""
    decayed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - age_days(ts, ref_ts) / F.lit(float(horizon_days))))
    return F.when(ts.isNull(), UNKNOWN_RECENCY).otherwise(decayed)


def hit_count(c: Column | str) -> Column:
    """O-65f: digits only, else null."""
    c = collapse(c)
    return F.when(c.rlike(r"^\d+$"), c.cast("bigint"))


def relabel_status(c: Column | str) -> Column:
    """O-65g: stored names to display names."""
    c = F.lower(F.coalesce(col(c), F.lit("unknown")))
    return (
        F.when(c.isin("active", "open"), "open")
        .when(c.isin("closing_soon", "closing-soon"), "closing_soon")
        .when(c.isin("expired", "closed"), "closed")
        .otherwise("unknown")
    )
