"""Posts, PDF page texts and attachments to normalised records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftbase.functions import dates as D, text as T, urls as U
from siftbase.operators import html as H
from siftbase.schemas import TRUST_LABEL
from siftbase.session import broadcast_if_small

# --- fixed values -----------------------------------------------------------
BODY_LABELS = ("행사구분", "제목", "기간", "기업명", "주관 캠퍼스", "장소", "비고", "게시범위(학과)", "참가대상", "내용", "첨부파일")
GENERIC_EVENT_TITLES = ("채용설명회", "채용박람회", "채용상담회")
EVENT_BOARD = "채용상담 및 설명회"
MIN_BODY = 20
LOGIN_OR_ERROR = (
    r"(?i)log\s*in\s*(?:required|again|failed)|세션이\s*만료|권한이\s*없|접근\s*권한|오류입니다.*불편을\s*드려\s*죄송합니다|오류번호"
    r"|포털시스템\s*로그인|아이디/비밀번호를\s*잃어버리셨나요|기업회원가입"
)
LIST_WORDS = ("달력보기", "목록보기", "상세검색", "검색", "전체", "관심 채용행사", "자세히 보기", "대상학년", "행사구분")
MAX_ATTACHMENTS = 5
# ----------------------------------------------------------------------------


def iso(ts: Column | str) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def with_ids(df: DataFrame, hashed: Sequence[str] = ("raw_text", "canonical_url")) -> DataFrame:
    """content_hash and record_id (O-30)."""
    out = df.withColumn("content_hash", T.sha_id(*hashed))
    return out.withColumn("record_id", T.sha_id("source_id", "canonical_url", "title", iso("posted_at"), "content_hash"))


def export_posts(exports: DataFrame) -> DataFrame:
    """O-12: ``{exported_at, posts[]}`` documents to one row per post."""
    return exports.select("exported_at", F.inline("posts"))


def post_records(posts: DataFrame, boards: DataFrame) -> DataFrame:
    """O-19, O-34, O-35: posts to records; ``boards`` maps a board to its source and taxonomy."""
    p = posts.withColumn("canonical_url", U.canonical("detail_url"))
    title = F.when(
        F.col("board") == EVENT_BOARD, T.promote_title("title", "body_text", GENERIC_EVENT_TITLES, "제목", BODY_LABELS)
    ).otherwise(F.col("title"))
    p = p.withColumn("title", title).join(broadcast_if_small(boards), "board")
    given = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    raw = F.concat_ws(
        "\n", F.concat(F.lit("게시판: "), "board"), F.concat(F.lit("제목: "), "title"), given("등록일: ", "posted_at"), given("마감 정보: ", "deadline_raw_text"),
        F.lit("본문:"), "body_text", F.concat(F.lit("공식 상세 URL: "), "canonical_url"),
    )
    p = p.withColumn("raw_text", raw).withColumn("posted_at", F.try_to_timestamp("posted_at"))
    p = with_ids(p)
    anchor = F.struct(F.col("canonical_url").alias("url"), F.concat(F.lit("원문: "), "title").alias("label"), F.lit(None).cast("int").alias("page_number"))
    return p.select(
        "record_id", "source_id", "source_name", F.col("canonical_url").alias("source_url"), "canonical_url", "title", "category", "collection_category",
        "source_family", "category_label_ko", F.col("exported_at").alias("fetched_at"), "posted_at",
        F.coalesce("deadline_status", F.lit("unknown")).alias("deadline_status"), F.coalesce("deadline_raw_text", F.lit("")).alias("deadline_raw_text"),
        "raw_text", F.col("raw_text").alias("cleaned_text"), "content_hash", F.array(anchor).alias("citation_anchors"),
        F.lit(TRUST_LABEL).alias("source_text_trust"),
    )


LIST_TITLE = r"(?:^|\n)목록\n(.+?)\s+Hit\s+\d+"
POSTED = r"20\d{2}[.\-/년]\s*(?:1[0-2]|0?[1-9])[.\-/월]\s*(?:3[01]|[12]\d|0?[1-9])(?:일)?"


def page_records(pages: DataFrame, source: dict[str, str], fetched_at: Column, ref_ts: Column, title_suffix: str = "", anchor_label: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """O-14, O-15: (url, html) to one record per page.

    The title is the first of: heading of the view, heading of the article,
    any second-level heading, the line under a list mark, the document's title
    without ``title_suffix`` (a pattern).  The date of a ``time`` element comes
    before the first date of the page's text.  ``source`` gives source_id,
    source_name, category, collection_category, source_family and
    category_label_ko.  Pages without title or body are kept; ``recordability``
    tells why they are of no use.
    """
    times = F.regexp_extract_all("html", F.lit(r"(?is)<time\s[^>]*datetime=[\"']([^\"']*)[\"']"), F.lit(1))
    scope = F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*)$", 1)
    shown = H.strip_tags(F.when(scope != "", scope).otherwise(F.col("html")), H.NOISE_TAGS)
    dated = F.coalesce(F.get(F.filter(times, lambda t: D.posted_date(t).isNotNull()), F.lit(0)), F.regexp_extract(shown, POSTED, 0))
    staged = pages.select(*keep, "url", "html", T.clean_inline(dated).alias("posted_raw_text"), F.regexp_replace(H.page_title("html"), title_suffix, "").alias("_document"))
    p = H.page_texts(staged, [*keep, "url", "posted_raw_text", "_document"], titles=H.DETAIL_TITLE[:-1])
    given = lambda c: F.when(c != "", c)
    title = F.coalesce(given(T.clean_inline("title")), given(T.clean_inline(F.regexp_extract("body_text", LIST_TITLE, 1))), F.trim("_document"))
    p = p.withColumn("title", title).withColumn("canonical_url", U.canonical("url"))
    posted = F.col("posted_raw_text")
    raw = F.concat_ws("\n", given(F.col("title")), F.when(posted != "", F.concat(F.lit("작성일 "), posted)), given(F.col("body_text")), F.concat(F.lit("공식 상세 URL: "), "canonical_url"))
    p = p.withColumn("raw_text", raw).withColumn("cleaned_text", T.clean_block("raw_text")).withColumn("posted_at", F.try_to_timestamp(D.posted_date(posted)))
    p = with_ids(p.withColumns({k: F.lit(v) for k, v in source.items()}), ("cleaned_text", "canonical_url"))
    p = p.withColumn("_deadline", D.classify_deadline(F.concat_ws("\n", "title", "body_text"), ref_ts, D.PROSE_D_DAY))
    anchor = F.struct(F.col("canonical_url").alias("url"), F.concat(F.lit(anchor_label), "title").alias("label"), F.lit(None).cast("int").alias("page_number"))
    return p.select(
        *keep, "record_id", "source_id", "source_name", F.col("canonical_url").alias("source_url"), "canonical_url", "title", "category", "collection_category", "source_family", "category_label_ko",
        fetched_at.alias("fetched_at"), "posted_at", F.col("_deadline.status").alias("deadline_status"), F.coalesce(F.col("_deadline.deadline_raw_text"), F.lit("")).alias("deadline_raw_text"),
        "raw_text", "cleaned_text", "content_hash", F.array(anchor).alias("citation_anchors"), F.lit(TRUST_LABEL).alias("source_text_trust"),
    )


def pdf_page_records(pages: DataFrame) -> DataFrame:
    """O-17: (source_id, source_name, source_url, page_number, raw_text) to one record per non-empty page."""
    p = pages.withColumn("cleaned_text", T.clean_block("raw_text")).filter("cleaned_text <> ''")
    p = p.withColumn("canonical_url", F.concat("source_url", F.lit("#page="), "page_number")).withColumn(
        "title", F.concat("source_name", F.lit(" "), "page_number", F.lit("쪽"))
    )
    p = with_ids(p.withColumn("posted_at", F.lit(None).cast("timestamp")), ("cleaned_text", "canonical_url"))
    anchor = F.struct(F.col("canonical_url").alias("url"), F.col("title").alias("label"), F.col("page_number").cast("int").alias("page_number"))
    return p.withColumn("citation_anchors", F.array(anchor)).withColumn("source_text_trust", F.lit(TRUST_LABEL))


def surplus_attachments(attachments: DataFrame, limit: int) -> DataFrame:
    """The attachments that ``attachment_records`` leaves out, with a reason."""
    order = Window.partitionBy("parent_id").orderBy("position")
    rest = attachments.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") > limit).drop("_rn")
    return rest.withColumn("reason", F.lit(f"more than {limit} attachments"))


def attachment_records(attachments: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """O-18: the first ``limit`` attachments (parent_id, position, url, label) of each parent inherit its dates and carry two anchors.

    ``surplus_attachments`` gives the others.
    """
    order = Window.partitionBy("parent_id").orderBy("position")
    first = attachments.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")
    p = parents.select(F.col("record_id").alias("parent_id"), F.col("canonical_url").alias("parent_url"), F.col("title").alias("parent_title"), "posted_at", "deadline_status", "deadline_raw_text")
    none = F.lit(None).cast("int").alias("page_number")
    anchors = F.array(F.struct(F.col("url").alias("url"), F.col("label").alias("label"), none), F.struct(F.col("parent_url").alias("url"), F.col("parent_title").alias("label"), none))
    return first.join(p, "parent_id").withColumn("citation_anchors", anchors)


def recordability(title: Column, body: Column) -> Column:
    """O-71: null for a usable page, else the reason for skipping it."""
    return (
        F.when(T.clean_inline(title) == "", "empty title")
        .when(F.length(body) < MIN_BODY, "short body")
        .when(F.concat_ws("\n", title, body).rlike(LOGIN_OR_ERROR), "login or error page")
    )


def list_page(body: Column, row_count: Column, list_path: Column) -> Column:
    """O-72: does the page list posts instead of showing one."""
    text = T.clean_inline(body)
    hits = F.size(T.contains_any(text, LIST_WORDS))
    buttons = F.regexp_count(text, F.lit("자세히 보기"))
    periods = F.regexp_count(text, F.lit(r"기간\s*:"))
    return (list_path & (hits >= 3)) | (hits >= 5) | (buttons >= 3) | (periods >= 5) | ((row_count >= 20) & (hits >= 3))


def ingest_summary(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """O-143: per source: discovered, collected, skipped, and whether the cap was reached; ``reason`` null means collected."""
    out = pages.groupBy("source_id").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("reason").isNull()).alias("collected"), F.count("reason").alias("skipped")
    )
    reached = F.col("collected") >= cap if cap is not None else F.lit(False)
    return out.withColumn("cap_reached", reached)


def skip_reasons(pages: DataFrame) -> DataFrame:
    return pages.filter("reason is not null").groupBy("source_id", "reason").agg(F.count("*").alias("pages"))


def source_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """O-11: add the output group of each record's source; ``write.partitionBy("group")`` then splits without empty groups.

    Records of a source without a group, or with a null one, keep a null group.
    """
    return records.join(broadcast_if_small(groups), "source_id", "left")
