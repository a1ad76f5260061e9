"""Safety of questions, sources and answers as columns over whole tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siftbase.functions import text as T, urls as U
from siftbase.functions.text import NEGATION_AFTER, NEGATION_BEFORE, NEGATION_MARKERS
from siftbase.session import computed_once

# --- fixed values -----------------------------------------------------------
INPUT_POLICY_VERSION = "2026-05-17"
ASK = "(?:해줘|해 주세요|해줘요|해줄래|해 줄래|해줄 수 있어)"
INPUT_RULES = (
    ("bypass", ("prompt_injection", "citation_bypass"), (r"이전\s*지시(?:를)?\s*무시", r"출처\s*(?:를\s*)?(?:생략|없이)", r"인용\s*없이", r"아무\s*출처(?:나)?\s*붙이")),
    ("private", ("private_access_request", "privacy_sensitive"), ("sso", "비공개", "private", r"다른\s*학생", r"타\s*학생", r"상담\s*기록")),
    (
        "automation", ("unsupported_automation",),
        (r"(?:신청|지원서|신청서|접수|제출|보내|전송|예약)\s*" + ASK, r"예약\s*대행", r"이메일\s*보내", r"메일\s*보내", r"(?:보내|전송|연락)\s*줘"),
    ),
    (
        "rewrite", ("out_of_scope",),
        (
            r"(?:이력서|자기소개서|자소서|cover\s*letter|커버레터).*(?:전부|전체|통째로|새로|다시).*(?:작성|써|만들)\s*줘",
            r"(?:이력서|자기소개서|자소서|cover\s*letter|커버레터).*(?:작성|써|만들)\s*해줘",
            r"면접.*(?:답변|대답|응답).*(?:작성해|작성|만들어|만들|지어|써)\s*줘",
            r"면접\s*예상\s*답변.*(?:작성해|작성|만들어|만들|지어|써)\s*줘",
        ),
    ),
    ("endorsement", ("official_endorsement_request",), (r"공식\s*인증\s*서비스.*(?:말해|써|작성해|붙여)\s*줘", r"공식\s*인증\s*서비스.*(?:이라고\s*)?(?:말해|써)\s*줘")),
    (
        "guarantee", ("guaranteed_outcome_request",),
        (r"취업\s*보장.*(?:이라고\s*)?(?:말해|써|작성해|붙여)\s*줘", r"(?:말해|써|작성해|붙여)\s*줘.*취업\s*보장"),
    ),
    (
        "personal_action", ("privacy_sensitive", "unsupported_automation"),
        (
            r"(?:전화번호|휴대폰|연락처|이메일|메일|학번).*(?:예약|신청|접수|제출|보내|전송|연락)\s*" + ASK,
            r"(?:전화번호|휴대폰|연락처|이메일|메일|학번).*예약\s*해줘",
        ),
    ),
)
GUARANTEE_PHRASE = "취업 보장"
REFUSED = ("prompt_injection", "private_access_request", "unsupported_automation", "official_endorsement_request", "guaranteed_outcome_request", "out_of_scope")

# category, pattern, may be negated
OUTPUT_RULES = (
    ("prompt_injection", r"이전\s*지시(?:를)?\s*무시", False),
    ("guaranteed_outcome_claim", r"취업(?:을|이)?\s*보장", True),
    ("guaranteed_outcome_claim", r"합격(?:을|이)?\s*보장", True),
    ("guaranteed_outcome_claim", r"채용(?:을|이)?\s*보장", True),
    ("guaranteed_outcome_claim", r"합격(?:을|이)?\s*확정", True),
    ("guaranteed_outcome_claim", r"100\s*%\s*채용", True),
    ("guaranteed_outcome_claim", r"내정(?:을|이)?\s*보장", True),
    ("guaranteed_outcome_claim", r"프리\s*패스", True),
    ("official_endorsement_claim", r"공식\s*인증", True),
    ("official_endorsement_claim", r"공식\s*승인", True),
    ("official_endorsement_claim", r"학교(?:가|는)?\s*보증", True),
    ("official_endorsement_claim", r"공인\s*서비스", True),
    ("private_access_request", r"sso\s*로\s*확인", True),
    ("private_access_request", r"비공개\s*공고", True),
    ("citation_bypass", r"출처(?:를)?\s*생략", True),
    ("citation_bypass", r"근거\s*없이", False),
    ("citation_bypass", r"출처\s*없이", False),
    ("citation_bypass", r"인용\s*없이", False),
)
OUTPUT_DETAILS = {
    "prompt_injection": "prompt injection claim",
    "guaranteed_outcome_claim": "unsafe outcome claim",
    "official_endorsement_claim": "official or private access claim",
    "private_access_request": "official or private access claim",
    "citation_bypass": "citation bypass claim",
}

# pattern, ignore case, category, placeholder, skip when negated
SOURCE_RULES = (
    (r"</?\s*(?:system|developer|assistant|user|retrieved_context|chunk)\b[^>]*>", True, "source_injection", "[redacted_prompt_tag]", False),
    (
        r"(?:ignore|disregard|override)\s+(?:all\s+)?(?:previous|prior|system|developer)\s+(?:instructions?|rules?)",
        True, "source_injection", "[redacted_source_instruction]", False,
    ),
    (r"이전\s*(?:지시|명령|규칙)(?:을|를)?\s*무시(?:하고|하(?:세요|라|십시오)?|해)?", False, "source_injection", "[redacted_source_instruction]", False),
    (r"(?:시스템|개발자)\s*(?:지시|명령|규칙)(?:을|를)?\s*무시[^\s.,;!?。]*", False, "source_injection", "[redacted_source_instruction]", False),
    (r"(?:너는|당신은)\s*이제\s*(?:시스템|개발자|관리자)[^\n.。]*", False, "source_injection", "[redacted_source_instruction]", False),
    (r"(?:출처|인용)(?:를|을)?\s*(?:생략|숨기|제거|무시)[^\s.,;!?。]*", False, "citation_bypass", "[redacted_citation_bypass]", False),
    (
        r"(?:citations?|sources?)\s*(?:을|를)?\s*(?:생략|숨기|제거|무시|omit|hide|remove|ignore|skip)[^\s.,;!?。]*|(?:do\s+not|don't)\s+cite|without\s+citations?",
        True, "citation_bypass", "[redacted_citation_bypass]", False,
    ),
    (r"(?:{institutions})[^\n.。]{{0,24}}(?:공식\s*)?(?:인증|보증|승인|제휴)(?:된|받은)?", False, "official_endorsement_claim", "[redacted_official_endorsement_claim]", True),
    (r"(?:officially\s+)?(?:endorsed|approved|certified|guaranteed)\s+by\s+(?:{institutions})", True, "official_endorsement_claim", "[redacted_official_endorsement_claim]", True),
    (r"(?:취업|합격|채용|인턴십)[^\n.。]{0,12}(?:보장|확정)", False, "guaranteed_outcome_claim", "[redacted_guaranteed_outcome_claim]", True),
    (
        r"(?:100|백)\s*%\s*(?:취업|합격|채용)|\bguaranteed\s+(?:employment|job|offer|hire|internship|acceptance)\b",
        True, "guaranteed_outcome_claim", "[redacted_guaranteed_outcome_claim]", True,
    ),
)
DEFAULT_INSTITUTIONS = ("학교", "대학")
# every match of a source rule holds one of these (in lower case) or an institution's name
SOURCE_TRIGGERS = (
    "<", "ignore", "disregard", "override", "지시", "명령", "규칙", "이제", "출처", "인용", "citation", "source", "cite", " by", "취업", "합격", "채용", "인턴십", "guaranteed",
)
MARKDOWN_LINK = r"\[([^\]\n]{0,120})\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
# ----------------------------------------------------------------------------


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def input_safety(df: DataFrame, query: str, use_nfkc: bool = True) -> DataFrame:
    """O-116: adds action (allow, redact, refuse), categories in rule order, sanitized_query, redacted_query."""
    staged = computed_once(df, {"sanitized_query": T.normalize_safety_text(query, use_nfkc), "_pii": T.has_personal_data(query)}, df.columns)
    s = F.col("sanitized_query")
    found: list[Column] = []
    for name, categories, patterns in INPUT_RULES:
        hit = _any([s.rlike(p) for p in patterns])
        if name == "guarantee":
            hit = hit & ~T.negated_near(s, F.lit(GUARANTEE_PHRASE))
        found.append(F.when(hit, F.array(*[F.lit(c) for c in categories])))
    found.append(F.when(F.col("_pii"), F.array(F.lit("pii_echo"), F.lit("privacy_sensitive"))))
    categories = F.array_distinct(F.flatten(F.array_compact(F.array(*found))))
    out = computed_once(staged, {"input_categories": categories}, [*staged.columns])
    refuse = F.arrays_overlap("input_categories", F.array(*[F.lit(c) for c in REFUSED]))
    return out.select(
        *df.columns, "sanitized_query", T.redact_personal_data(query).alias("redacted_query"), "input_categories",
        F.when(refuse, "refuse").when(F.col("_pii"), "redact").otherwise("allow").alias("input_action"),
    )


def output_safety(df: DataFrame, answer: str, use_nfkc: bool = True, institutions: Sequence[str] = ()) -> DataFrame:
    """O-120, O-96: adds violations (category, detail, match), output_categories, output_action, visible_markers.

    ``institutions``: names of the publishing site whose claimed partnership is a violation.
    """
    a = F.col(answer)
    rules = list(OUTPUT_RULES)
    if institutions:
        names = "|".join(re.escape(n) for n in institutions)
        rules.insert(10, ("official_endorsement_claim", rf"(?:{names})(?:와|과)?\s*제휴", True))
    staged = computed_once(
        df,
        {
            "_norm": T.normalize_safety_text(a, use_nfkc),
            "visible_markers": T.visible_markers(a),
            "_raw_markers": F.size(T.citation_markers(a)),
            "_pii": T.redact_personal_data(a) != a,
        },
        df.columns,
    )
    norm = F.col("_norm")

    def violation(category: str, detail: str, match: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(detail).alias("detail"), match.alias("match"))

    def phrase(category: str, pattern: str, negatable: bool) -> Column:
        matches = F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))
        kept = F.filter(matches, lambda m: ~T.negated_near(norm, m)) if negatable else matches
        return F.transform(kept, lambda m: violation(category, OUTPUT_DETAILS[category], m))

    def shown(pattern: str, detail: str) -> Column:
        return F.transform(F.regexp_extract_all(a, F.lit(pattern), F.lit(0)), lambda m: violation("unsafe_markdown_link", detail, m))

    none = F.array().cast("array<struct<category:string,detail:string,match:string>>")
    parts = [phrase(*rule) for rule in rules]
    parts.append(F.when(F.col("_pii"), F.array(violation("pii_echo", "personal data echoed in output", F.lit("pii")))).otherwise(none))
    hidden = F.col("_raw_markers") > F.size("visible_markers")
    parts.append(F.when(hidden, F.array(violation("citation_bypass", "hidden or non-visible citation marker", F.lit("hidden citation")))).otherwise(none))
    for pattern, detail in (
        (T.MARKDOWN_IMAGE, "markdown image"), (T.MARKDOWN_LINK, "markdown link"), (T.AUTOLINK, "markdown autolink"), (T.RAW_URL, "raw url"), (T.RAW_TAG, "raw html"),
    ):
        parts.append(shown(pattern, detail))
    out = computed_once(staged, {"violations": F.concat(*parts)}, [*df.columns, "visible_markers"])
    return out.withColumn("output_categories", F.array_distinct("violations.category")).withColumn(
        "output_action", F.when(F.size("violations") == 0, "allow").otherwise("refuse")
    )


def _negated(text: str, phrase: str) -> bool:
    def norm(v: str) -> str:
        v = re.sub("[\u200b-\u200d\u2060\ufeff]", "", unicodedata.normalize("NFKC", v)).lower()
        return " ".join(v.split())

    plain, wanted = re.sub(r"\[\d+\]", "", norm(text)), norm(phrase)
    at = plain.find(wanted)
    if at < 0:
        return False
    window = plain[max(0, at - NEGATION_BEFORE) : at + len(wanted) + NEGATION_AFTER]
    return any(marker in window for marker in NEGATION_MARKERS)


def rule_pattern(pattern: str, institutions: Sequence[str], form: str) -> str:
    r"""A source rule in Python's, Java's or SQL's (RE2) pattern language.

    Its blanks are those of web scripts, wide ones included, and its word edges
    are ASCII, so that particles may follow a word; the three forms match the same.
    """
    names = "|".join(re.escape(n) for n in institutions)
    if "{institutions}" in pattern:
        pattern = pattern.replace("{institutions}", names).replace("{{", "{").replace("}}", "}")
    wide = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", T.WIDE_SPACE) if form == "python" else T.WIDE_SPACE
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == "[":
            inside = True
        elif token == "]":
            inside = False
        if token == r"\s":
            token = rf"\s{wide}" if inside else rf"[\s{wide}]"
        elif token == r"\b" and form == "java":
            token = edge
        out.append(token)
    return "".join(out)


def source_redactor(institutions: Sequence[str] = DEFAULT_INSTITUTIONS):
    """Arrow-batched UDF: text after the JVM steps to a struct of redacted text and rule categories.

    Whether a match is negated depends on the text as it stood before its own
    rule, so the rules have to be applied one after the other.
    """
    rules = [(re.compile(rule_pattern(p, institutions, "python"), (re.IGNORECASE if fold else 0) | re.ASCII), c, mark, skip) for p, fold, c, mark, skip in SOURCE_RULES]

    def redact(text: str) -> tuple[str, list[str]]:
        categories: list[str] = []
        for pattern, category, mark, skip in rules:
            before = text

            def put(match: re.Match, before=before, category=category, mark=mark, skip=skip) -> str:
                if skip and _negated(before, match.group(0)):
                    return match.group(0)
                categories.append(category)
                return mark

            text = pattern.sub(put, before)
        return text, list(dict.fromkeys(categories))

    @F.pandas_udf("text string, categories array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else redact(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "categories"])

    return run


def _rule_guard(institutions: Sequence[str]) -> str:
    """One pattern that finds any text a source rule could touch."""
    filled = [(rule_pattern(p, institutions, "java"), fold) for p, fold, *_ in SOURCE_RULES]
    return "|".join(f"(?i:{p})" if fold else f"(?:{p})" for p, fold in filled)


def _replace_unsafe_links(c: Column) -> Column:
    """Markdown links to unsafe targets become a placeholder; numeric markers of the label stay."""
    links = F.array_distinct(F.regexp_extract_all(c, F.lit(MARKDOWN_LINK), F.lit(0)))

    def swap(text: Column, link: Column) -> Column:
        label, url = F.regexp_extract(link, MARKDOWN_LINK, 1), F.regexp_extract(link, MARKDOWN_LINK, 2)
        markers = F.array_join(F.regexp_extract_all(label, F.lit(r"\[\d+\]"), F.lit(0)), " ")
        placeholder = F.when(markers != "", F.concat(markers, F.lit(" [redacted_unsafe_link]"))).otherwise("[redacted_unsafe_link]")
        return F.when(U.is_unsafe_markdown_url(url), F.replace(text, link, placeholder)).otherwise(text)

    return F.aggregate(links, c, swap)


def sanitize_sources(df: DataFrame, title: str = "title", text: str = "text", anchors: str = "citation_anchors",
                     institutions: Sequence[str] = DEFAULT_INSTITUTIONS) -> DataFrame:
    """O-117, O-97: safe title and text, action (allow, redact, quarantine), categories, redacted_fields, quarantine_reason."""
    redact = source_redactor(institutions)
    guard = _rule_guard(institutions)
    triggers = [*SOURCE_TRIGGERS, *[n.lower() for n in institutions]]

    def touched(c: Column) -> Column:
        """Plain substring tests first; the patterns run on the few texts that pass."""
        lowered = F.lower(c)
        return _any([F.contains(lowered, F.lit(t)) for t in triggers]) & c.rlike(guard)

    staged = computed_once(df, {f"_l_{f}": _replace_unsafe_links(F.col(c)) for f, c in (("title", title), ("text", text))}, df.columns)
    staged = computed_once(staged, {f"_p_{f}": T.redact_personal_data(f"_l_{f}") for f in ("title", "text")}, staged.columns)
    for f, c in (("title", title), ("text", text)):
        # only texts that some rule can match travel to Python
        staged = staged.withColumn(f"_r_{f}", redact(F.when(touched(F.col(f"_p_{f}")), F.col(f"_p_{f}"))))
    out = staged
    for f, c in (("title", title), ("text", text)):
        categories = F.array_distinct(
            F.concat(
                F.when(F.col(f"_l_{f}") != F.col(c), F.array(F.lit("unsafe_markdown_link"))).otherwise(F.array().cast("array<string>")),
                F.when(F.col(f"_p_{f}") != F.col(f"_l_{f}"), F.array(F.lit("pii_echo"))).otherwise(F.array().cast("array<string>")),
                F.coalesce(F.col(f"_r_{f}.categories"), F.array().cast("array<string>")),
            )
        )
        out = computed_once(out, {f"_c_{f}": categories}, out.columns)
        final = F.coalesce(F.col(f"_r_{f}.text"), F.col(f"_p_{f}"))
        out = out.withColumn(f"safe_{f}", F.when(F.size(f"_c_{f}") > 0, T.compact_whitespace(final)).otherwise(F.col(c)))
    reason = quarantine_reason(F.col(anchors), F.col("safe_title"), F.col("safe_text"))
    fields = F.array_compact(F.array(F.when(F.size("_c_title") > 0, "title"), F.when(F.size("_c_text") > 0, "text")))
    return out.select(
        *df.columns, "safe_title", "safe_text",
        F.array_distinct(F.concat("_c_title", "_c_text")).alias("source_categories"),
        fields.alias("redacted_fields"),
        reason.alias("quarantine_reason"),
        F.when(reason.isNotNull(), "quarantine").when(F.size(fields) > 0, "redact").otherwise("allow").alias("source_action"),
    )


def non_informative(c: Column) -> Column:
    """Fewer than four letters or digits are left once the placeholders are gone."""
    left = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?i)\[redacted_[a-z_]+\]", " ")), r"[^\p{L}\p{N}]+", "")
    return F.length(left) < 4


def anchors_state(anchors: Column) -> Column:
    def ok(a: Column) -> Column:
        page = a["page_number"]
        return (
            (T.trim_all(a["label"]) != "") & (page.isNull() | (page > 0)) & U.is_https(a["url"]) & (U.user_info(a["url"]) == "")
            & (~F.contains(a["url"], F.lit("#page=")) | page.isNotNull())
        )

    return F.when(F.coalesce(F.size(anchors), F.lit(0)) == 0, "empty").when(F.forall(anchors, lambda a: F.coalesce(ok(a), F.lit(False))), "valid").otherwise("invalid")


def quarantine_reason(anchors: Column, safe_title: Column, safe_text: Column) -> Column:
    state = anchors_state(anchors)
    return (
        F.when(state == "empty", "empty_citation_anchors")
        .when(state == "invalid", "invalid_citation_anchors")
        .when(non_informative(safe_title) | non_informative(safe_text), "non_informative_sanitized_evidence")
    )


def worst_action(decisions: DataFrame, keys: Sequence[str], action: str = "source_action") -> DataFrame:
    """O-97: the worst action per group."""
    order = F.when(F.col(action) == "quarantine", 2).when(F.col(action) == "redact", 1).otherwise(0)
    return decisions.groupBy(*keys).agg(F.max(order).alias("_w")).select(
        *keys, F.when(F.col("_w") == 2, "quarantine").when(F.col("_w") == 1, "redact").otherwise("allow").alias("action")
    )


def leaks(df: DataFrame, secret_values: Sequence[str] = ()) -> DataFrame:
    """O-142: rows of a published result that still show personal data or a long secret; must be empty."""
    published = F.to_json(F.struct(*df.columns))
    patterns = [T.EMAIL, T.PHONE, T.STUDENT_ID, T.BEARER_HEADER, *[re.escape(s) for s in secret_values]]
    return df.filter(_any([published.rlike(p) for p in patterns]))
