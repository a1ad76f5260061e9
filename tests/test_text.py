from pyspark.sql import functions as F

from siftbase.functions import dates as D, text as T, urls as U


def test_search_terms_are_words_and_hangul_grams(one):
    out = one(lambda c: F.array_sort(T.search_terms(T.normalize_search_text(c))), ["채용공고 Spring, 2024!", "ＡＢＣ①", ""])
    assert out[0] == sorted(["2024", "spring", "채용공고", "채용", "용공", "공고", "채용공", "용공고"])
    assert out[1] == ["abc1"]
    assert out[2] == []


def test_nfkc_composes_and_widens(one):
    assert one(lambda c: T.nfkc(c), ["한글", "ｶﾞ", "plain", "한국", None]) == ["한글", "ガ", "plain", "한국", None]


def test_redaction_order_and_guards(one):
    out = one(T.redact_personal_data, ["kim@example.com 2020123456 010-1234-5678", "+82 10-1234-5678x", "12010123456789", "19991231", "120200101"])
    assert out[0] == "[redacted_email] [redacted_student_id] [redacted_phone]"
    assert out[2] == "12010123456789"
    assert out[3] == "[redacted_student_id]"
    assert out[4] == "120200101"
    again = one(T.redact_personal_data, out)
    assert again == out


def test_negation_looks_at_the_first_occurrence(one):
    f = lambda c: T.negated_near(T.normalize_safety_text(c, False), F.lit("보장"))
    assert one(f, ["취업 보장은 아닙니다", "취업 보장합니다", "보장합니다 " + "가" * 40 + " 보장하지 않습니다", "없음"]) == [True, False, False, False]


def test_visible_markers_skip_code_links_and_urls(one):
    f = lambda c: F.array_join(T.visible_markers(c).cast("array<string>"), ",")
    # a link's label may reach back over earlier markers of its line, which hides them too
    assert one(f, ["a [1] `[2]` [3](http://x) ![4](y) [5]", "```\n[1]\n```\n[2]", "<b>[7]</b> https://x.y/[8] [9]"]) == ["5", "2", "7,9"]


def test_escape_round_trip(one):
    assert one(lambda c: T.unescape_markup(T.escape_markup(c)), ["a<b>&amp;\"", "&lt;"]) == ["a<b>&amp;\"", "&lt;"]


def ref():
    return F.lit("2026-05-10").cast("timestamp")


def test_deadline_rules(one):
    cases = {
        "채용 시 까지": ("active", "채용 시 까지", None), "상시채용": ("active", "상시채용", None), "D - 3": ("active", "D-3", None), "D-0": ("expired", "D-0", None),
        "D+2": ("expired", "D+2", None), "~5/10": ("active", "~5/10", "2026-05-10"), "(~1/5)": ("expired", "~1/5", "2026-01-05"),
        "마감일: 12.31": ("active", "마감일: 12.31", "2026-12-31"), "접수 마감": ("expired", "접수 마감", None), "2026.05.09 마감": ("expired", "2026.05.09 마감", "2026-05-09"),
        "마감일 미정": ("unknown", None, None), "3/4 ~ 3/9": ("unknown", "3/4 ~ 3/9", None), "": ("unknown", None, None),
    }
    out = one(lambda c: D.classify_deadline(c, ref()), list(cases))
    assert [(r.status, r.deadline_raw_text, r.deadline_date) for r in out] == list(cases.values())
    effective = one(lambda c: D.effective_status(c, F.lit("active"), ref()), list(cases))
    assert effective == [v[0] if v[0] != "unknown" else "active" for v in cases.values()]


def test_urls(one):
    assert one(lambda c: U.resolve(c, F.lit("https://a.example.com/x/y?z=1")), ["/q", "r", "../s", "//b.example.com/t", "http://c.example.com/"]) == [
        "https://a.example.com/q", "https://a.example.com/x/r", "https://a.example.com/s", "https://b.example.com/t", "http://c.example.com/",
    ]
    assert one(U.canonical, ["HTTPS://u:p@A.example.com?x=1#f"]) == ["https://a.example.com/?x=1"]
    assert one(U.is_unsafe_markdown_url, ["javascript:x", "https://u@x.example.com", "https://x.example.com", "//x", "a b", "ftp://x"]) == [True, True, False, True, False, True]
