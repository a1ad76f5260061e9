"""Every check of citations fails at least once, and nothing else does."""

from siftbase.operators import evaluate as E

CASES = "query_id string, refusal_tier string, collection_categories array<string>, source_families array<string>, source_ids array<string>, deadline_statuses array<string>"
CITATIONS = "query_id string, citation_id int, chunk_id string, url string, posted_at string, fetched_at string, deadline_status string"
RESULTS = "query_id string, chunk_id string, source_id string, collection_category string, source_family string, status string"
DAY = "2026-01-02T03:04:05Z"


def test_citations_of_filtered_cases(spark):
    cases = [
        ("filtered", "normal_answer", ["jobs"], None, None, None), ("hedged", None, None, ["f"], None, ["active"]),
        ("refused", "hard_refuse", ["jobs"], None, None, None), ("open", "normal_answer", None, None, None, None),
    ]
    good = ("https://example.com/", DAY, DAY, "active")
    citations = [
        ("filtered", 1, "a", *good),
        ("filtered", 2, "missing", "http://example.com/", None, None, None),  # fails for one reason alone
        ("filtered", 3, "other", *good),
        ("filtered", 4, "a", "https://example.com/", None, DAY, "active"),
        ("filtered", 5, "a", "https://example.com/", DAY, "2026-01-02", "active"),
        ("filtered", 6, "a", "https://example.com/", DAY, DAY, "closed"),
        ("filtered", 7, "a", "http://example.com/", DAY, DAY, None),
        ("filtered", 8, None, *good),
        ("hedged", 1, "expired", *good),
        ("refused", 1, "missing", *good), ("open", 1, "missing", *good), ("no case", 1, "a", *good),
    ]
    results = [("filtered", "a", "s", "jobs", "f", "active"), ("filtered", "other", "s", "events", "f", "active"), ("hedged", "expired", "s", "jobs", "f", "expired"), ("hedged", "missing", "s", "jobs", "f", "active")]
    made = E.citation_failures(spark.createDataFrame(cases, CASES), spark.createDataFrame(citations, CITATIONS), spark.createDataFrame(results, RESULTS))
    assert sorted(map(tuple, made.collect())) == sorted(
        [
            ("filtered", "citation 2 does not map to public filtered retrieval results"), ("filtered", "citation 3 cites evidence outside requested filters"),
            ("filtered", "filtered citation 4 lacks posted_at"), ("filtered", "filtered citation 5 lacks fetched_at"), ("filtered", "filtered citation 6 lacks deadline_status"),
            ("filtered", "filtered citation 7 lacks deadline_status"), ("filtered", "filtered citation 7 lacks HTTPS source URL"),
            ("filtered", "citation 8 does not map to public filtered retrieval results"), ("hedged", "citation 1 cites evidence outside requested filters"),
        ]
    )
    none = E.citation_failures(spark.createDataFrame(cases, CASES), spark.createDataFrame([], CITATIONS), spark.createDataFrame(results, RESULTS))
    assert none.count() == 0


def test_prohibited_patterns(spark):
    answers = spark.createDataFrame([("a", "채용 보장합니다"), ("b", "nothing"), ("c", None)], "query_id string, answer string")
    patterns = spark.createDataFrame([("a", r"보장"), ("a", r"^보장"), ("b", "n.t"), ("c", ".*"), ("d", ".*")], "query_id string, pattern string")
    assert sorted(r.failure for r in E.prohibited_matches(answers, patterns).collect()) == ["answer contains prohibited pattern n.t", "answer contains prohibited pattern 보장"]
