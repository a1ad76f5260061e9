"""Headline benchmark: one JSON line.

Driver tables at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.  ``index_build``
is the index that all retrieval entries share.  ``synthetic_*``
entries repeat the published scale test: an index over 100 000 rule-made chunks,
then 20 plain and 20 filtered queries, each set as one batch.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "bm25_topk", "retrieve_full", "retrieve_filtered", "term_stats", "chunk_full", "redact_all", "source_decisions", "input_safety", "output_safety",
    "page_text", "page_links", "manifest", "duplicate_ids", "upsert_merge", "deadline_rules", "decision_chain", "recommend", "session_refs", "preference_state", "p95",
)


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def synthetic(spark, n: int) -> dict[str, float]:
    from pyspark.sql import functions as F

    from siftbase.operators import blocks as bk, index as ix
    from siftbase.sources.synthetic import synthetic_chunks, synthetic_queries

    families = ["f0", "f1", "f2", "f3", "f4", "f5"]
    ref = F.lit("2024-06-01").cast("timestamp")
    out: dict[str, float] = {}
    stored = []
    out[f"synthetic_{n}_index"] = timed(lambda: stored.append(bk.TermIndex.build(ix.build_index(synthetic_chunks(spark, n, families)))))
    for label, filtered in (("plain", False), ("filtered", True)):
        asked = synthetic_queries(spark, 20, families, filtered)
        out[f"synthetic_{n}_{label}_20"] = timed(lambda: consume(bk.retrieve(stored[0], asked, ref)))
    return out


def main() -> None:
    from siftbase.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    from siftbase.plans import QUERIES

    from siftbase.plans.retrieval import stored_terms

    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    consume(QUERIES["corpus_stats"](spark, sf_dir))  # class loading and compiler warm-up
    times = {} if len(sys.argv) > 1 else {"index_build": timed(lambda: stored_terms(spark, sf_dir))}  # shared by the retrieval queries below
    times |= {name: timed(lambda name=name: consume(QUERIES[name](spark, sf_dir))) for name in names}
    if len(sys.argv) == 1:
        times.update(synthetic(spark, int(os.environ.get("BENCH_CHUNKS", "100000"))))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
