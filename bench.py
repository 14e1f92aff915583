"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores. Each query is
built and fully computed ``BENCH_ROUNDS`` times after one warm-up and its best time
counts. ``BENCH_ONLY`` takes a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import time

from postmatch_checks import tables
from postmatch_checks.compare import session
from postmatch_checks.queries import REGISTRY

HEADLINE = (
    "full_score", "one_profile_score", "top10", "top_per_profile", "top_keywords",
    "term_freq", "token_filter", "skill_sets", "normalize_text", "text_embedding",
    "cosine_match", "html_text", "page_link", "profile_text", "source_fallback",
    "json_payload", "recency", "keyword_filter", "report_html", "batch_run",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    spark = session(cores)
    postings = tables.derive(spark, sf_dir, tables.POSTINGS).count()
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(min(timed(spark, name, sf_dir) for _ in range(rounds)), 3)
    rates = {}
    if "one_profile_score" in seconds:
        rates["postings_per_sec_1_profile"] = round(postings / seconds["one_profile_score"])
    if "full_score" in seconds:
        rates["pairs_per_sec_4_profiles"] = round(4 * postings / seconds["full_score"])
    print(
        json.dumps(
            {
                "metric": "total of best times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "postings": postings,
                **rates,
            }
        )
    )


if __name__ == "__main__":
    main()
