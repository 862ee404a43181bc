"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.plans.catalogue import QUERIES
from gleaner.session import build_session

HEADLINE = [
    "impute_median",
    "cap_iqr_whisker",
    "outlier_counts",
    "scrub_pii",
    "sanitise",
    "first_seen_ids",
    "clean_text_plain",
    "clean_text_markup",
    "lemmatise",
    "noise_reviews",
    "noise_meta",
    "noise_typos",
    "denoise_reviews",
    "denoise_meta",
    "exact_sample",
    "co_purchase",
    "co_purchase_filter",
    "user_truth",
    "review_meta_join",
    "user_neighbours",
    "knn_predict",
    "content_topk",
    "pooled_eval",
    "tfidf",
    "top_words",
    "length_histogram",
    "als_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "gleaner-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    QUERIES["distinct_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
