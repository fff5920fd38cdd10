"""Times the headline queries and prints one JSON line.

Each query runs twice to a sink that takes all rows; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.registry import load  # noqa: E402
from postloom.session import build_session  # noqa: E402

HEADLINES = [
    # vectors
    "centroid_mean",
    "centroid_median",
    "centroid_median_by_rank",
    "cosine_topk",
    "retrieval_precision",
    "svd_project",
    # tables and time
    "clean_posts",
    "flatten_posts",
    "distinct_per_column",
    "duplicate_count",
    "histogram20",
    "dense_15m",
    "gap_runs",
    "exact_sample",
    "points_with_text",
    "missing_days",
    # sources and streams
    "json_lines",
    "ingest_days",
    "stream_tumbling",
    # text, rows/s of whole documents
    "marker_clean",
    "marker_clean_words",
    "normalise_post",
    "bag_of_words_clean",
    "topic_matches",
    "topic_catalogue",
    "word_freq",
    "sentiment_lexicon",
    "stream_clean_posts",
]
TEXT = ["marker_clean", "marker_clean_words", "normalise_post", "bag_of_words_clean"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="postloom-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = round(time.perf_counter() - start, 3)
            seconds[name] = min(taken, seconds.get(name, taken))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "sum of warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "documents_per_second": {n: round(documents / seconds[n]) for n in TEXT},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
