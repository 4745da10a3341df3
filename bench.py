"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moderato.plans.catalog import QUERIES  # noqa: E402
from moderato.session import local_session  # noqa: E402

HEADLINE = [
    "moderate_auto", "batch_summary", "moderate_sn", "score_batch", "detect_language", "clean_text",
    "lexicon_hits", "validate_rows", "split_assign", "stratified_sample", "merge_sources",
    "confusion", "macro_micro", "roc_auc", "benchmark_eval", "golden_eval",
    "vocab", "encoded", "tfidf_word", "tfidf_char", "moderate_stream",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="moderato-bench")
    # Warm the JVM once on the smallest tables.
    QUERIES["moderate_auto"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sf = sf_dir.rstrip("/").split("sf")[-1]
    out = {
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "documents": n_docs,
        "cpus": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "moderate_auto_comments_per_sec": round(n_docs / times["moderate_auto"], 1) if times.get("moderate_auto") else None,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
