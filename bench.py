"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit",
"queries": {name: seconds}, "sf"}.  Each query is fully executed with the
``noop`` sink (all rows produced, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.registry import load_all  # noqa: E402
from revlens.session import build_session  # noqa: E402
from revlens.sources.tables import TABLES  # noqa: E402

HEADLINE = [
    "category_metrics", "author_metrics", "app_metrics", "category_author_metrics",
    "dqa_flags", "dqa_flags_reviews", "dqa_report", "clean_reviews",
    "text_features", "lexical_features", "readability", "bigrams", "detect_language",
    "column_profile", "by_category", "top_n_frequency", "word_frequency",
    "lorenz_gini", "reviews_by_period",
]


def lay_out(spark, sf_dir: str, files: int) -> str:
    """The given tables are one row group each, which one task reads; lay
    them out in several files first (not timed), as large tables are."""
    out = tempfile.mkdtemp(prefix="revlens-bench-")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{out}/{t}.parquet")
    return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    sf_dir, given = lay_out(spark, sf_dir, int(cpus)), sf_dir
    reg = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    # warm-up: JVM class loading and codegen caches, not timed
    reg[names[0]].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", given)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else given}))


if __name__ == "__main__":
    main()
