"""Times of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tabspark.plans import load

HEADLINES = (
    "pack_bars",
    "split_by_gap",
    "anchored_columns",
    "shared_positions",
    "nearest_exclusive",
    "cover_ranges",
    "carry_state",
    "quantize_onsets",
    "hold_bends",
    "resolve_links",
    "align_numbers",
    "unify_bars",
    "tempo_map",
    "chord_names",
    "hand_windows",
    "scan_tab",
    "compare_readings",
    "upsert_catalog",
    "apply_note_edits",
    "rate_limit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
