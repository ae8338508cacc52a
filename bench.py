"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query runs once to warm up and then BENCH_RUNS times over its whole
tables; the best run counts.  Results go to the ``noop`` sink, so every column
of every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from apiscope.queries import catalog

HEADLINE = [
    "B1_url_validation", "B2_scope_filter", "B2_scope_by_table", "B7_resolve_reference",
    "B11_signature", "C1_literal_endpoints", "C4_C5_all_shapes", "C7_concatenation", "corpus_stage",
    "C13_inline_scripts", "C15_secret_scan", "C17_links", "D1_pii_types", "D2_redact",
    "D4_entropy", "E1_status_category", "F1_distinct_signature", "F2_audit", "F3_ghosts",
    "F5_scan_diff", "F9_target_rollup", "F17_findings", "F20_rate_limit_exposure", "F22_backoff",
    "F26_spec_flattening", "G4_session_counts", "crawl_audit",
]


def laid_out(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables copied to ``files`` files each, as a cluster's would be.

    A given table is one file with one row group, which one core would read.
    """
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in ("pages", "documents", "conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(
            f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-work-"))
        # no Python call sites in error messages: fewer round trips per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = laid_out(spark, sf_dir, int(cpus))
    seconds: dict[str, float] = {}
    building: dict[str, float] = {}  # of that, until the plan was there
    for name in only or HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf)
            built = time.perf_counter() - start
            df.write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - start, built))
        seconds[name], building[name] = min(took[1:])
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": {n: round(s, 3) for n, s in seconds.items()},
        "building": {n: round(s, 3) for n, s in building.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
