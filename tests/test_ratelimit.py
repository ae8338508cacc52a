import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from apiscope.operators import ratelimit

SCHEMA = "ord long, key string, ts timestamp, status_code int, retry_after int"


def make_log(seed, n=300):
    """One hot key with a third of the rows, ties in time, and gaps."""
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    rows, t = [], t0
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 0, 1, 30, 500, 7000]))
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None])
        rows.append((i, key, t, rng.choice([429, 429, 200]), rng.choice([None, 0, 5, 4000])))
    return rows


def brute(rows, ttl, mult, cap):
    until, run, out = {}, {}, {}
    for o, key, ts, code, retry in rows:
        t = (ts - dt.datetime(2024, 1, 1)).total_seconds()
        blocked = t < until.get(key, -1)
        remaining = int(until[key] - t) if blocked else 0
        run[key] = run.get(key, 0) + 1 if code == 429 else 0
        if code == 429:
            until[key] = t + (retry or ttl)
        out[o] = (blocked, remaining, run[key], min(mult ** run[key], cap))
    return out


@pytest.mark.parametrize("seed,partitions,batch", [(1, 4, 10_000), (2, 9, 7), (3, 1, 1), (4, 40, 3), (5, 3, 50)])
def test_against_brute_force(spark, seed, partitions, batch):
    """Partitions and batches that cut keys anywhere change nothing."""
    rows = make_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.execution.arrow.maxRecordsPerBatch": batch,
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, str(v))
        a = ratelimit.exposure(log)
        b = ratelimit.backoff(log).select("ord", "run", "backoff_seconds")
        got = {r.ord: (r.blocked, r.remaining_seconds, r.run, r.backoff_seconds)
               for r in a.join(b, "ord").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows, 300, 2.0, 60.0)


def test_no_time_and_other_columns(spark):
    rows = [(0, "a", None, 429, 50), (1, "a", dt.datetime(2024, 1, 1), 200, None), (2, None, None, 429, None)]
    log = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "array(struct(ord)) AS _kept")
    got = {r.ord: (r.blocked, r.part) for r in ratelimit.exposure(log).collect()}
    assert got == {0: (False, 1), 1: (False, 1), 2: (False, 1)}
    assert {r.ord: r.run for r in ratelimit.backoff(log).collect()} == {0: 1, 1: 0, 2: 1}
    assert ratelimit.exposure(log.limit(0)).columns == [*log.columns, "blocked", "remaining_seconds"]
    assert ratelimit.backoff(log.limit(0)).count() == 0


def test_blocked_keys(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, "a", t0, 429, 100), (1, "a", t0 + dt.timedelta(seconds=10), 429, 20),
            (2, "b", t0, 429, None), (3, "c", t0, 200, None), (4, "d", t0 + dt.timedelta(days=1), 429, 9)]
    log = spark.createDataFrame(rows, SCHEMA)
    def at(s):
        return ratelimit.blocked_keys(log, F.lit(t0 + dt.timedelta(seconds=s))).first().blocked_keys

    # a later 429 replaces the block, also by a shorter one; the end is exclusive
    assert [at(0), at(29), at(30), at(299), at(300)] == [2, 2, 1, 1, 0]


def test_no_task_follows_a_hot_key(spark):
    """A third of 3 M rows in one key, all of one time: rows are spread evenly, totals hold."""
    n = 3_000_000
    log = spark.range(n).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), F.col("id") % 50_000)).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("timestamp").alias("ts"),
        F.when(F.col("id") % 3 == 0, 429).otherwise(200).alias("status_code"), F.lit(None).cast("int").alias("retry_after"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = ratelimit.backoff(log)
        parts = [r["count"] for r in spark.read.parquet(*done.inputFiles()).groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(parts) < 2 * n / 24
    top = done.where("key = 'hot'").agg(F.max("run"), F.sum("run"), F.count("*")).first()
    assert tuple(top) == (n // 3, (n // 3) * (n // 3 + 1) // 2, n // 3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
