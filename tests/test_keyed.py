"""Keyed state: late rows, several batches, restarts and what the state holds."""

import random

import pytest
from pyspark.sql import functions as F

from apiscope.operators import ratelimit
from apiscope.streaming import keyed, stream
from test_ratelimit import SCHEMA, make_log
from test_stream import append_in_order

US = 1_000_000


def arrivals(rows, delay, seed=0):
    """The rows in an order of arrival in which none is more than ``delay`` seconds late."""
    rng = random.Random(seed)
    at = {r[0]: r[2].timestamp() + rng.uniform(0, delay - 1) for r in rows}
    return sorted(rows, key=lambda r: at[r[0]])


@pytest.fixture
def late_log(spark, tmp_path):
    rows = arrivals(make_log(5, 240), 600)
    folder = str(tmp_path / "log")
    append_in_order(spark, [rows[i * 40:(i + 1) * 40] for i in range(6)], SCHEMA, folder)
    return rows, folder


def passed(rows, delay=600):
    newest = max(r[2] for r in rows).timestamp()
    return {r[0] for r in rows if r[2].timestamp() <= newest - delay}


def test_exposure_of_late_rows_equals_batch(spark, late_log, tmp_path):
    rows, folder = late_log
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    live = keyed.live_exposure(stream.read_stream(spark, folder, SCHEMA, files_per_batch=1))
    report = keyed.run_keyed(live, out, mark)
    assert sum(p["rows"] > 0 for p in report) == 6 and all(p["late_rows"] == 0 for p in report)
    want = {r.ord: (r.blocked, r.remaining_seconds)
            for r in ratelimit.exposure(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {r.ord: (r.blocked, r.remaining_seconds) for r in spark.read.parquet(out).collect()}
    assert got == {k: v for k, v in want.items() if k in passed(rows)} and len(got) > 100


def test_a_restart_goes_on(spark, late_log, tmp_path):
    rows, folder = late_log
    part, out, mark = (str(tmp_path / n) for n in ("part", "out", "mark"))
    append_in_order(spark, [rows[:80]], SCHEMA, part)
    for more in (None, rows[80:160], rows[160:]):
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(part)
        keyed.run_keyed(keyed.live_exposure(stream.read_stream(spark, part, SCHEMA)), out, mark)
    want = {r.ord: r.blocked for r in ratelimit.exposure(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = [(r.ord, r.blocked) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: want[k] for k in passed(rows)}


def test_alerts_again_when_forgotten(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "signature string, us long, ord long"
    batches = [[("a", 100, 1), ("b", 110, 2), ("a", 90, 3), (None, 95, 4)],
               [("a", 150, 5), ("c", 140, 6), ("a", None, 7)],
               [("b", 1000, 8), ("a", 20, 9)],   # 20 is too late by then
               [("a", 150 + 501, 10), ("a", 1100, 11)], [("z", 9000, 12), ("q", 30, 13)]]
    append_in_order(spark, [[(k, None if t is None else t * US, o) for k, t, o in b] for b in batches],
                    schema, folder)
    rows = stream.read_stream(spark, folder, schema, files_per_batch=1)
    rows = rows.selectExpr("signature", "timestamp_micros(us) AS ts", "ord")
    report = keyed.run_keyed(keyed.alerts(rows, forget_seconds=500, delay="60 seconds"), out, mark)
    got = sorted((r.key or "", r.us // US, r.ord) for r in spark.read.parquet(out).collect())
    # 651 and 1100 are less than 500 apart; the newest row has not been passed
    assert got == [("", 95, 4), ("a", 90, 3), ("a", 651, 10), ("b", 110, 2), ("b", 1000, 8),
                   ("c", 140, 6)]
    assert sum(p["late_rows"] for p in report) == 2
    # all is forgotten but the newest row, which waits
    assert report[-1]["state_rows"] <= 6


def test_empty_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    append_in_order(spark, [[]], SCHEMA, folder)
    keyed.run_keyed(keyed.live_exposure(stream.read_stream(spark, folder, SCHEMA)), out,
                    str(tmp_path / "mark"))
    assert spark.read.schema("ord long").parquet(out).count() == 0


def test_state_follows_buckets_not_keys(spark, tmp_path):
    """3000 keys of two rows each, some null or not a number, and a time that pandas cannot hold."""
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "key double, us long, ord long, status_code int, retry_after long"
    keys = [None, float("nan"), *map(float, range(2998))]
    rows = [(k, (5_000 + 40 * n + i % 7) * US, 2**60 + 3000 * n + i, 429 - 229 * n, 45 if i % 2 else None)
            for n in (0, 1) for i, k in enumerate(keys)]
    rows += [(1.0, None, None, 429, 5), (2.0, 10**16, 8, 200, None)]
    append_in_order(spark, [rows[:3000], rows[3000:]], schema, folder)
    read = stream.read_stream(spark, folder, schema, files_per_batch=1).withColumn(
        "ts", F.timestamp_micros("us"))
    report = keyed.run_keyed(keyed.live_exposure(read, default_ttl=30), out, mark)
    assert max(p["state_rows"] for p in report) < 3000
    log = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    want = ratelimit.exposure(log, default_ttl=30).where("us is null or us < 10000000000000000")
    names = ["key", "ord", "blocked", "remaining_seconds"]
    got = sorted(map(repr, spark.read.parquet(out).select(*names).collect()))
    assert got == sorted(
        map(repr, want.select(*names).collect()))
