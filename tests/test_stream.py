import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from apiscope.operators import inventory, ratelimit
from apiscope.streaming import stream
from test_ratelimit import SCHEMA, make_log


def append_in_order(spark, batches, schema, folder):
    """One file per batch with rising modification times, so streams keep the order."""
    for i, rows in enumerate(batches):
        before = set(glob.glob(f"{folder}/*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for path in set(glob.glob(f"{folder}/*.parquet")) - before:
            os.utime(path, (1_700_000_000 + i * 60,) * 2)


@pytest.fixture
def split_log(spark, tmp_path):
    """A request log as four files in time order, read one per micro-batch."""
    rows = make_log(9, 200)
    folder = str(tmp_path / "log")
    append_in_order(spark, [rows[i * 50:(i + 1) * 50] for i in range(4)], SCHEMA, folder)
    return rows, folder


def test_exposure_over_batches_equals_batch(spark, split_log, tmp_path):
    rows, folder = split_log
    out, state, mark = (str(tmp_path / n) for n in ("out", "state", "mark"))
    live = stream.read_stream(spark, folder, SCHEMA, files_per_batch=1)
    stream.run_batches(live, stream.exposure_writer(spark, out, state), mark)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    want = ratelimit.exposure(spark.createDataFrame(rows, SCHEMA))
    names = ["ord", "blocked", "remaining_seconds"]
    assert got.select(*names).exceptAll(want.select(*names)).count() == 0 and got.count() == len(rows)


def test_a_repeated_batch_changes_nothing(spark, split_log, tmp_path):
    rows, folder = split_log
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    handle = stream.exposure_writer(spark, out, state)
    first = spark.createDataFrame(rows[:100], SCHEMA)
    second = spark.createDataFrame(rows[100:], SCHEMA)
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        handle(batch, i)
    want = ratelimit.exposure(spark.createDataFrame(rows, SCHEMA)).select("ord", "blocked")
    assert spark.read.parquet(out).select("ord", "blocked").exceptAll(want).count() == 0
    assert spark.read.parquet(out).count() == len(rows)


def test_new_endpoints_alert_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ord long, method string, url string"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        live = stream.read_stream(spark, folder, schema)
        stream.run_batches(live, stream.new_endpoint_writer(spark, out), mark)
        return {(r.signature, r.ord) for r in spark.read.parquet(out).collect()}

    add((0, "GET", "/a/{x}"), (1, "GET", "/a/{y}"))
    assert run() == {("GET:/a/{param}", 0)}
    add((2, "GET", "/a/{z}"), (3, "PUT", "/b"))
    assert run() == {("GET:/a/{param}", 0), ("PUT:/b", 3)}
    assert run() == {("GET:/a/{param}", 0), ("PUT:/b", 3)}  # restart with nothing new


def test_distinct_assets_and_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    schema = "url string, kind string, ts timestamp"
    batches = [[("a", "k", t0), ("a", "k", t0 + dt.timedelta(minutes=1)), ("b", "k", t0)],
               [("c", "k", t0 + dt.timedelta(hours=5))],
               [("a", "k", t0 + dt.timedelta(minutes=2)), ("d", "k", t0 + dt.timedelta(hours=9))],
               [("a", "k", t0 + dt.timedelta(minutes=3))]]
    append_in_order(spark, batches, schema, folder)
    live = stream.read_stream(spark, folder, schema, files_per_batch=1)
    out = str(tmp_path / "assets")
    stream.run_to_table(stream.distinct_assets(live).select("url"), out, str(tmp_path / "m1"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]

    counts = stream.windowed_counts(live, stream.tumbling("ts", "1 hour"), delay="10 minutes")
    wout = str(tmp_path / "windows")
    stream.run_to_table(counts, wout, str(tmp_path / "m2"))
    got = {(r.window_start.hour, r.n) for r in spark.read.parquet(wout).collect()}
    # late rows are measured by the watermark of the batch before: the row of 00:02 still
    # counts, the one of 00:03 comes after its window was written
    assert got == {(0, 4), (5, 1)}


def test_stateless_stream_equals_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "page_id long, url string"
    rows = [(i, f"https://h/a/{i % 7}?q={i}") for i in range(40)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(folder)
    live = stream.read_stream(spark, folder, schema, files_per_batch=1)
    for _ in range(2):  # a restart finds its work done
        stream.run_to_table(stream.endpoint_stream(live), out, str(tmp_path / "mark"))
    got = inventory.distinct_endpoints(spark.read.parquet(out))
    want = inventory.distinct_endpoints(stream.endpoint_stream(spark.createDataFrame(rows, schema)))
    assert got.count() == 7
    assert got.select("signature", "ord").exceptAll(want.select("signature", "ord")).count() == 0
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 40


def test_late_rows_still_meet_earlier_limits(spark, tmp_path):
    """429 at 0 s and 200 s, then a row at 100 s: the first of them blocks it."""
    t0 = dt.datetime(2024, 1, 1)

    def at(ord_, seconds, status):
        return (ord_, "k", t0 + dt.timedelta(seconds=seconds), status, 150)

    batches = [[at(0, 0, 429), at(1, 200, 429)], [at(2, 100, 200)], [at(3, 600, 200), at(4, 340, 200)],
               [at(5, 349, 200), at(6, 351, 200)]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    handle = stream.exposure_writer(spark, out, state)
    for i, rows in enumerate(batches):
        handle(spark.createDataFrame(rows, SCHEMA), i)
    names = ["ord", "blocked", "remaining_seconds"]
    want = ratelimit.exposure(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    assert sorted(map(tuple, spark.read.parquet(out).select(*names).collect())) == sorted(
        map(tuple, want.select(*names).collect()))


def test_an_unreadable_inventory_is_an_error(spark, tmp_path):
    (tmp_path / "inventory").mkdir()
    (tmp_path / "inventory" / "part-0.parquet").write_text("no parquet")
    batch = spark.createDataFrame([(0, "GET", "/a")], "ord long, method string, url string")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        stream.new_endpoint_writer(spark, str(tmp_path / "inventory"))(batch, 1)
