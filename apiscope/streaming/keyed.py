"""Keyed state in event time: rows of a key in order, however late they come.

Rows wait in the state of their key until the watermark has passed them; an
event-time timer then takes them in order of (time, order column) and forgets
what no later row can need.  The answer for a row is thus the batch answer,
whatever order rows within the delay came in; rows later than that are dropped.

State holds a key's rows of the last ``delay`` and one row of memory, which ends
by a timer; `run_keyed` reports its size.  Keys share the state and the timer of
their bucket, a hash of the key, so the calls to the store follow buckets and
packs of rows, not rows or keys.  A bucket is taken up in one task, so a key that
holds much of a log is better served by the table forms of `stream`, whose work is
spread over time as well.

State lives in the RocksDB store, below the checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from .. import rules

_LIMITED = 429
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of keys; more are worth it where more cores than this work on a stream.
BUCKETS = 512
#: Rows of one value of the state, and of one table of the result.
PACK_ROWS = 2000
#: Times that pandas holds; the watermark takes earlier and later ones for these.
_EARLIEST, _LATEST = "1678-01-01 00:00:00", "2262-01-01 00:00:00"


def _packs(rows: Iterable) -> list[tuple]:
    """Values of the state that hold the rows."""
    return [(pickle.dumps(some, pickle.HIGHEST_PROTOCOL),) for some in batched(rows, PACK_ROWS)]


def _rows_in_one_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, ts, row) with all but the first two columns in ``row``, whatever their types."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
        packed = [pickle.dumps(row, pickle.HIGHEST_PROTOCOL) for row in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["bucket", "ts", "row"])


def _same(key):
    """What tells a key from others of its bucket: NaN equals itself, nested keys go by their text."""
    if isinstance(key, dict | list | tuple) or key != key:
        return repr(key)
    return key


class InOrder(StatefulProcessor):
    """Each row of a key once, in order of event time.

    Rows have the key as their first column, ``us`` (microseconds since the epoch) as
    their second and the order column as their third; `step` gets them without the key.
    A subclass says in `step` what a row gives and what is remembered of it, and in
    `needed_until` how long that is needed.
    """

    def __init__(self, out: StructType):
        self.names = out.names
        self.floats = {f.name for f in out if f.dataType.typeName() in ("float", "double")}

    def _column(self, name: str, values: tuple) -> pd.Series:
        if name in self.floats:  # NaN is no null
            return pd.Series(pd.arrays.ArrowExtensionArray(pa.array(values, pa.float64())))
        return pd.Series(values, dtype=object)

    def step(self, row: tuple, memory: tuple | None) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def needed_until(self, memory: tuple) -> float:
        """The time in microseconds from which on no row needs the memory."""
        raise NotImplementedError

    def untimed(self, row: tuple) -> list[tuple]:
        """What a row without a time gives."""
        return []

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getValueState("memory", "keys binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake_at(self, us: float | None) -> None:
        """One timer a bucket, at the first whole millisecond from ``us`` on."""
        old = self.timer.get()
        new = None if us is None else -int(-us // 1000)
        if old is not None and old[0] != new:
            self.handle.deleteTimer(old[0])
        if new is None:
            if old is not None:
                self.timer.clear()
        elif old is None or old[0] != new:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def _tables(self, made: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        for some in batched(made, PACK_ROWS):
            columns = zip(*some, strict=True)
            yield pd.DataFrame({n: self._column(n, c) for n, c in zip(
                self.names, columns, strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, untimed = None, []
        for table in rows:
            timed = []
            for row in map(pickle.loads, table["row"]):
                (untimed if row[1] is None else timed).append(row)
            if timed:
                self.waiting.appendList(_packs(timed))
                least = min(row[1] for row in timed)
                first = least if first is None else min(first, least)
        if first is not None:
            old = self.timer.get()
            if old is None or first <= old[0] * 1000:
                self._wake_at(first)
        yield from self._tables((row[0], *out) for row in untimed for out in self.untimed(row[1:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        due, later = {}, []
        for row in chain.from_iterable(
                pickle.loads(pack[0]) for pack in (self.waiting.get() if self.waiting.exists() else ())):
            if row[1] <= passed:
                due.setdefault(_same(row[0]), []).append(row)
            else:
                later.append(row)
        held = self.memory.get()
        known = pickle.loads(held[0]) if held is not None else {}
        yield from self._tables(self._taken(due, known))
        until = {k: self.needed_until(m) for k, m in known.items() if m is not None}
        known = {k: known[k] for k, us in until.items() if us > passed}
        if due:
            self.waiting.put(_packs(later)) if later else self.waiting.clear()
        if known:
            self.memory.update((pickle.dumps(known, pickle.HIGHEST_PROTOCOL),))
        elif held is not None:
            self.memory.clear()
        wake = [row[1] for row in later] + [until[k] for k in known]
        if wake:
            self._wake_at(min(wake))

    def _taken(self, due: dict, known: dict) -> Iterator[tuple]:
        """What the due rows of each key give, in order; ``known`` is what is then remembered."""
        for same, rows in due.items():
            memory = known.get(same)
            rows.sort(key=lambda r: (r[1], r[2] is not None, r[2]))
            for row in rows:
                made, memory = self.step(row[1:], memory)
                for out in made:
                    yield (row[0], *out)
            known[same] = memory


class _Exposure(InOrder):
    def __init__(self, out: StructType, default_ttl: int):
        super().__init__(out)
        self.default_ttl = default_ttl

    def step(self, row, memory):
        us, order, status, retry = row
        t = us / 1e6
        blocked = memory is not None and t < memory[0]
        out = (order, blocked, int(memory[0] - t) if blocked else 0)
        if status == _LIMITED:
            memory = (t + (retry if retry is not None and retry > 0 else self.default_ttl),)
        return [out], memory

    def needed_until(self, memory):
        return memory[0] * 1e6

    def untimed(self, row):
        return [(row[1], False, 0)]


class _Alerts(InOrder):
    def __init__(self, out: StructType, forget_us: int):
        super().__init__(out)
        self.forget_us = forget_us

    def step(self, row, memory):
        us, order = row
        new = memory is None or us - memory[0] > self.forget_us
        return [(us, order)] if new else [], (us,)

    def needed_until(self, memory):
        return memory[0] + self.forget_us + 1


def _grouped(stream: DataFrame, key: str, ts: str, order: str, delay: str, more: list[str],
             buckets: int) -> tuple[GroupedData, list[StructField]]:
    """Rows (key, us, order, more) by bucket, and the fields of key and order."""
    at = F.col(ts).cast("timestamp")
    rows = stream.select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket"),
        F.when(at.isNotNull(), F.greatest(F.least(at, F.lit(_LATEST).cast("timestamp")),
                                          F.lit(_EARLIEST).cast("timestamp"))).alias("ts"),
        F.col(key).alias("key"), F.unix_micros(at).alias("us"), F.col(order).alias("ord"), *more)
    packed = rows.mapInArrow(_rows_in_one_column, "bucket int, ts timestamp, row binary")
    return packed.withWatermark("ts", delay).groupBy("bucket"), [rows.schema["key"], rows.schema["ord"]]


def live_exposure(stream: DataFrame, *, key: str = "key", ts: str = "ts", order: str = "ord",
                  default_ttl: int = rules.RATE_LIMIT_TTL, delay: str = "10 minutes",
                  buckets: int = BUCKETS) -> DataFrame:
    """(key, ord, blocked, remaining_seconds) of each row, once the watermark has passed it.

    Equals `ratelimit.exposure` on all rows that are no later than ``delay``.
    """
    typed = stream.withColumn("status_code", F.col("status_code").cast("int")).withColumn(
        "retry_after", F.col("retry_after").cast("long"))
    rows, (name, number) = _grouped(
        typed, key, ts, order, delay, ["status_code", "retry_after"], buckets)
    out = StructType([name, number]).add("blocked", "boolean").add(
        "remaining_seconds", "long")
    return rows.transformWithStateInPandas(
        _Exposure(out, default_ttl), out, "Append", "EventTime")


def alerts(stream: DataFrame, *, key: str = "signature", ts: str = "ts", order: str = "ord",
           forget_seconds: int = 86400, delay: str = "10 minutes",
           buckets: int = BUCKETS) -> DataFrame:
    """(key, us, ord) of each row whose key was not seen for ``forget_seconds``.

    The state of a key ends when it is forgotten, so it is bounded by the keys
    of that time.  Rows without a time alert nobody.
    """
    rows, (name, number) = _grouped(stream, key, ts, order, delay, [], buckets)
    out = StructType([name, StructField("us", LongType()), number])
    return rows.transformWithStateInPandas(
        _Alerts(out, forget_seconds * 1_000_000), out, "Append", "EventTime")


def run_keyed(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Process what is there into a Parquet table and stop.

    Returns batch, input rows, rows of state, bytes of state and rows dropped as too
    late, of the batches that Spark still reports.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (stream.writeStream.format("parquet").option("path", path)
                 .option("checkpointLocation", checkpoint).outputMode("append")
                 .trigger(availableNow=True).start())
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"],
             "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]),
             "state_bytes": sum(s["memoryUsedBytes"] for s in p["stateOperators"]),
             "late_rows": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])}
            for p in query.recentProgress]
