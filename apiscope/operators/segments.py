"""Running totals over sorted rows of a key, whatever share of all rows the key holds.

A segmented scan in two passes.  Rows are range-partitioned by (key, order), so
a key of any size, also one whose rows all have one time, is spread over as many
partitions as its share asks for.  The first pass goes through each sorted
partition once, as if it began anew, and writes its rows with the local totals.
Only a partition's first key can have begun before it, so one carry for each
partition is all that crosses: the totals at partition ends are scanned along
the partitions of a key, and the second pass adds a partition's carry to the
rows of its first key that no new start precedes.

No window spans a key's rows, and nothing of the rows is broadcast: the carries
are one row a partition.  The first pass's rows stand in the work folder, so the
partitioning that the carries refer to is fixed, and a lost executor's part is
read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.files import work_path

_FIRST, _LAST = 1, 2
_ADDED = StructType([
    StructField("_base", DoubleType()), StructField("_sum", LongType()), StructField("_part", IntegerType()),
    StructField("_open", BooleanType()), StructField("_edge", IntegerType())])


class _State:
    """Where a partition's scan stands between two batches."""

    def __init__(self):
        self.key: tuple | None = None    # of the last row, None before the first
        self.base = np.nan
        self.sum = 0
        self.open = True                 # still in the first key, and no start so far


def _batch_totals(batch: pa.RecordBatch, state: _State, inclusive: bool):
    """(base, sum, open) of a batch's rows; ``state`` moves on to its end."""
    n = batch.num_rows
    key = batch.column("_k")
    codes = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = codes[1:] != codes[:-1]
    new[0] = state.key is None or state.key != (key[0].as_py(),)
    begins = state.key is None
    start = batch.column("_start").to_numpy(zero_copy_only=False).astype(float)
    step = batch.column("_step").to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.arange(n)
    seg = np.maximum.accumulate(np.where(new, row, -1))           # first row of the key, -1: before
    # of the state before a row, or after it
    at = row if inclusive else row - 1
    started = np.maximum.accumulate(np.where(~np.isnan(start), row, -1))
    last = np.where(at >= 0, started[np.maximum(at, 0)], -1)
    last = np.where(last >= np.maximum(seg, 0), last, -1)
    total = np.concatenate([[0], np.cumsum(step)])
    base = np.where(last >= 0, start[np.maximum(last, 0)], np.nan)
    begin = np.where(last >= 0, last, np.maximum(seg, 0))
    sums = total[np.maximum(at + 1, begin)] - total[begin]
    carried = (seg < 0) & (last < 0)                              # goes on from the batch before
    base = np.where(carried, state.base, base)
    sums = sums + np.where(carried, state.sum, 0)
    in_first = (seg < 0) if not begins else (seg <= 0)
    open_ = in_first & (last < 0) & state.open
    # the state after the last row
    end_start, end_seg = started[-1], seg[-1]
    if end_start >= max(end_seg, 0) and end_start >= 0:
        state.base, state.sum = start[end_start], int(total[n] - total[end_start])
    elif end_seg < 0:
        state.sum += int(total[n])
    else:
        state.base, state.sum = np.nan, int(total[n] - total[end_seg])
    first_goes_on = end_seg < 0 or (begins and end_seg == 0)
    state.open = state.open and first_goes_on and not (end_start >= 0)
    state.key = (key[n - 1].as_py(),)
    return base, sums, open_


def _local(names: Sequence[str], inclusive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held = TaskContext.get().partitionId(), _State(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] = _FIRST if held is None else 0
            base, sums, open_ = _batch_totals(batch, state, inclusive)
            if held is not None:
                yield out(*held)
            held = batch, base, sums, open_, edge, part
        if held is not None:
            held[4][-1] += _LAST
            yield out(*held)

    def out(batch, base, sums, open_, edge, part):
        added = [pa.array(base, pa.float64(), from_pandas=True), pa.array(sums, pa.int64()),
                 pa.array(np.full(len(edge), part), pa.int32()), pa.array(open_, pa.bool_()),
                 pa.array(edge, pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return run


def running(rows: DataFrame, key: str, order: Sequence[str], start: Column, step: Column, *,
            inclusive: bool) -> DataFrame:
    """Adds ``_base`` and ``_sum`` to every row of a key, in ``order``.

    ``_base`` is the last non-null ``start`` up to the row (``inclusive``) or
    before it, NULL if there is none; ``_sum`` adds up ``step`` from that row on,
    or from the key's first.  Rows of a NULL key are one key.  ``order`` must
    tell the rows of a key apart.
    """
    spark = rows.sparkSession
    names = [*rows.columns]
    ready = rows.select("*", F.col(key).cast("string").alias("_k"), start.cast("double").alias("_start"),
                        F.coalesce(step, F.lit(0)).cast("long").alias("_step"))
    ranged = ready.repartitionByRange("_k", *order).sortWithinPartitions("_k", *order)
    schema = StructType([*ranged.schema.fields, *_ADDED.fields])
    path = work_path(spark, "segments")
    ranged.mapInArrow(_local(_ADDED.fieldNames(), inclusive), schema).write.parquet(path)
    local = spark.read.schema(schema).parquet(path)

    edges = local.where(F.col("_edge") > 0)
    ends = edges.where(F.col("_edge") >= _LAST)
    if not inclusive:  # the last row's own start and step count for what follows
        own = F.col("_start").isNotNull()
        ends = ends.withColumn("_sum", F.when(own, F.col("_step")).otherwise(F.col("_sum") + F.col("_step"))) \
            .withColumn("_base", F.coalesce("_start", "_base"))
    ends = ends.select("_part", "_k", F.lit(1).alias("_end"), "_base", "_sum")
    asks = edges.where((F.col("_edge") == _FIRST) | (F.col("_edge") == _FIRST + _LAST)).select(
        "_part", "_k", F.lit(0).alias("_end"), F.lit(None).cast("double").alias("_base"),
        F.lit(0).cast("long").alias("_sum"))
    so_far = Window.partitionBy("_k").orderBy("_part", "_end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    chain = Window.partitionBy("_k", "_chain").orderBy("_part", "_end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carries = (
        ends.unionAll(asks).withColumn("_chain", F.count("_base").over(so_far)).select(
            "_part", "_end", F.last("_base", ignorenulls=True).over(so_far).alias("_from"),
            F.sum("_sum").over(chain).alias("_more"))
        .where(F.col("_end") == 0).select(F.col("_part").alias("_to"), "_from", "_more"))
    # one row a partition, read here so that its size is known when the rows are joined
    carries = spark.createDataFrame(carries.toArrow(), carries.schema)
    whole = local.join(carries, F.col("_part") == F.col("_to"), "left")
    return whole.select(
        *names, F.when(F.col("_open"), F.coalesce("_base", "_from")).otherwise(F.col("_base")).alias("_base"),
        (F.col("_sum") + F.when(F.col("_open"), F.coalesce("_more", F.lit(0))).otherwise(F.lit(0))).alias("_sum"))
