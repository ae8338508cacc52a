"""Helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.files import work_path

#: Bytes of text that a task turns into arrays at a time (a longer text stands alone).
PART_BYTES = 1_000_000
#: Rows that Spark hands to a Python worker at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers of the session can import this package."""
    configure(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows Python workers then get in small batches: texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, name: str) -> DataFrame:
    """`written` for narrow rows, in no more files than keep all cores busy."""
    return written(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), name)


_kept: dict = {}


def kept(key, make: Callable[[], object]):
    """The one object that a worker keeps between tasks; another takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _tidily(step, keeps: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not keeps:
        _kept.clear()
    try:
        yield from step(batches)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # only glibc has it
            pass


def tidy(step, keeps: bool = False):
    """An Arrow step after which the worker gives freed memory back to the system.

    Workers outlive the stage they worked in, so what one holds is taken from the
    operators after it.  A step that keeps nothing drops what others `kept`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tidily(step, keeps, batches)

    return run


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``needed`` columns renamed, and the way back.

    Whatever other columns are called, they then clash with none of an operator's;
    the way back keeps the columns of ``docs`` only, in their order.
    """
    kept = {c: c if c in needed else f"_kept{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(c) for c, k in kept.items()])

    return docs.withColumnsRenamed({c: k for c, k in kept.items() if c != k}), back


def parts(batches: Iterator[pa.RecordBatch], column: str = "text",
          limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text each, or of one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
