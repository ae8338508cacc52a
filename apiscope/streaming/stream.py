"""Streaming: incremental scans, distinct assets, alerts, windows, exposure.

The row-wise operators run on a stream as they are.  Everything with memory
bounds it: by a watermark, by event-time timers, or by keeping it in a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..sources.files import folder_exists


def read_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet",
                glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append to a Parquet table and stop."""
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None],
                checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def distinct_assets(stream: DataFrame, *, url: str = "url", ts: str = "ts",
                    delay: str = "1 hour") -> DataFrame:
    """Assets not seen within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


#: Folders over which an inventory is spread by a hash of the signature.
BUCKETS = 64


def new_endpoint_writer(spark: SparkSession, inventory_path: str,
                        order: str = "ord") -> Callable[[DataFrame, int], None]:
    """Batch handler that appends endpoints with a signature not yet stored.

    The inventory table itself is the memory, partitioned by a hash of the
    signature and by batch: a batch reads only the parts that its own
    signatures fall to, and one that is run again overwrites its own partitions
    and sees only earlier ones.
    """
    from ..operators.inventory import distinct_endpoints

    def handle(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("signature"), F.lit(BUCKETS)).cast("int")
        fresh = distinct_endpoints(batch, order=order).withColumn("bucket", bucket)
        if folder_exists(spark, inventory_path):
            own = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
            known = spark.read.parquet(inventory_path).where(
                F.col("bucket").isin(*own) & (F.col("batch") < batch_id))
            fresh = fresh.join(known.select("signature"), "signature", "left_anti")
        write_batch(fresh, inventory_path, batch_id, "bucket")

    return handle


def windowed_counts(events: DataFrame, window, *, ts: str = "ts", by: str = "kind",
                    delay: str | None = None) -> DataFrame:
    """Rows per window and kind; with ``delay`` late rows are dropped.

    ``window`` is ``F.window(...)`` or ``F.session_window(...)`` on ``ts``.
    """
    rows = events if delay is None else events.withWatermark(ts, delay)
    return (
        rows.groupBy(window.alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                F.col(by), "n")
    )


def tumbling(ts: str, length: str):
    return F.window(ts, length)


def sliding(ts: str, length: str, step: str):
    return F.window(ts, length, step)


def session(ts: str, gap: str):
    return F.session_window(ts, gap)


def exposure_writer(spark: SparkSession, out_path: str, state_path: str, *, key: str = "key",
                    ts: str = "ts", order: str = "ord",
                    default_ttl: int = rules.RATE_LIMIT_TTL,
                    late_seconds: int = 600) -> Callable[[DataFrame, int], None]:
    """Batch handler for rate-limit exposure on a live log.

    The batch operator does the work, so a hot key is windowed per time bucket
    here as well.  The memory between batches, put in front of the next one, is
    what rows up to ``late_seconds`` late may still need: every 429 younger than
    that, and of each key the last one before, while it may block.  State and
    output are partitioned by batch: a batch that runs again reads the state
    before it and overwrites its own partitions.
    """
    from ..operators.ratelimit import exposure

    names = [key, ts, order, "status_code", "retry_after"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*names).withColumn("_old", F.lit(False))
        before = f"{state_path}/batch={batch_id - 1}"
        if folder_exists(spark, before):
            rows = rows.unionByName(
                spark.read.parquet(before).select(*names).withColumn("_old", F.lit(True)))
        checked = exposure(rows, key=key, ts=ts, order=order, default_ttl=default_ttl)
        write_batch(checked.where(~F.col("_old")).drop("_old"), out_path, batch_id)
        limited = rows.where(F.col("status_code") == 429).select(
            *names, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
        newest = rows.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).scalar()
        young = F.coalesce(F.col("_us") >= newest - late_seconds * 1_000_000, F.lit(True))
        ttl = F.when(F.coalesce("retry_after", F.lit(0)) > 0, F.col("retry_after")) \
            .otherwise(F.lit(default_ttl))
        alive = F.col("_us") + (ttl.cast("bigint") + late_seconds) * 1_000_000 >= newest
        last = (limited.where(~young).groupBy(key).agg(F.max_by(
            F.struct(*names[1:], "_us"), F.struct(ts, order)).alias("r")).select(key, "r.*"))
        kept = limited.where(young).select(*names).unionByName(last.where(alive).select(*names))
        write_batch(kept, state_path, batch_id)

    return handle


def write_batch(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    (df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path))


def endpoint_stream(pages: DataFrame, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """Crawled pages as endpoint rows (stateless)."""
    return pages.select(F.col(key).alias("ord"), F.lit("GET").alias("method"),
                        urls.path(url).alias("url"))
