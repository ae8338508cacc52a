"""Rate limiting seen in a request log: exposure, blocked keys, back-off.

A log row has key, ts, an order column for equal times, status_code and
retry_after.  One key may hold a third of a very large log, or all of its rows
one time: exposure and back-off are running totals of `segments.running`, whose
largest task depends on no key's share.  The log is sorted once and written to
the work folder while the query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .segments import running

_LIMITED = 429


def _seconds(ts: Column) -> Column:
    """Seconds since the epoch with fraction, for either timestamp type."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _ttl(default_ttl: int) -> Column:
    return F.when(F.coalesce("retry_after", F.lit(0)) > 0, F.col("retry_after")) \
        .otherwise(F.lit(default_ttl))


def exposure(log: DataFrame, *, key: str = "key", ts: str = "ts", order: str = "ord",
             default_ttl: int = rules.RATE_LIMIT_TTL) -> DataFrame:
    """Was the key still blocked by its latest earlier 429, and for how long.

    Adds ``blocked`` and ``remaining_seconds`` (0 if not blocked).  A row
    without a time is not blocked and blocks nothing.
    """
    rows = log.withColumn("_t", _seconds(F.col(ts)))
    until = F.when(F.col("status_code") == _LIMITED, F.col("_t") + _ttl(default_ttl))
    block = F.col("_base")
    return (
        running(rows, key, ["_t", order], until, F.lit(0), inclusive=False)
        .withColumn("blocked", F.coalesce(F.col("_t") < block, F.lit(False)))
        .withColumn("remaining_seconds", F.when(F.col("blocked"), F.floor(block - F.col("_t")))
                    .otherwise(F.lit(0)))
        .drop("_t", "_base", "_sum")
    )


def blocked_keys(log: DataFrame, at: Column, *, key: str = "key", ts: str = "ts",
                 order: str = "ord", default_ttl: int = rules.RATE_LIMIT_TTL) -> DataFrame:
    """Number of keys whose latest 429 up to ``at`` still holds at that time."""
    now = _seconds(at)
    limited = log.withColumn("_t", _seconds(F.col(ts))).where(
        (F.col("status_code") == _LIMITED) & (F.col("_t") <= now))
    latest = limited.groupBy(key).agg(
        F.max_by(F.col("_t") + _ttl(default_ttl), F.struct("_t", order)).alias("until"))
    return latest.agg(F.count_if(F.col("until") > now).alias("blocked_keys"))


def backoff(log: DataFrame, *, key: str = "key", ts: str = "ts", order: str = "ord",
            multiplier: float = rules.BACKOFF_MULTIPLIER, cap: float = rules.BACKOFF_CAP) -> DataFrame:
    """Back-off level per response: the k-th 429 in a row gives
    ``least(multiplier^k, cap)``; any other response resets it to 1.

    Adds ``run`` (429s in a row up to this one) and ``backoff_seconds``.
    """
    rows = log.withColumn("_t", _seconds(F.col(ts)))
    hit = F.coalesce(F.col("status_code") == _LIMITED, F.lit(False))
    return (
        running(rows, key, ["_t", order], F.when(~hit, 0.0), hit.cast("long"), inclusive=True)
        .withColumn("run", F.col("_sum"))
        .withColumn("backoff_seconds", F.least(F.pow(F.lit(float(multiplier)), F.col("run")),
                                               F.lit(float(cap))))
        .drop("_t", "_base", "_sum")
    )
