"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows of equal text are one group.  Groups are hashed into a fixed number of
buckets; a group that is large for a bucket is an item of its own, and only one
of more than half a shard is cut into pieces.  Buckets, large groups and pieces,
of bounded number whatever the input, are the items: vectors of (bytes, tokens,
rows).  Largest first, each
goes to the shard where the dot product of its vector with the shard's residual
capacity is highest.  Only the item totals reach the driver.

The law that holds is ``bytes``: a document counts its UTF-8 bytes and 8 more.

Defined results: a null text has no bytes, no tokens and the checksum 0; null
texts are one group, and so are empty ones; rows with the same id and text are
single rows with slots of their own; an empty table has no rows.  Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets of small groups a shard gets on average.
BUCKETS_PER_SHARD = 256
#: Part of a shard from which a group stands alone, and from which it is cut.
ALONE_FROM, CUT_FROM = 1 / 32, 1 / 2
#: Rows that one window of slots holds on average.
ROWS_PER_SLOT_GROUP = 256


#: What bytes, tokens and rows count in the dot product; the law is one of bytes.
WEIGHTS = (4, 1, 1)


def place(items: list[tuple[int, int, int]], shards: int, *,
          weights: tuple[float, float, float] = WEIGHTS) -> list[int]:
    """Shard of each item (bytes, tokens, rows) by the weighted dot-product rule.

    All are measured as parts of a shard's fair share.  The residual capacity
    of a shard that is already beyond its share in some dimension is negative
    there.  Ties go to the first shard.
    """
    totals = [max(1, sum(x[d] for x in items)) / shards for d in range(3)]
    vectors = [tuple(x[d] / totals[d] for d in range(3)) for x in items]
    free = [[1.0] * 3 for _ in range(shards)]
    chosen = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(vectors[i]), i)):
        x, y, z = (v * w for v, w in zip(vectors[i], weights, strict=True))
        best = max(range(shards), key=lambda s: x * free[s][0] + y * free[s][1] + z * free[s][2])
        free[best] = [r - v for r, v in zip(free[best], vectors[i], strict=True)]
        chosen[i] = best
    return chosen


def shard(docs: DataFrame, *, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens of every document.

    ``docs`` has ``doc_id`` and ``text``.  The texts are read once; a narrow row
    for each is written to the shared folder, and all else works on those.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(text, text.isNull()).alias("same")), "packing-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens")]
    groups = written(rows.groupBy("same").agg(*sums, F.count(F.lit(1)).alias("rows")),
                     "packing-groups")
    total = groups.agg(*sums, F.sum("rows").alias("rows")).first()
    share = {c: max(1, total[c] or 0) / shards for c in ("size", "tokens", "rows")}
    part = F.greatest(*[F.col(c) / F.lit(float(n)) for c, n in share.items()])
    buckets = shards * BUCKETS_PER_SHARD
    # at most 3 * 32 groups a shard are large: their parts sum to that at most
    large = groups.where(part > ALONE_FROM).select(
        "same", F.when(part > CUT_FROM, F.least(F.ceil(part / CUT_FROM), F.col("rows")))
        .otherwise(F.lit(1)).cast("int").alias("pieces")).orderBy("same").collect()
    first, numbered = buckets, []
    for row in large:
        numbered.append((row.same, first, row.pieces))
        first += row.pieces
    alone = spark.createDataFrame(numbered, "same long, first long, pieces int")
    cut = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces"))
    rows = rows.join(F.broadcast(alone), "same", "left").withColumn(
        "item", F.coalesce(F.col("first") + cut, F.pmod(F.col("same"), F.lit(buckets))))
    items = rows.groupBy("item").agg(*sums, F.count(F.lit(1)).alias("rows")).orderBy(
        "item").collect()
    chosen = place([(r["size"], r.tokens, r.rows) for r in items], shards)
    placed = spark.createDataFrame(
        [(r.item, s, math.ceil(r.rows / ROWS_PER_SLOT_GROUP))
         for r, s in zip(items, chosen, strict=True)], "item long, shard int, windows int")
    rows = rows.join(F.broadcast(placed), "item").withColumn(
        "window", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("windows")).cast("int"))
    before = Window.partitionBy("shard").orderBy("item", "window").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "item", "window").agg(F.count(F.lit(1)).alias("n")).select(
        "item", "window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("item", "window").orderBy("doc_id", "text_crc32")
    return rows.withColumn("rank", F.row_number().over(within)).join(
        offsets, ["item", "window"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens")
