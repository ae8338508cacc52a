"""Scans stored by the leaves of a digest tree, compared by reading only what differs.

A stored scan has one row per ``METHOD:url`` in folders of leaves, and a tree
whose nodes hold the number and two digests of the rows below them.  Two trees
are walked from the root: where a node agrees, nothing below it is read, and
only the leaves that differ are joined.

A leaf is chosen by the hash of the URL's host and, for its last digit, of the
signature: changes to few hosts touch few leaves, and a host that holds a third
of the rows has as many leaves as a node has children.  Rows are range-partitioned
by leaf and signature when they are stored, so no task writes a whole hot leaf.

Digests are two 64-bit hashes of each row, combined by exclusive or; with the
count they tell trees apart but for a chance near 2^-128 a node.  They guard
against accident, not against rows made to collide.

Defined results: a null method counts as GET and a null URL as empty; repeated
signatures count once, the last by ``order``; empty scans have an empty tree; a
column called ``_leaf`` is refused; other columns are kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from . import inventory

#: Children of a node and levels below the root: 4096 leaves.
FANOUT, LEVELS = 16, 3
#: Most leaves of a tree: the numbers of those that differ reach the driver.
MAX_LEAVES = 65536

_NODE = "node int, n bigint, d1 bigint, d2 bigint, level int"
_SHAPE = "fanout int, levels int, compared string, schema string"


def _content(compared: Sequence[str], seed: int) -> Column:
    """Hash of a signature and what is compared; nulls count by a flag of their own."""
    parts = [p for c in compared for p in (F.col(c), F.col(c).isNull())]
    return F.bit_xor(F.xxhash64(F.lit(seed), "signature", *parts))


def _node_of(leaf: Column, up: int, fanout: int) -> Column:
    return F.floor(leaf / F.lit(fanout ** up)).cast("int")


def store_scan(scan: DataFrame, path: str, *, order: str = "ord",
               compared: Sequence[str] = inventory.COMPARED,
               cluster: Callable[[Column], Column] = urls.host,
               fanout: int = FANOUT, levels: int = LEVELS) -> None:
    """Write a scan with its tree below ``path``, which must not exist.

    ``cluster`` maps the URL to what changes together, by default its host.
    Scans are comparable if all these arguments agree.
    """
    if not 1 < fanout ** levels <= MAX_LEAVES:
        raise ValueError(f"2 to {MAX_LEAVES} leaves, not {fanout ** levels}")
    if "_leaf" in scan.columns:
        raise ValueError("column of the stored rows: _leaf")
    spark = scan.sparkSession
    rows = inventory.last_per(inventory.signed(scan), ["signature"], order)
    groups = fanout ** (levels - 1)
    near = F.coalesce(cluster(F.coalesce("url", F.lit(""))).cast("string"), F.lit(""))
    leaf = (F.pmod(F.xxhash64(near), F.lit(groups)) * F.lit(fanout)
            + F.pmod(F.xxhash64("signature", F.lit(1)), F.lit(fanout))).cast("int")
    kept = rows.withColumn("_leaf", leaf)
    (kept.repartitionByRange("_leaf", "signature").drop("signature")
     .write.partitionBy("_leaf").parquet(f"{path}/rows"))
    shape = [(fanout, levels, ",".join(compared), kept.drop("signature", "_leaf").schema.json())]
    spark.createDataFrame(shape, _SHAPE).write.parquet(f"{path}/shape")
    leaves = (inventory.signed(_stored(spark, path)).groupBy("_leaf").agg(
        F.count(F.lit(1)).alias("n"), _content(compared, 1).alias("d1"),
        _content(compared, 2).alias("d2")))
    # a leaf counts in the node above it of each level
    paths = F.array(*[F.struct(F.lit(v).alias("level"), _node_of(
        F.col("_leaf"), levels - v, fanout).alias("node")) for v in range(levels + 1)])
    (leaves.select(F.inline(paths), "n", "d1", "d2").groupBy("level", "node").agg(
        F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
     .write.partitionBy("level").parquet(f"{path}/tree"))


def _shape(spark: SparkSession, path: str):
    return spark.read.schema(_SHAPE).parquet(f"{path}/shape").first()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    fields = T.StructType.fromJson(json.loads(_shape(spark, path)["schema"])).fields
    return spark.read.schema(T.StructType([*fields, T.StructField("_leaf", T.IntegerType())])) \
        .parquet(f"{path}/rows")


def _nodes(spark: SparkSession, path: str, level: int, nodes: Sequence[int]) -> DataFrame:
    return spark.read.schema(_NODE).parquet(f"{path}/tree").where(
        (F.col("level") == level) & F.col("node").isin(*nodes)).select(
        "node", F.struct("n", "d1", "d2").alias("digest"))


def differing_leaves(spark: SparkSession, before: str, after: str) -> list[int]:
    """Numbers of the leaves whose rows differ, at most as many as the trees have.

    One small join a level; below a node that agrees nothing is looked at.
    """
    one, two = (_shape(spark, p) for p in (before, after))
    if one[:3] != two[:3]:
        raise ValueError(f"scans stored in different ways: {one[:3]} and {two[:3]}")
    nodes: list[int] = [0]
    for level in range(one.levels + 1):
        a, b = (_nodes(spark, p, level, nodes) for p in (before, after))
        both = a.withColumnRenamed("digest", "a").join(
            b.withColumnRenamed("digest", "b"), "node", "full_outer")
        found = sorted(r.node for r in both.where(
            ~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        if not found or level == one.levels:
            return found
        nodes = [n * one.fanout + i for n in found for i in range(one.fanout)]
    return []


def stored_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """As ``compare_scans`` of the two scans, without the unchanged rows.

    The walk over the trees runs when this is called; the rows are read later,
    from the folders of the differing leaves alone.
    """
    leaves = differing_leaves(spark, before, after)
    sides = [_stored(spark, p).where(F.col("_leaf").isin(*leaves)).drop("_leaf")
             for p in (before, after)]
    compared = _shape(spark, before).compared.split(",")
    return inventory.compare_scans(*sides, order="signature", compared=compared).where(
        F.col("change_type") != "unchanged")


def stored_change_counts(spark: SparkSession, before: str, after: str) -> DataFrame:
    """change_type and n; what is unchanged is told by the root's count."""
    kinds = stored_changes(spark, before, after).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("n"))
    total = spark.read.schema(_NODE).parquet(f"{before}/tree").where("level = 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    left = (total.select("n").unionByName(
        kinds.where(F.col("change_type").isin("removed", "changed")).select((-F.col("n")).alias("n")))
        .agg(F.sum("n").alias("n")).where("n > 0"))
    return kinds.unionByName(left.select(F.lit("unchanged").alias("change_type"), "n"))
