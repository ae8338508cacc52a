"""Writers.  Tables are written in parallel; documents as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scan_table(df: DataFrame, path: str, *, scan: str = "scan_id",
                     fmt: str = "parquet") -> None:
    """Write by scan; a rerun replaces only the scans it contains."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(scan).format(fmt).save(path))


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_host_list(hosts: DataFrame, path: str, *, host: str = "host") -> None:
    """Distinct hosts in sorted part files (range partitioned, sorted inside)."""
    (hosts.select(host).distinct().orderBy(host)
     .write.mode("overwrite").text(path))


def write_document(lines: DataFrame, path: str, *, order: Sequence[str] = ("part", "key"),
                   scan: str | None = None) -> None:
    """Text lines in order: the part files, read by name, are the document.

    With ``scan`` there is one folder per document.  A range sort spreads one
    huge document over many tasks.
    """
    keys = ([scan] if scan else []) + list(order)
    ordered = lines.orderBy(*keys)
    if scan:
        ordered.select(scan, "line").write.mode("overwrite").partitionBy(scan).text(path)
    else:
        ordered.select("line").write.mode("overwrite").text(path)


def flat_endpoints(inventory: DataFrame) -> DataFrame:
    """Endpoints with the source location as plain columns, nothing lost."""
    s = F.col("source")
    return inventory.select(
        *[c for c in inventory.columns if c != "source"],
        s["file"].alias("source_file"), s["line"].alias("source_line"),
        s["column"].alias("source_column"), s["context"].alias("source_context"))


def nested_endpoints(flat: DataFrame) -> DataFrame:
    """Inverse of ``flat_endpoints`` with the defaults of method and status."""
    location = F.when(F.col("source_file").isNotNull(), F.struct(
        F.col("source_file").alias("file"),
        F.coalesce("source_line", F.lit(0)).alias("line"),
        F.coalesce("source_column", F.lit(0)).alias("column"),
        F.coalesce("source_context", F.lit("")).alias("context")))
    flat_names = ("source_file", "source_line", "source_column", "source_context")
    return (
        flat.withColumn("source", location)
        .withColumn("method", F.coalesce("method", F.lit("GET")))
        .withColumn("status", F.coalesce("status", F.lit("discovered")))
        .drop(*flat_names)
    )


def read_scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
