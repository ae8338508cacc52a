"""Whole questions composed from the operators: corpus, crawl, responses, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import extract, inventory, resolve, responses, scope
from ..sources.files import work_path

_TOKENS = ("file string, ord int, name string, value string, kind int, line int, column int, "
           "severity string, token string")


def parse_corpus(files: DataFrame, work: str | None = None, *, path: str = "file",
                 text: str = "text", language: str = "language") -> dict[str, DataFrame]:
    """Endpoints, secrets and per-file counts of a source corpus.

    The texts are read once, when this is called, and all tokens are written
    below ``work`` (a new shared work folder by default).  All that follows
    reads that table, so nothing scans or parses a text again, also after the
    loss of an executor.
    """
    spark = files.sparkSession
    work = work or work_path(spark, "corpus")
    (resolve.source_tokens(files, path=path, text=text, language=language)
     .write.mode("overwrite").partitionBy("token").parquet(work))
    tokens = spark.read.schema(_TOKENS).parquet(work)
    calls, found = resolve.calls_of(tokens), resolve.secrets_of(tokens)
    names = ["file", "url", "method", "match_kind"]
    endpoints = (
        resolve.literals_of(tokens).select(*names)
        .unionByName(extract.literal_calls(calls).select(*names))
        .unionByName(resolve.resolved_calls(calls, resolve.definitions_of(tokens)).select(*names)))
    return {"endpoints": endpoints, "secrets": found,
            "files": extract.file_summary(endpoints, found)}


def crawl_audit(pages: DataFrame, spec: DataFrame, allowed: Sequence[str] = (),
                blocked: Sequence[str] = (), *, url: str = "url",
                order: str = "page_id") -> DataFrame:
    """Which crawled URLs are in scope, and which are undocumented.

    Validation and scope are row-wise; duplicates are removed by signature
    before the one join with the spec.
    """
    checked, _ = scope.partition_scope(pages.select(F.col(order).alias("ord"),
                                                    F.col(url).alias("url")), allowed, blocked)
    rows = checked.select("ord", "domain", F.lit("GET").alias("method"),
                          urls.path("url").alias("url"))
    unique = inventory.distinct_endpoints(rows)
    return inventory.audit(unique, spec).select("domain", "method", "url", "category")


def verify(endpoints: DataFrame, log: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """Statuses after recorded responses and, with a spec, after the audit."""
    probed = responses.update_status(endpoints, log)
    if spec is None:
        return probed
    audited = inventory.audit(probed, spec)
    return audited.withColumn("status", F.when(F.col("category") == "shadow", F.lit("shadow"))
                              .otherwise(F.col("status"))).drop("match_sig", "category")
