"""Report tables and documents."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import pii, urls
from ..functions.core import first_case, non_null
from .inventory import last_per


# --- multi-target roll-up ---------------------------------------------------
def target_rollup(results: DataFrame) -> DataFrame:
    """Per-target rows and one total row (``target`` NULL, ``is_total`` 1)."""
    return results.rollup("target").agg(
        F.grouping_id().cast("bigint").alias("is_total"),
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("endpoints_found").alias("endpoints"),
        F.sum("secrets_found").alias("secrets"),
        F.sum("duration_seconds").alias("duration"),
    )


# --- display tables ---------------------------------------------------------
def endpoint_table(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        "method", "url", "status",
        F.coalesce(F.nullif(F.col("http_status"), F.lit(0)).cast("string"), F.lit("-"))
        .alias("http_code"))


def secret_table(secret_rows: DataFrame) -> DataFrame:
    """Secrets with masked values and ``file:line``."""
    return secret_rows.select(
        "type", pii.mask("value").alias("masked"), pii.short_mask("value").alias("short"),
        "severity",
        F.concat(F.substring_index("file", "/", -1), F.lit(":"), F.col("line").cast("string"))
        .alias("location"))


def harvest_totals(assets: DataFrame) -> DataFrame:
    return assets.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scan_totals(files: DataFrame, inventory: DataFrame, secret_rows: DataFrame) -> DataFrame:
    """One row: files, endpoints, verified endpoints and secrets."""
    verified = F.col("http_status").isNotNull()
    return inventory.agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(verified).alias("verified"),
    ).select(
        files.agg(F.count(F.lit(1))).scalar().alias("files"), "endpoints", "verified",
        secret_rows.agg(F.count(F.lit(1))).scalar().alias("secrets"))


# --- OpenAPI ----------------------------------------------------------------
def openapi_operations(inventory: DataFrame, *, order: str = "ord") -> DataFrame:
    """One operation per (path, method), the last endpoint standing."""
    keyed = (inventory.withColumn("path", urls.openapi_path("url"))
             .withColumn("verb", F.lower("method")))
    last = last_per(keyed, ["path", "verb"], order)
    return last.select(
        "path", "verb", "method", "url", "source", "http_status", "status", "query_params",
        _filled(rules.OPERATION_SUMMARY, url=F.col("url")).alias("summary"),
        _description().alias("description"),
        urls.tags("url").alias("tags"),
        urls.path_params("url").alias("path_params"),
        F.col("method").isin("POST", "PUT", "PATCH").alias("has_body"),
    )


def _filled(text: str, **given: Column) -> Column:
    """A fixed text with columns in place of the names in braces; NULL if one is."""
    pieces = re.split(r"\{(\w+)\}", text)
    return F.concat(*[given[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def _description() -> Column:
    """The lines whose columns are all known."""
    given = {"url": F.col("url"), "file": F.col("source.file"), "line": F.col("source.line"),
             "http_status": F.nullif(F.col("http_status"), F.lit(0)), "status": F.col("status")}
    return F.array_join(non_null(*[_filled(t, **given) for t in rules.OPERATION_LINES]), "\n")


def operation_json(ops: DataFrame) -> DataFrame:
    """(path, verb, operation): the operation object as JSON text."""
    def parameter(place: str, required: bool):
        return lambda p: F.struct(
            p.alias("name"), F.lit(place).alias("in"), F.lit(required).alias("required"),
            F.struct(F.lit("string").alias("type")).alias("schema"))

    params = F.concat(
        F.transform("path_params", parameter("path", True)),
        F.transform(F.coalesce("query_params", F.array().cast("array<string>")),
                    parameter("query", False)))
    schema = F.struct(F.struct(F.lit("object").alias("type")).alias("schema"))
    body = F.when(F.col("has_body"),
                  F.struct(F.struct(schema.alias("application/json")).alias("content")))
    return ops.select("path", "verb", F.to_json(F.struct(
        "summary", "description",
        F.struct(F.struct(F.lit("Successful response").alias("description")).alias("200"))
        .alias("responses"),
        "tags",
        F.when(F.size(params) > 0, params).alias("parameters"),
        body.alias("requestBody"),
        F.array(F.map_from_arrays(F.array().cast("array<string>"),
                                  F.array().cast("array<string>"))).alias("security"),
        F.col("source.file").alias("x-discovered-in"),
        F.col("source.line").alias("x-discovered-line"),
    )).alias("operation"))


def path_items(operations: DataFrame) -> DataFrame:
    """(path, item): operations of a path as one JSON object.

    A path has at most one operation per method, so the list stays short.
    """
    entry = F.concat(F.lit('"'), F.col("verb"), F.lit('":'), F.col("operation"))
    return (
        operations.groupBy("path")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("path", F.concat(F.lit("{"), F.array_join("entries", ","), F.lit("}"))
                .alias("item"))
    )


def schema_components(inventory: DataFrame, *, order: str = "ord") -> DataFrame:
    """First body schema per schema name."""
    return (
        inventory.where(F.col("body_schema").isNotNull())
        .withColumn("schema_name", urls.schema_name("url"))
        .where(F.coalesce("schema_name", F.lit("")) != "")
        .groupBy("schema_name").agg(F.min_by("body_schema", F.col(order)).alias("body_schema"))
    )


# --- findings (SARIF) -------------------------------------------------------
def endpoint_level(status: Column) -> Column:
    return F.when(status.isin("zombie", "unprotected"), F.lit("error")).otherwise(F.lit("warning"))


def secret_level(severity: Column) -> Column:
    return (F.when(severity == "low", F.lit("note"))
            .when(severity == "medium", F.lit("warning")).otherwise(F.lit("error")))


def _result(df: DataFrame, keep: Sequence[str], **given: Column) -> DataFrame:
    """SARIF columns of one kind of finding; what is not given is NULL."""
    kinds = {"rule_id": "string", "level": "string", "message": "string", "file": "string",
             "line": "int", "column": "int", "url": "string", "method": "string",
             "http_status": "int", "secret_type": "string", "severity": "string"}
    return df.select(*keep, *[given.get(n, F.lit(None)).cast(k).alias(n)
                              for n, k in kinds.items()])


def findings(inventory: DataFrame | None, secret_rows: DataFrame | None = None,
             ghost_rows: DataFrame | None = None, *, keep: Sequence[str] = ()) -> DataFrame:
    """SARIF result rows of endpoints, secrets and ghosts as one table.

    ``keep`` names columns that all inputs share, such as the scan id.
    """
    c = F.col
    parts = []
    if inventory is not None:
        rule = first_case((c("status") == value, F.lit(r)) for value, r in rules.RULE_OF_STATUS)
        parts.append(_result(
            inventory.withColumn("_rule", rule).where("_rule IS NOT NULL"), keep,
            rule_id=c("_rule"), level=endpoint_level(c("status")),
            message=_filled(rules.ENDPOINT_MESSAGE, status=c("status"), method=c("method"),
                            url=c("url")),
            file=c("file"), line=c("line"), column=c("column"), url=c("url"),
            method=c("method"), http_status=c("http_status")))
    if secret_rows is not None:
        parts.append(_result(
            secret_rows, keep, rule_id=F.lit(rules.SECRET_RULE), level=secret_level(c("severity")),
            message=_filled(rules.SECRET_MESSAGE, type=c("type")), file=c("file"),
            line=c("line"), column=c("column"), secret_type=c("type"), severity=c("severity")))
    if ghost_rows is not None:
        parts.append(_result(
            ghost_rows, keep, rule_id=F.lit(rules.GHOST_RULE), level=F.lit("note"),
            message=_filled(rules.GHOST_MESSAGE, method=c("method"), path=c("path"))))
    return reduce(DataFrame.unionByName, parts)


def finding_json(rows: DataFrame) -> DataFrame:
    """Adds ``result``: the SARIF result object of each row as JSON text."""
    location = F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
        .alias("region")).alias("physicalLocation"))
    locations = F.when(F.col("file").isNotNull(), F.array(location)) \
        .otherwise(F.filter(F.array(location), lambda _: F.lit(False)))
    props = F.when(F.col("rule_id") != rules.GHOST_RULE, F.struct(
        "url", "method", F.col("http_status").alias("httpStatus"),
        F.col("secret_type").alias("secretType"), "severity"))
    return rows.withColumn("result", F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        locations.alias("locations"), props.alias("properties"))))


_RESULT_ORDER = ["rule_id", "file", "line", "column", "message", "result"]


def sarif_document(scans: DataFrame, inventory: DataFrame | None,
                   secret_rows: DataFrame | None = None, ghost_rows: DataFrame | None = None, *,
                   scan: str = "scan_id") -> DataFrame:
    """SARIF documents of endpoints, secrets and ghosts, one for each row of ``scans``.

    The results need no numbers: equal ones are one, and they stand in the
    order of rule, place and message.
    """
    return sarif_lines(findings(inventory, secret_rows, ghost_rows, keep=[scan]), scans, scan=scan)


def sarif_lines(rows: DataFrame, scans: DataFrame, *, scan: str = "scan_id") -> DataFrame:
    """SARIF documents as ordered text lines (scan, part, key, line).

    A document may hold more results than one task can, so it is never built
    as one value: each result is a line, the head and the tail come from the
    scan table, and the lines in (part, key) order are the document.  ``rows``
    are `findings` with the scan column; ``scans`` has started_at, completed_at
    and the number of errors.
    """
    head, tail = _sarif_frame()
    key = F.struct(*_RESULT_ORDER)
    body = finding_json(rows).select(scan, "result", key.alias("key")).distinct()
    # the one result without a comma before it; a scan's least key, reduced in every task
    first = body.groupBy(scan).agg(F.min("key").alias("_first"))
    results = body.join(first, scan).select(
        scan, F.lit(1).alias("part"), "key",
        F.concat(F.when(F.col("key") == F.col("_first"), F.lit("")).otherwise(F.lit(",")),
                 F.col("result")).alias("line"))

    def iso(ts: Column) -> Column:
        return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))

    invocation = F.to_json(F.struct(
        (F.coalesce("errors", F.lit(0)) == 0).alias("executionSuccessful"),
        iso(F.col("started_at")).alias("startTimeUtc"),
        iso(F.col("completed_at")).alias("endTimeUtc")))
    none = F.lit(None).cast(body.schema["key"].dataType).alias("key")
    heads = scans.select(scan, F.lit(0).alias("part"), none, F.lit(head).alias("line"))
    tails = scans.select(scan, F.lit(2).alias("part"), none, F.concat(
        F.lit(tail), invocation, F.lit("]}]}")).alias("line"))
    return heads.unionByName(results).unionByName(tails)


def _sarif_frame() -> tuple[str, str]:
    listed = [
        {"id": i, "name": n, "shortDescription": {"text": d},
         "defaultConfiguration": {"level": lv}, "properties": {"tags": list(tg)}}
        for i, n, d, lv, tg in rules.SARIF_RULES
    ]
    driver = json.dumps({"name": "apiscope", "version": "1.0.0", "rules": listed})
    head = ('{"$schema":' + json.dumps(rules.SARIF_SCHEMA) + ',"version":"' + rules.SARIF_VERSION
            + '","runs":[{"tool":{"driver":' + driver + '},"results":[')
    return head, '],"invocations":['


def openapi_lines(items: DataFrame, *, title: str = "Discovered API", version: str = "1.0.0",
                  server_url: str | None = None,
                  components: DataFrame | None = None) -> DataFrame:
    """One OpenAPI document as ordered text lines (part, key, line).

    ``key`` is the path (or schema name), so the lines sort without a global
    numbering; every path line but the smallest starts with a comma.
    """
    head = {"openapi": "3.0.3", "info": {"title": title, "version": version}}
    if server_url:
        head["servers"] = [{"url": server_url}]
    spark = items.sparkSession

    def block(df: DataFrame, name: str, value: str, part: int) -> DataFrame:
        smallest = df.agg(F.min(name)).scalar()
        return df.select(
            F.lit(part).alias("part"), F.col(name).alias("key"),
            F.concat(F.when(F.col(name) == smallest, F.lit("")).otherwise(F.lit(",")),
                     F.regexp_replace(F.to_json(F.struct(F.col(name).alias("k"))),
                                      r'^\{"k":|\}$', ""),
                     F.lit(":"), F.col(value)).alias("line"))

    def fixed(part: int, line: str) -> DataFrame:
        return spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"),
                                     F.lit(line).alias("line"))

    lines = fixed(0, json.dumps(head)[:-1] + ',"paths":{').unionByName(
        block(items, "path", "item", 1))
    if components is None:
        return lines.unionByName(fixed(2, "}}"))
    return (lines.unionByName(fixed(2, '},"components":{"schemas":{'))
            .unionByName(block(components, "schema_name", "body_schema", 3))
            .unionByName(fixed(4, "}}}")))
