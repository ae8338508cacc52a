"""Recorded responses joined with, and summed over, the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses as r
from .inventory import first_per


def classify_responses(log: DataFrame, *, body_chars: int | None = None) -> DataFrame:
    """Adds category, flags, notes and deprecation columns to a response log."""
    return (
        log.withColumn("_c", r.classify("status_code", "headers", "body", body_chars))
        .select("*", "_c.*").drop("_c")
        .withColumn("is_deprecated", r.is_deprecated("headers"))
        .withColumn("deprecation_date", r.http_date(r.header("headers", "deprecation")))
        .withColumn("sunset_date", r.http_date(r.header("headers", "sunset")))
    )


def update_status(inventory: DataFrame, log: DataFrame, *, order: str = "ord") -> DataFrame:
    """Endpoint status after its recorded response.

    ``log`` has method, url, success, http_status, has_deprecation_header and
    an order column; the last record of an endpoint counts.  Endpoints without
    a record keep their status.
    """
    keyed = log.select(
        F.col("method"), F.col("url"), F.col(order).alias("_o"), "success",
        F.col("http_status").alias("_code"), F.col("has_deprecation_header").alias("_dep"))
    latest = (keyed.groupBy("method", "url")
              .agg(F.max_by(F.struct("success", "_code", "_dep"), "_o").alias("_p")))
    new = r.probed_status(F.col("status"), F.col("_p.success"), F.col("_p._code"),
                          F.coalesce("_p._dep", F.lit(False)))
    return (
        inventory.join(latest, ["method", "url"], "left")
        .withColumn("status", F.when(F.col("_p").isNull(), F.col("status")).otherwise(new))
        .withColumn("http_status", F.when(F.coalesce("_p.success", F.lit(False)),
                                          F.coalesce("_p._code", "http_status"))
                    .otherwise(F.col("http_status")))
        .drop("_p")
    )


def response_summary(log: DataFrame) -> DataFrame:
    """Active, protected, dead and zombie-candidate counts of a log."""
    code, ok = F.col("http_status"), F.col("success")
    return log.agg(
        F.count(F.lit(1)).alias("probed"),
        F.count_if(ok & (code < 400)).alias("active"),
        F.count_if(code.isin(401, 403)).alias("protected"),
        F.count_if(~ok | (code == 404)).alias("dead"),
        F.count_if(F.col("has_deprecation_header")).alias("zombies"),
    )


def active_urls(log: DataFrame) -> DataFrame:
    return log.where(F.col("success") & (F.col("http_status") < 400)).select("method", "url")


def response_differences(baseline: DataFrame, variants: DataFrame, *, order: str = "ord",
                         threshold: float = 0.05) -> DataFrame:
    """Variants whose status, or else size by more than the threshold, differs.

    Both sides carry endpoint, status_code and length; the first baseline of
    an endpoint counts.  An empty baseline yields no size difference.
    """
    base = first_per(baseline.select("endpoint", F.col("status_code").alias("base_status"),
                                     F.col("length").alias("base_length"),
                                     F.col(order).alias("_o")), ["endpoint"], "_o").drop("_o")
    change = r.size_change(F.col("base_length"), F.col("length"))
    text = (
        F.when(F.col("status_code") != F.col("base_status"),
               F.concat(F.lit("Status code changed: "), F.col("base_status").cast("string"),
                        F.lit(" -> "), F.col("status_code").cast("string")))
        .when(change > threshold,
              F.concat(F.lit("Response size changed significantly ("),
                       F.floor(change * 100).cast("string"), F.lit("%)")))
    )
    return (variants.join(base, "endpoint").withColumn("description", text)
            .where(F.col("description").isNotNull()))


def reflected(log: DataFrame) -> DataFrame:
    """One row per sensitive field that a successful response reflects."""
    return log.select("*", F.explode(r.reflected_fields("status_code", "body"))
                      .alias("parameter"))


def graphql_operations(documents: DataFrame, *, key: str = "url",
                       text: str = "schema_json") -> DataFrame:
    """Query and mutation fields of introspection documents.

    Root type names default to Query and Mutation; a type named as both counts
    as query.
    """
    ref = "struct<name:string>"
    schema = (
        f"struct<queryType:{ref},mutationType:{ref},types:array<struct<name:string,"
        "fields:array<struct<name:string,args:array<struct<name:string,type:struct<name:string>>>,"
        "type:struct<name:string>>>>>>"
    )
    doc = documents.select(F.col(key), F.from_json(F.col(text), schema).alias("d"))
    typed = doc.select(
        key,
        F.coalesce("d.queryType.name", F.lit("Query")).alias("q"),
        F.coalesce("d.mutationType.name", F.lit("Mutation")).alias("m"),
        F.explode("d.types").alias("t"))
    kind = F.when(F.col("t.name") == F.col("q"), F.lit("query")).when(
        F.col("t.name") == F.col("m"), F.lit("mutation"))
    return (
        typed.withColumn("type", kind).where(F.col("type").isNotNull())
        .select(key, "type", F.explode("t.fields").alias("f"))
        .select(
            key, F.col("f.name").alias("name"), "type",
            F.coalesce(F.transform("f.args", lambda a: F.struct(
                a["name"].alias("name"), a["type"]["name"].alias("type"))),
                F.array().cast("array<struct<name:string,type:string>>")).alias("args"),
            F.col("f.type.name").alias("return_type"))
    )


def graphql_candidates(bases: DataFrame, paths, *, base: str = "base_url") -> DataFrame:
    """Well-known GraphQL paths under every base, as an explode of a literal list."""
    listed = F.array(*[F.lit(p) for p in paths])
    return bases.select("*", F.explode(listed).alias("graphql_path")).withColumn(
        "candidate", F.concat(F.regexp_replace(F.col(base), r"/+$", ""), F.col("graphql_path")))
