"""API specifications: OpenAPI 3 and Swagger 2, JSON or YAML."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.core import let

_DOC = (
    "struct<openapi:string,swagger:string,basePath:string,host:string,"
    "schemes:array<string>,servers:array<struct<url:string>>,"
    "paths:map<string,string>>"
)


def yaml_to_json(docs: DataFrame, *, key: str = "spec_id", text: str = "text") -> DataFrame:
    """(key, text) with YAML text turned into JSON text, whole documents.

    Spark reads no YAML, so this one step runs in Python over Arrow batches;
    a document that is no YAML, or nothing that JSON can hold, gives NULL.
    """
    import pandas as pd

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def one(doc: str | None) -> str | None:
            try:
                return None if doc is None else json.dumps(yaml.safe_load(doc), default=str)
            except (yaml.YAMLError, TypeError, ValueError, RecursionError):
                return None

        for pdf in batches:
            yield pdf.assign(**{text: pdf[text].map(one)})

    picked = docs.select(key, text)
    return picked.mapInPandas(convert, picked.schema)


def spec_documents(docs: DataFrame, *, key: str = "spec_id", text: str = "text",
                   fmt: str = "format") -> DataFrame:
    """(key, doc, version, problem) from (key, format, text).

    The operations of a path stay JSON text, so any operation content passes.
    """
    is_yaml = F.lower(F.col(fmt)).isin("yaml", "yml")
    as_json = docs.where(~is_yaml).select(key, text).unionByName(
        yaml_to_json(docs.where(is_yaml), key=key, text=text))
    return json_spec_documents(as_json, key=key, text=text)


def json_spec_documents(docs: DataFrame, *, key: str = "spec_id",
                        text: str = "text") -> DataFrame:
    """As ``spec_documents`` for a table that is known to be JSON."""
    parsed = docs.select(key, F.from_json(text, _DOC).alias("doc"))
    version = F.coalesce("doc.openapi", "doc.swagger")
    return parsed.withColumn("version", version).withColumn(
        "problem", F.when(version.isNull(), F.lit("Unknown specification format")))


def spec_endpoints(parsed: DataFrame, *, key: str = "spec_id") -> DataFrame:
    """One row per operation: path, method, summary, deprecated, tags, ord.

    ``ord`` follows the document (path position, then method list position);
    path items that are no objects are skipped.
    """
    methods = [m.lower() for m in rules.HTTP_METHODS[:5]] + ["options", "head"]
    prefix = F.when(F.col("doc.openapi").isNull(), F.coalesce("doc.basePath", F.lit(""))) \
        .otherwise(F.lit(""))
    paths = (
        parsed.where(F.col("version").isNotNull())
        .select(key, prefix.alias("_prefix"),
                F.posexplode(F.map_entries("doc.paths")).alias("_ppos", "e"))
        .select(key, "_prefix", "_ppos", F.col("e.key").alias("_path"),
                F.from_json(F.col("e.value"), "map<string,string>").alias("_item"))
        .where(F.col("e.value").startswith("{"))
    )
    listed = F.filter(
        F.array(*[F.struct(F.lit(i).alias("mpos"), F.lit(m).alias("verb"),
                           F.try_element_at("_item", F.lit(m)).alias("op"))
                  for i, m in enumerate(methods)]),
        lambda x: x["op"].isNotNull())
    op = F.from_json("m.op", "struct<summary:string,deprecated:boolean,tags:array<string>>")
    return (
        paths.select(key, "_prefix", "_ppos", "_path", F.explode(listed).alias("m"))
        .withColumn("_o", op)
        .select(
            key, (F.col("_ppos") * 10 + F.col("m.mpos")).cast("bigint").alias("ord"),
            F.concat("_prefix", "_path").alias("path"),
            F.upper("m.verb").alias("method"),
            F.coalesce("_o.summary", F.lit("")).alias("summary"),
            F.coalesce("_o.deprecated", F.lit(False)).alias("deprecated"),
            F.coalesce("_o.tags", F.array().cast("array<string>")).alias("tags"))
    )


def base_url(doc: Column) -> Column:
    """First server URL, else scheme://host+basePath, else NULL."""
    return let(doc, lambda d: (
        F.when(F.size(d["servers"]) > 0,
               F.coalesce(F.get(d["servers"], 0)["url"], F.lit("")))
        .when(d["servers"].isNull() & d["host"].isNotNull(), F.concat(
            F.coalesce(F.get(d["schemes"], 0), F.lit("https")), F.lit("://"), d["host"],
            F.coalesce(d["basePath"], F.lit(""))))))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """(spec_id, format, text) of specification files, whole files."""
    files = (spark.read.text(path, wholetext=True, recursiveFileLookup=True)
             .select("value", F.col("_metadata.file_path").alias("spec_id")))
    return files.select(
        "spec_id", F.when(F.lower("spec_id").rlike(r"\.ya?ml$"), F.lit("yaml"))
        .otherwise(F.lit("json")).alias("format"), F.col("value").alias("text"))
