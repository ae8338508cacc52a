"""Stored feeds: scan reports, capture indexes, certificate names, findings,
response logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

LOCATION = "struct<file:string,line:int,column:int,context:string>"
ENDPOINT = (
    f"struct<url:string,method:string,source:{LOCATION},discovered_at:string,"
    "path_params:array<string>,query_params:array<string>,headers:map<string,string>,"
    "body_schema:string,status:string,http_status:int,response_time_ms:double,"
    "content_type:string,deprecation_date:string,sunset_date:string>"
)
SECRET = f"struct<type:string,value:string,source:{LOCATION},severity:string,redacted:boolean>"
REPORT = (
    "scan_id string, target string, started_at string, completed_at string, "
    "duration_seconds double, dry_run boolean, total_files_scanned int, "
    "total_endpoints_discovered int, total_endpoints_verified int, "
    f"endpoints array<{ENDPOINT}>, secrets array<{SECRET}>, "
    "errors array<string>, warnings array<string>"
)
FINDING = (
    "`template-id` string, info struct<name:string,severity:string,description:string>, "
    "host string, `matched-at` string, `extracted-results` array<string>, "
    "`curl-command` string, _bad string"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Scan reports, one JSON document per file, with a fixed schema."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def parse_reports(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """As ``read_reports`` for documents held in a text column."""
    return docs.select("*", F.from_json(text, _as_struct(REPORT)).alias("_r")) \
        .select(*docs.columns, "_r.*").drop(text)


def _as_struct(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


def report_endpoints(reports: DataFrame) -> DataFrame:
    """One row per endpoint, defaults of method and status filled in."""
    return (
        reports.select("scan_id", F.posexplode("endpoints").alias("ord", "e"))
        .select("scan_id", F.col("ord").cast("bigint").alias("ord"), "e.*")
        .withColumn("method", F.coalesce("method", F.lit("GET")))
        .withColumn("status", F.coalesce("status", F.lit("discovered")))
    )


def report_secrets(reports: DataFrame) -> DataFrame:
    return (
        reports.select("scan_id", F.posexplode("secrets").alias("ord", "s"))
        .select("scan_id", F.col("ord").cast("bigint").alias("ord"), "s.*")
        .withColumn("severity", F.coalesce("severity", F.lit("high")))
        .withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    )


def report_errors(reports: DataFrame) -> DataFrame:
    return reports.select("scan_id", F.explode("errors").alias("error"))


def captures(index: DataFrame, *, text: str = "json") -> DataFrame:
    """Rows of capture indexes: arrays of arrays, header first, short rows dropped."""
    rows = F.from_json(text, "array<array<string>>")
    body = F.filter(rows, lambda r, i: (i > 0) & (F.size(r) >= 4))
    return (
        index.select(*[c for c in index.columns if c != text], F.explode(body).alias("r"))
        .withColumn("timestamp", F.col("r")[0])
        .withColumn("original_url", F.col("r")[1])
        .withColumn("mime_type", F.col("r")[2])
        .withColumn("status_code", F.col("r")[3].try_cast("int"))
        .drop("r")
    )


def certificate_names(entries: DataFrame, *, text: str = "json") -> DataFrame:
    """One row per name of certificate entries (names are split by line)."""
    parsed = F.from_json(text, "array<struct<name_value:string>>")
    others = [c for c in entries.columns if c != text]
    return (
        entries.select(*others, F.explode(parsed).alias("e"))
        .select(*others, F.explode(F.split("e.name_value", "\n", -1)).alias("name_value"))
    )


def findings(lines: DataFrame, *, line: str = "value",
             severities: Sequence[str] | None = rules.FINDING_SEVERITIES) -> DataFrame:
    """Findings from JSON lines: bad lines skipped, missing keys empty."""
    parsed = F.from_json(F.trim(line), FINDING,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    others = [c for c in lines.columns if c != line]
    rows = lines.select(*others, parsed.alias("f")).where(
        F.col("f").isNotNull() & F.col("f._bad").isNull())

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    out = rows.select(
        *others,
        text("f.`template-id`").alias("template_id"), text("f.info.name").alias("name"),
        text("f.info.severity").alias("severity"), text("f.host").alias("host"),
        text("f.`matched-at`").alias("matched_at"),
        F.coalesce("f.`extracted-results`", F.array().cast("array<string>"))
        .alias("extracted_results"),
        text("f.`curl-command`").alias("curl_command"),
        text("f.info.description").alias("description"))
    return out if severities is None else out.where(F.lower("severity").isin(*severities))


def read_findings(spark: SparkSession, path: str, **options) -> DataFrame:
    return findings(spark.read.text(path), **options)


def response_log(raw: DataFrame, *, headers: str = "headers") -> DataFrame:
    """Header names lower-cased; of names that then collide, the last stands."""
    entries = F.map_entries(F.col(headers))
    folded = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"),
                                                     e["value"].alias("v")))
    last = F.filter(folded, lambda e, i: ~F.exists(
        F.slice(folded, i + 2, F.size(folded)), lambda later: later["k"] == e["k"]))
    return raw.withColumn(headers, F.map_from_entries(last))
