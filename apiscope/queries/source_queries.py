"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from ..sources import feeds, files, sinks, specs
from .registry import query, table


@query("A1_source_scan", """
SELECT page_id, file, CASE WHEN regexp_matches(file, '\\.(js|jsx|mjs|cjs)$') THEN 'javascript'
  WHEN regexp_matches(file, '\\.tsx?$') THEN 'typescript' ELSE 'python' END AS language
FROM paths WHERE regexp_matches(file, '\\.(js|jsx|mjs|cjs|ts|tsx|py)$')
  AND NOT contains(file, 'node_modules') AND NOT contains(file, '__pycache__')""", ("paths",))
def a1(spark, sf):
    return files.source_files(table(spark, sf, "paths"))


@query("A1_source_tree", """
SELECT folder, line, count(*) AS n FROM (
  SELECT CASE page_id % 3 WHEN 0 THEN 'app' ELSE 'lib' END AS folder,
    unnest(string_split(text, chr(10))) AS line
  FROM sources WHERE page_id % 3 <> 1) WHERE line <> '' GROUP BY ALL""", ("sources",))
def a1_tree(spark, sf):
    """Source texts written as files of a tree, a third below a skipped folder, and read again."""
    path = files.work_path(spark, "tree")
    folder = F.when(F.col("page_id") % 3 == 0, "app").when(
        F.col("page_id") % 3 == 1, "node_modules").otherwise("lib")
    table(spark, sf, "sources").select(folder.alias("folder"), "text").write.partitionBy(
        "folder").text(path)
    read = files.read_source_tree(spark, path, extensions=("txt",))
    return read.select(
        F.regexp_extract("file", "folder=([^/]+)", 1).alias("folder"),
        F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy(
        "folder", "line").agg(F.count(F.lit(1)).alias("n"))


@query("A2_language_tag", """
SELECT page_id, CASE lower(split_part(split_part(file, '/', -1), '.', -1))
  WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript'
  WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'pyw' THEN 'python' END AS language
FROM paths""", ("paths",))
def a2(spark, sf):
    return table(spark, sf, "paths").select("page_id", extract.language_of("file").alias("language"))


@query("A3_spec_ingest", """
SELECT spec_id, coalesce(json_extract_string(text, '$.openapi'), json_extract_string(text, '$.swagger'))
    AS version, CASE WHEN spec_id % 3 = 2 THEN 'Unknown specification format' END AS problem,
  CAST(len(json_keys(text, '$.paths')) AS BIGINT) AS n_paths FROM spec_docs""", ("spec_docs",))
def a3(spark, sf):
    return specs.json_spec_documents(table(spark, sf, "spec_docs")).select(
        "spec_id", "version", "problem",
        F.size(F.map_keys("doc.paths")).cast("bigint").alias("n_paths"))


_OPS = """
WITH p AS (SELECT spec_id, CASE WHEN json_extract_string(text, '$.openapi') IS NULL
    THEN coalesce(json_extract_string(text, '$.basePath'), '') ELSE '' END AS prefix,
    unnest(map_entries(CAST(json_extract(text, '$.paths') AS MAP(VARCHAR, JSON)))) AS e FROM spec_docs
  WHERE coalesce(json_extract_string(text, '$.openapi'), json_extract_string(text, '$.swagger')) IS NOT NULL),
m AS (SELECT spec_id, prefix || e.key AS path, unnest(map_entries(CAST(e.value AS MAP(VARCHAR, JSON)))) AS o
  FROM p WHERE json_type(e.value) = 'OBJECT')
SELECT spec_id, path, upper(o.key) AS method,
  coalesce(json_extract_string(o.value, '$.summary'), '') AS summary,
  coalesce(CAST(json_extract(o.value, '$.deprecated') AS BOOLEAN), false) AS deprecated,
  coalesce(array_to_string(CAST(json_extract(o.value, '$.tags') AS VARCHAR[]), ','), '') AS tags
FROM m WHERE o.key IN ('get', 'post', 'put', 'delete', 'patch', 'options', 'head')"""


@query("F26_spec_flattening", _OPS, ("spec_docs",))
def f26(spark, sf):
    docs = specs.json_spec_documents(table(spark, sf, "spec_docs"))
    return specs.spec_endpoints(docs).select(
        "spec_id", "path", "method", "summary", "deprecated", F.array_join("tags", ",").alias("tags"))


@query("A4_report_endpoints", """
SELECT 's' || page_id AS scan_id, 0::BIGINT AS ord, '/api/v1/' || num AS url, 'POST' AS method,
  'verified' AS status, 'a.js' AS file, CAST(v AS BIGINT) AS line FROM page_parts
UNION ALL
SELECT 's' || page_id, 1, '/api/' || lang, 'GET', 'discovered', NULL, NULL FROM page_parts""",
       ("page_parts", "reports"))
def a4(spark, sf):
    reports = feeds.parse_reports(table(spark, sf, "reports"))
    return feeds.report_endpoints(reports).select(
        "scan_id", "ord", "url", "method", "status", F.col("source.file").alias("file"),
        F.col("source.line").cast("bigint").alias("line"))


@query("A4_report_secrets", """
SELECT 's' || page_id AS scan_id, 'k' AS type, num || 'abcdefghijklm' AS value, 'high' AS severity,
  false AS redacted, 'b.js' AS file FROM page_parts""", ("page_parts",))
def a4_secrets(spark, sf):
    reports = feeds.parse_reports(table(spark, sf, "reports"))
    return feeds.report_secrets(reports).select(
        "scan_id", "type", "value", "severity", "redacted", F.col("source.file").alias("file"))


@query("A5_target_list", """
SELECT trim(value) AS target, CASE WHEN starts_with(trim(value), 'http://')
  OR starts_with(trim(value), 'https://') THEN trim(value) ELSE 'https://' || trim(value) END AS target_url
FROM target_lines WHERE trim(value) <> '' AND NOT starts_with(value, '#')""", ("target_lines",))
def a5(spark, sf):
    return files.targets(table(spark, sf, "target_lines"))


@query("A6_capture_index", """
SELECT page_id, '2024' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0') || '15103000' AS timestamp,
  url AS original_url, 'application/javascript' AS mime_type, 200 AS status_code FROM page_parts
UNION ALL
SELECT page_id, '20230101000000', replace(replace(url, 'https://', 'http://'), 'www.', ''), 'text/html',
  CASE WHEN page_id % 4 = 0 THEN 404 ELSE 200 END FROM page_parts
UNION ALL SELECT page_id, 'bad', 'x', 'y', NULL FROM page_parts""", ("page_parts",))
def a6(spark, sf):
    return feeds.captures(table(spark, sf, "capture_index")).drop("host")


@query("A7_certificate_names", """
SELECT host, unnest([upper(host), '*.' || lang || '.' || host, ' not' || domain || ' ', domain])
  AS name_value FROM certificates""", ("certificates",))
def a7(spark, sf):
    return feeds.certificate_names(table(spark, sf, "certificates")).select("host", "name_value")


@query("A8_finding_import", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 't-' || num WHEN 3 THEN '' ELSE 'm' END AS template_id,
  CASE page_id % 5 WHEN 0 THEN 'N ' || lang WHEN 3 THEN 'L' ELSE 'M' END AS name,
  CASE page_id % 5 WHEN 0 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS severity,
  CASE page_id % 5 WHEN 4 THEN '' ELSE host END AS host,
  CASE page_id % 5 WHEN 0 THEN host || '/x' ELSE '' END AS matched_at,
  CASE page_id % 5 WHEN 0 THEN 'a,' || num ELSE '' END AS extracted
FROM page_parts WHERE page_id % 5 IN (0, 3, 4)""", ("page_parts",))
def a8(spark, sf):
    return feeds.findings(table(spark, sf, "finding_lines")).select(
        "page_id", "template_id", "name", "severity", "host", "matched_at",
        F.array_join("extracted_results", ",").alias("extracted"))


@query("A9_response_log", """
SELECT ord, content_type AS value FROM responses""", ("responses",))
def a9(spark, sf):
    raw = table(spark, sf, "responses").select("ord", F.create_map(
        F.lit("CONTENT-Type"), F.lit("overridden"), F.lit("Content-TYPE"), F.col("content_type"),
        F.lit("X-Other"), F.col("server")).alias("headers"))
    return feeds.response_log(raw).select("ord", F.col("headers")["content-type"].alias("value"))


@query("A10_scan_table", """
SELECT scan_id, method, count(*) AS n, min(url) AS first_url FROM inventory GROUP BY 1, 2""",
       ("inventory",))
def a10(spark, sf):
    path = files.work_path(spark, "scan-table")
    sinks.write_scan_table(table(spark, sf, "inventory").select("scan_id", "ord", "method", "url"),
                           path)
    return (sinks.read_scan_table(spark, path).groupBy("scan_id", "method")
            .agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url")))


@query("A10_host_list", "SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages")
def a10_hosts(spark, sf):
    path = files.work_path(spark, "hosts")
    sinks.write_host_list(
        table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")), path)
    return spark.read.text(path).withColumnRenamed("value", "host")


@query("A11_flatten_rebuild", """
SELECT ord, url, method, CASE WHEN status = 'documented' THEN 'discovered' ELSE status END AS status,
  file AS source_file, CAST(line AS BIGINT) AS source_line, CAST(col AS BIGINT) AS source_column
FROM inventory""", ("inventory",))
def a11(spark, sf):
    inv = table(spark, sf, "inventory").select(
        "ord", "url", "method",
        F.when(F.col("status") != "documented", F.col("status")).alias("status"),
        F.struct("file", "line", F.col("col").alias("column"), F.lit("").alias("context"))
        .alias("source"))
    path = files.work_path(spark, "flat")
    sinks.flat_endpoints(inv).write.parquet(path)
    back = sinks.flat_endpoints(sinks.nested_endpoints(sinks.read_scan_table(spark, path)))
    return back.select("ord", "url", "method", "status", "source_file",
                       F.col("source_line").cast("bigint").alias("source_line"),
                       F.col("source_column").cast("bigint").alias("source_column"))


@query("A12_spec_base_url", """
SELECT page_id AS spec_id, CASE page_id % 3 WHEN 0 THEN 'https://' || host || '/' || v
  WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END || '://' || host || '/' || lang
  END AS base_url FROM page_parts""", ("page_parts",))
def a12(spark, sf):
    return specs.json_spec_documents(table(spark, sf, "spec_docs")).select(
        "spec_id", specs.base_url(F.col("doc")).alias("base_url"))
