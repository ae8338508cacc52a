"""Joins, aggregates, windows and reports (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import inventory, ratelimit, report, scantree, scope
from ..plans import stages
from ..sources import feeds, sinks
from ..sources.files import work_path
from .registry import query, table
from .text_queries import SECRETS, _secrets
from .url_queries import (ALLOWED, BLOCKED, MATCH, OPENAPI, OPENAPI_FROM, SCHEMA_NAME, SIGNATURE,
                          SPEC_SIG, TAGS, host, path, scope_reason)

INV = ("inventory",)
BOTH = ("inventory", "spec")


def inv(spark, sf):
    return table(spark, sf, "inventory")


@query("F1_distinct_signature", f"""
SELECT {SIGNATURE} AS signature, min(ord) AS ord, arg_min(url, ord) AS url,
  arg_min(status, ord) AS status FROM inventory GROUP BY 1""", INV)
def f1(spark, sf):
    return inventory.distinct_endpoints(inv(spark, sf)).select("signature", "ord", "url", "status")


_SPEC = (f"(SELECT {SPEC_SIG} AS sig, arg_max(deprecated, ord) AS dep, arg_max(method, ord) AS method,"
         f" arg_max(path, ord) AS path FROM spec GROUP BY 1)")
_AUDIT = f"""
SELECT i.*, CASE WHEN s.sig IS NULL THEN 'shadow' WHEN s.dep THEN 'zombie' ELSE 'documented' END AS category
FROM (SELECT *, {MATCH} AS msig FROM inventory) i LEFT JOIN {_SPEC} s ON s.sig = i.msig"""
_GHOSTS = f"""
SELECT method, path FROM {_SPEC} s WHERE sig NOT IN (SELECT {MATCH} FROM inventory)"""


@query("F2_audit", f"SELECT ord, url, method, category FROM ({_AUDIT})", BOTH)
def f2(spark, sf):
    return inventory.audit(inv(spark, sf), table(spark, sf, "spec")).select(
        "ord", "url", "method", "category")


@query("F2_audit_strip_host", f"""
SELECT i.ord, CASE WHEN s.sig IS NULL THEN 'shadow' WHEN s.dep THEN 'zombie' ELSE 'documented' END
  AS category FROM (SELECT ord, {MATCH} AS msig FROM (SELECT ord, method,
  regexp_replace(url, '^https?://[^/]+', '') AS url FROM inventory)) i
LEFT JOIN {_SPEC} s ON s.sig = i.msig""", BOTH)
def f2_strip(spark, sf):
    return inventory.audit(inv(spark, sf), table(spark, sf, "spec"), strip_host=True).select(
        "ord", "category")


@query("F3_ghosts", _GHOSTS, BOTH)
def f3(spark, sf):
    return inventory.ghosts(inv(spark, sf), table(spark, sf, "spec")).select("method", "path")


@query("F4_audit_summary", f"""
SELECT c AS category, count(a.category) AS n
FROM (SELECT unnest(['documented', 'shadow', 'ghost', 'zombie']) AS c)
LEFT JOIN (SELECT category FROM ({_AUDIT}) UNION ALL SELECT 'ghost' FROM ({_GHOSTS})) a
  ON a.category = c GROUP BY 1""", BOTH)
def f4(spark, sf):
    return inventory.audit_summary(inventory.audit_rows(inv(spark, sf), table(spark, sf, "spec")))


# two scans of the crawl: what was served over http, and what over https
_SIDES = """
sides AS (SELECT page_id AS ord, starts_with(url, 'https:') AS cur,
    'GET:/' || lang || '/' || CAST(CAST(num AS BIGINT) % 200 AS STRING) AS signature,
    CASE WHEN length(html) % 2 = 0 THEN 'verified' ELSE 'dead' END AS status,
    CASE WHEN page_id % 3 = 0 THEN NULL ELSE length(html) % 5 END AS http_status,
    false AS deprecated FROM page_parts),
b AS (SELECT signature, arg_max(status, ord) AS status, max(ord) AS ord,
    arg_max(coalesce(http_status, -1), ord) AS hs FROM sides WHERE NOT cur GROUP BY 1),
c AS (SELECT signature, arg_max(status, ord) AS status, max(ord) AS ord,
    arg_max(coalesce(http_status, -1), ord) AS hs FROM sides WHERE cur GROUP BY 1),
d AS (SELECT coalesce(b.signature, c.signature) AS signature, CASE WHEN b.ord IS NULL THEN 'added'
    WHEN c.ord IS NULL THEN 'removed' WHEN b.status = c.status AND b.hs = c.hs THEN 'unchanged'
    ELSE 'changed' END AS change_type, b.ord AS before_ord, c.ord AS after_ord
  FROM b FULL JOIN c ON b.signature = c.signature)"""


def scans(spark, sf):
    n = F.length("html")
    rows = table(spark, sf, "page_parts").select(
        F.col("page_id").alias("ord"), "url", F.lit("GET").alias("method"),
        F.concat(F.lit("/"), "lang", F.lit("/"), (F.col("num").cast("bigint") % 200).cast("string"))
        .alias("path"),
        F.when(n % 2 == 0, F.lit("verified")).otherwise(F.lit("dead")).alias("status"),
        F.when(F.col("page_id") % 3 != 0, n % 5).alias("http_status"),
        F.lit(False).alias("deprecated"))
    secure = F.col("url").startswith("https:")
    keep = ["ord", F.col("path").alias("url"), "method", "status", "http_status", "deprecated"]
    return rows.where(~secure).select(*keep), rows.where(secure).select(*keep)


@query("F5_scan_diff", f"WITH {_SIDES} SELECT * FROM d", ("page_parts",))
def f5(spark, sf):
    return inventory.compare_scans(*scans(spark, sf)).select(
        "signature", "change_type", F.col("before.ord").alias("before_ord"),
        F.col("after.ord").alias("after_ord"))


@query("F5_diff_counts", f"WITH {_SIDES} SELECT change_type, count(*) AS n FROM d GROUP BY 1",
       ("page_parts",))
def f5_counts(spark, sf):
    return inventory.compare_scans(*scans(spark, sf)).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("n"))


def stored_scans(spark, sf):
    """Both scans stored with their trees; pages of one language change together."""
    paths = [work_path(spark, f"scan-{n}") for n in ("before", "after")]
    for scan, where in zip(scans(spark, sf), paths, strict=True):
        scantree.store_scan(scan, where, cluster=lambda u: F.split_part(u, F.lit("/"), F.lit(2)))
    return paths


@query("F5_stored_changes", f"WITH {_SIDES} SELECT * FROM d WHERE change_type <> 'unchanged'",
       ("page_parts",))
def f5_stored(spark, sf):
    return scantree.stored_changes(spark, *stored_scans(spark, sf)).select(
        "signature", "change_type", F.col("before.ord").alias("before_ord"),
        F.col("after.ord").alias("after_ord"))


@query("F5_stored_counts", f"WITH {_SIDES} SELECT change_type, count(*) AS n FROM d GROUP BY 1",
       ("page_parts",))
def f5_stored_counts(spark, sf):
    return scantree.stored_change_counts(spark, *stored_scans(spark, sf))


@query("F6_secret_delta", f"""
SELECT greatest(n, 0) AS secrets_added, greatest(-n, 0) AS secrets_removed FROM (
  SELECT CAST(coalesce(sum(CASE WHEN lang = 'en' THEN 1 ELSE -1 END), 0) AS BIGINT) AS n
  FROM ({SECRETS}) s JOIN documents d USING (doc_id))""")
def f6(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "lang")
    tagged = _secrets(spark, sf).join(docs, "file")
    return inventory.secret_delta(tagged.where("lang <> 'en'"), tagged.where("lang = 'en'"))


@query("F7_diff_digest", f"""
WITH {_SIDES}
SELECT change_type, signature, rank, greatest(total - 10, 0) AS remaining FROM (
  SELECT change_type, signature, row_number() OVER (PARTITION BY change_type ORDER BY signature) AS rank,
    count(*) OVER (PARTITION BY change_type) AS total FROM d WHERE change_type IN ('added', 'removed'))
WHERE rank <= 10""", ("page_parts",))
def f7(spark, sf):
    return inventory.diff_digest(inventory.compare_scans(*scans(spark, sf))).select(
        "change_type", "signature", F.col("rank").cast("bigint").alias("rank"), "remaining")


@query("F8_scan_summary", """
SELECT 's' || page_id AS scan_id, host AS target, CAST(num || '.5' AS DOUBLE) AS duration_seconds,
  'discovered=1,verified=1' AS by_status, 1::BIGINT AS secrets_found, 2::BIGINT AS errors
FROM page_parts""", ("page_parts",))
def f8(spark, sf):
    reports = feeds.parse_reports(table(spark, sf, "reports"))
    got = inventory.scan_summary(
        reports.select("scan_id", "target", "duration_seconds"), feeds.report_endpoints(reports),
        feeds.report_secrets(reports), feeds.report_errors(reports))
    return got.select("scan_id", "target", "duration_seconds", F.array_join(F.transform(
        F.map_entries("by_status"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
        .alias("by_status"), "secrets_found", "errors")


@query("F8_status_counts", "SELECT status, count(*) AS n FROM inventory GROUP BY 1", INV)
def f8_counts(spark, sf):
    return inventory.status_counts(inv(spark, sf))


@query("F9_target_rollup", """
SELECT target, CAST(grouping(target) AS BIGINT) AS is_total, count(*) AS targets,
  count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  CAST(sum(endpoints_found) AS BIGINT) AS endpoints, CAST(sum(secrets_found) AS BIGINT) AS secrets,
  CAST(sum(duration_seconds) AS BIGINT) AS duration
FROM target_results GROUP BY ROLLUP (target)""", ("target_results",))
def f9(spark, sf):
    return report.target_rollup(table(spark, sf, "target_results"))


@query("F10_capture_selection", """
WITH c AS (SELECT '2024' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0') || '15103000' AS timestamp,
    url AS original_url FROM page_parts UNION ALL
  SELECT '20230101000000', replace(replace(url, 'https://', 'http://'), 'www.', '') FROM page_parts
  WHERE page_id % 4 <> 0)
SELECT url_key, r.timestamp AS timestamp, r.original_url AS original_url FROM (
  SELECT regexp_replace(lower(original_url), '^https?://(?:www\\d*\\.)?', '') AS url_key,
    min({timestamp: timestamp, original_url: original_url}) AS r FROM c
  WHERE left(timestamp, 8) BETWEEN '20221212' AND '20241201' GROUP BY 1)""".replace("{timestamp:", "{'timestamp':").replace(", original_url:", ", 'original_url':"),
       ("page_parts",))
def f10(spark, sf):
    captures = feeds.captures(table(spark, sf, "capture_index"))
    return inventory.select_captures(captures, F.lit("2024-12-01").cast("date")).select(
        "url_key", "timestamp", "original_url")


@query("F11_subdomains", """
WITH n AS (SELECT domain, regexp_replace(lower(trim(unnest(string_split(name_value, chr(10))))),
    '^\\*\\.', '') AS host FROM cert_names)
SELECT DISTINCT domain, host FROM n WHERE ends_with(host, '.' || domain) AND host <> domain""",
       ("cert_names",))
def f11(spark, sf):
    return scope.subdomains(table(spark, sf, "cert_names"))


@query("F11_subdomains_suffix", """
WITH n AS (SELECT domain, regexp_replace(lower(trim(unnest(string_split(name_value, chr(10))))),
    '^\\*\\.', '') AS host FROM cert_names)
SELECT DISTINCT domain, host FROM n WHERE ends_with(host, domain) AND host <> domain""",
       ("cert_names",))
def f11_suffix(spark, sf):
    return scope.subdomains(table(spark, sf, "cert_names"), dot_boundary=False)


@query("F12_hosts_in_scope", f"""
SELECT DISTINCT {host('url')} AS host FROM pages WHERE {scope_reason('url')} = ''""")
def f12(spark, sf):
    hosts = table(spark, sf, "pages").select(urls.host("url").alias("host")).distinct()
    return scope.hosts_in_scope(hosts, ALLOWED, BLOCKED)


@query("F13_distinct_assets", """
SELECT url, min(ord) AS ord, arg_min(kind, ord) AS kind FROM assets GROUP BY 1""", ("assets",))
def f13(spark, sf):
    return inventory.distinct_assets(table(spark, sf, "assets")).select("url", "ord", "kind")


def operations(spark, sf):
    rows = inv(spark, sf).withColumn("source", F.struct("file", "line")).withColumn(
        "query_params", F.when(F.col("ord") % 2 == 0, F.array(F.lit("q"), F.col("method"))))
    return report.openapi_operations(rows)


_LAST_OPS = f"""
ops AS (SELECT path, lower(method) AS verb, max(ord) AS ord FROM (
  SELECT {OPENAPI} AS path, method, ord FROM {OPENAPI_FROM}) GROUP BY 1, 2)"""


@query("F14_spec_rows", f"""
WITH {_LAST_OPS} SELECT path, verb, url FROM ops JOIN inventory USING (ord)""", INV)
def f14(spark, sf):
    return operations(spark, sf).select("path", "verb", "url")


@query("F14_path_items", f"""
WITH {_LAST_OPS} SELECT path, count(*) AS operations, min(verb) AS first_verb,
  string_agg(DISTINCT verb, ',' ORDER BY verb) AS verbs FROM ops GROUP BY 1""", INV)
def f14_items(spark, sf):
    items = report.path_items(report.operation_json(operations(spark, sf)))
    verbs = F.json_object_keys("item")
    return items.select("path", F.size(verbs).cast("bigint").alias("operations"),
                        F.array_min(verbs).alias("first_verb"),
                        F.array_join(F.array_sort(verbs), ",").alias("verbs"))


@query("F15_operation_object", f"""
WITH {_LAST_OPS}
SELECT path, verb, 'Discovered endpoint at ' || url AS summary,
  CASE WHEN t = '' THEN 'Discovered' ELSE t END AS tags,
  '**Auto-discovered endpoint**' || chr(10) || chr(10) || '- **URL**: `' || url || '`' || chr(10)
  || '- **Found in**: `' || file || ':' || line || '`' || chr(10)
  || coalesce('- **Verified status**: ' || http_status || chr(10), '')
  || '- **Classification**: ' || status || chr(10) || chr(10)
  || '> This endpoint was discovered automatically and may not be fully documented.' AS description,
  verb IN ('post', 'put') AS has_body, file AS found_in, CAST(line AS BIGINT) AS found_line,
  CASE WHEN ord % 2 = 0 THEN 'q,' || method ELSE '' END AS query_names,
  array_to_string(list_transform(regexp_extract_all(url, '\\{{[^}}]+\\}}|:[a-zA-Z_]+|<[^>]+>'),
    lambda m: CASE WHEN starts_with(m, ':') THEN substr(m, 2) ELSE substr(m, 2, length(m) - 2) END),
    ',') AS path_names
FROM (SELECT *, {TAGS} AS t FROM ops JOIN inventory USING (ord))""", INV)
def f15(spark, sf):
    ops = report.operation_json(operations(spark, sf))
    schema = ("summary string, description string, tags array<string>, "
              "parameters array<struct<name:string,`in`:string>>, requestBody string, "
              "`x-discovered-in` string, `x-discovered-line` bigint")
    o = ops.select("path", "verb", F.from_json("operation", schema).alias("o"))

    def names(place: str):
        return F.array_join(F.transform(
            F.filter(F.coalesce("o.parameters", F.array().cast(
                "array<struct<name:string,`in`:string>>")), lambda p: p["in"] == place),
            lambda p: p["name"]), ",")

    return o.select(
        "path", "verb", "o.summary", F.array_join("o.tags", ",").alias("tags"), "o.description",
        F.col("o.requestBody").isNotNull().alias("has_body"),
        F.col("o.`x-discovered-in`").alias("found_in"),
        F.col("o.`x-discovered-line`").alias("found_line"),
        names("query").alias("query_names"), names("path").alias("path_names"))


@query("F16_schema_components", f"""
SELECT name AS schema_name, arg_min(body_schema, ord) AS body_schema FROM (
  SELECT {SCHEMA_NAME} AS name, '{{"title":"' || file || '"}}' AS body_schema, ord
  FROM inventory WHERE ord % 4 <> 0) WHERE coalesce(name, '') <> '' GROUP BY 1""", INV)
def f16(spark, sf):
    rows = inv(spark, sf).withColumn("body_schema", F.when(
        F.col("ord") % 4 != 0, F.concat(F.lit('{"title":"'), "file", F.lit('"}'))))
    return report.schema_components(rows)


_FINDINGS = f"""
SELECT CASE status WHEN 'shadow' THEN 'SHADOW-API-001' WHEN 'zombie' THEN 'SHADOW-API-002'
    ELSE 'SHADOW-API-003' END AS rule_id,
  CASE WHEN status IN ('zombie', 'unprotected') THEN 'error' ELSE 'warning' END AS level,
  'Discovered ' || status || ' endpoint: ' || method || ' ' || url AS message, file,
  CAST(line AS BIGINT) AS line FROM inventory WHERE status IN ('shadow', 'zombie', 'unprotected')
UNION ALL
SELECT 'SHADOW-API-004', CASE severity WHEN 'low' THEN 'note' WHEN 'medium' THEN 'warning'
  ELSE 'error' END, 'Hardcoded ' || type || ' detected', CAST(doc_id AS VARCHAR), line FROM ({SECRETS})
UNION ALL
SELECT 'SHADOW-API-005', 'note', 'Documented endpoint not responding: ' || method || ' ' || path,
  NULL, NULL FROM ({_GHOSTS})"""


def findings(spark, sf):
    secret_rows = _secrets(spark, sf).withColumn("file", F.col("file").cast("string"))
    return report.findings(inv(spark, sf).withColumnRenamed("col", "column"), secret_rows,
                           inventory.ghosts(inv(spark, sf), table(spark, sf, "spec")))


@query("F17_findings", _FINDINGS, BOTH)
def f17(spark, sf):
    return findings(spark, sf).select("rule_id", "level", "message", "file",
                                      F.col("line").cast("bigint").alias("line"))


@query("F18_finding_levels", f"""
SELECT rule_id, level, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1, 2""", BOTH)
def f18(spark, sf):
    return findings(spark, sf).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("F19_sarif_documents", """
SELECT scan_id, 'head' AS kind, '2.1.0' AS value FROM inventory GROUP BY 1
UNION ALL SELECT scan_id, 'tail', 'true' FROM inventory GROUP BY 1
UNION ALL SELECT scan_id, 'first', '' FROM inventory
  WHERE status IN ('shadow', 'zombie', 'unprotected') GROUP BY 1
UNION ALL SELECT scan_id, 'result', CASE status WHEN 'shadow' THEN 'SHADOW-API-001'
    WHEN 'zombie' THEN 'SHADOW-API-002' ELSE 'SHADOW-API-003' END || ' ' || file || ':' || line || ' '
    || 'Discovered ' || status || ' endpoint: ' || method || ' ' || url
  FROM (SELECT DISTINCT scan_id, status, file, line, col, method, url, http_status FROM inventory
        WHERE status IN ('shadow', 'zombie', 'unprotected'))""", INV)
def f19(spark, sf):
    """Documents written, read again, and their lines parsed as JSON."""
    i = inv(spark, sf).withColumnRenamed("col", "column")
    scans = i.groupBy("scan_id").agg(
        F.lit("2024-01-01").cast("timestamp").alias("started_at"),
        F.lit("2024-01-02").cast("timestamp").alias("completed_at"), F.lit(0).alias("errors"))
    path = work_path(spark, "sarif")
    sinks.write_document(report.sarif_document(scans, i), path, scan="scan_id")
    line = F.col("value")
    head, tail = line.startswith('{"$schema"'), line.startswith('],"invocations"')
    # head and tail are JSON once what stands between them is closed or opened
    version = F.get_json_object(F.concat(line, F.lit("]}]}")), "$.version")
    success = F.get_json_object(F.concat(F.lit('{"runs":[{"results":['), line),
                                "$.runs[0].invocations[0].executionSuccessful")
    r = F.from_json(F.ltrim(line, F.lit(",")),
                    "ruleId string, message struct<text:string>, locations array<struct<"
                    "physicalLocation:struct<artifactLocation:struct<uri:string>,"
                    "region:struct<startLine:int>>>>")
    place = r["locations"][0]["physicalLocation"]
    result = F.concat(r["ruleId"], F.lit(" "), place["artifactLocation"]["uri"], F.lit(":"),
                      place["region"]["startLine"].cast("string"), F.lit(" "), r["message"]["text"])
    lines = spark.read.text(path)
    firsts = lines.where(~head & ~tail & ~line.startswith(",")).select(
        "scan_id", F.lit("first").alias("kind"), F.lit("").alias("value"))
    return lines.select(
        "scan_id", F.when(head, "head").when(tail, "tail").otherwise("result").alias("kind"),
        F.when(head, version).when(tail, success).otherwise(result).alias("value")).unionAll(firsts)


@query("F14_openapi_document", f"""
WITH {_LAST_OPS} SELECT path, string_agg(DISTINCT verb, ',' ORDER BY verb) AS verbs FROM ops GROUP BY 1
UNION ALL SELECT '', '3.0.3'""", INV)
def f14_document(spark, sf):
    """The document written, read again, and its lines parsed as JSON."""
    path = work_path(spark, "openapi")
    sinks.write_document(report.openapi_lines(report.path_items(report.operation_json(
        operations(spark, sf)))), path)
    line = F.col("value")
    head = line.startswith('{"openapi"')
    entry = F.map_entries(F.from_json(F.concat(F.lit("{"), F.ltrim(line, F.lit(",")), F.lit("}")),
                                      "map<string,string>"))[0]
    verbs = F.array_join(F.array_sort(F.json_object_keys(entry["value"])), ",")
    return spark.read.text(path).where(line != "}}").select(
        F.when(head, "").otherwise(entry["key"]).alias("path"),
        F.when(head, F.get_json_object(F.concat(line, F.lit("}}")), "$.openapi"))
        .otherwise(verbs).alias("verbs"))


# an error event stands for a 429, the user for the key; TTL one day
_EXPOSURE = """
SELECT ord, coalesce(t < until, false) AS blocked,
  CASE WHEN coalesce(t < until, false) THEN CAST(floor(until - t) AS BIGINT) ELSE 0 END AS remaining_seconds
FROM (SELECT ord, epoch_us(ts) / 1e6 AS t, last_value(CASE WHEN status_code = 429 THEN epoch_us(ts) / 1e6
    + CASE WHEN retry_after > 0 THEN retry_after ELSE 86400 END END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
  FROM request_log)"""


@query("F20_rate_limit_exposure", _EXPOSURE, ("request_log",))
def f20(spark, sf):
    return ratelimit.exposure(table(spark, sf, "request_log"), default_ttl=86400).select(
        "ord", "blocked", "remaining_seconds")


@query("F21_blocked_keys", """
SELECT count(*) FILTER (WHERE until > epoch(TIMESTAMP '2024-01-15 12:00:00')) AS blocked_keys FROM (
  SELECT key, arg_max(epoch_us(ts) / 1e6 + CASE WHEN retry_after > 0 THEN retry_after ELSE 86400 END,
    epoch_us(ts)) AS until FROM request_log
  WHERE status_code = 429 AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY key)""", ("request_log",))
def f21(spark, sf):
    at = F.timestamp_seconds(F.lit(1705320000))
    return ratelimit.blocked_keys(table(spark, sf, "request_log"), at, default_ttl=86400)


@query("F22_backoff", """
WITH g AS (SELECT *, sum(CASE WHEN status_code = 429 THEN 0 ELSE 1 END)
    OVER (PARTITION BY key ORDER BY ts, ord) AS grp FROM request_log)
SELECT ord, run, least(pow(2.0, run), 60.0)::DOUBLE AS backoff_seconds FROM (
  SELECT ord, CASE WHEN status_code = 429 THEN CAST(sum(CASE WHEN status_code = 429 THEN 1 ELSE 0 END)
    OVER (PARTITION BY key, grp ORDER BY ts, ord) AS BIGINT) ELSE 0 END AS run FROM g)""",
       ("request_log",))
def f22(spark, sf):
    return ratelimit.backoff(table(spark, sf, "request_log")).select("ord", "run", "backoff_seconds")


@query("F23_endpoint_table", """
SELECT ord, method, url, status, coalesce(CAST(http_status AS VARCHAR), '-') AS http_code
FROM inventory""", INV)
def f23(spark, sf):
    # the table keeps display columns only; the order column rides along in the url
    rows = inv(spark, sf).withColumn("url", F.struct("ord", "url"))
    shown = report.endpoint_table(rows)
    return shown.select("url.ord", "method", "url.url", "status", "http_code")


@query("F23_secret_table", f"""
SELECT type, CASE WHEN length(value) > 12 THEN left(value, 4) || repeat('*', length(value) - 8)
    || right(value, 4) ELSE repeat('*', length(value)) END AS masked,
  left(value, 4) || '...' || right(value, 4) AS short, severity, doc_id || ':' || line AS location
FROM ({SECRETS})""")
def f23_secrets(spark, sf):
    return report.secret_table(_secrets(spark, sf).withColumn("file", F.col("file").cast("string")))


@query("F24_shadow_override", f"""
WITH sh AS (SELECT DISTINCT {SIGNATURE} AS s FROM ({_AUDIT}) WHERE category = 'shadow')
SELECT ord, CASE WHEN {SIGNATURE} IN (SELECT s FROM sh) THEN 'shadow' ELSE status END AS status
FROM inventory""", BOTH)
def f24(spark, sf):
    i = inv(spark, sf)
    return inventory.mark_shadow(i, inventory.audit(i, table(spark, sf, "spec"))).select("ord", "status")


@query("F25_scan_totals", f"""
SELECT (SELECT count(*) FROM documents) AS files, count(*) AS endpoints,
  count(http_status) AS verified, (SELECT count(*) FROM ({SECRETS})) AS secrets FROM inventory""", INV)
def f25(spark, sf):
    return report.scan_totals(table(spark, sf, "documents"), inv(spark, sf), _secrets(spark, sf))


@query("F28_harvest_totals", "SELECT kind, count(*) AS n FROM assets GROUP BY 1", ("assets",))
def f28(spark, sf):
    return report.harvest_totals(table(spark, sf, "assets"))


@query("F29_flat_results", """
SELECT scan_id, kind, count(*) AS n FROM (
  SELECT 's' || page_id AS scan_id, unnest(['endpoint', 'endpoint', 'secret', 'error', 'error']) AS kind
  FROM pages) GROUP BY 1, 2""")
def f29(spark, sf):
    reports = feeds.parse_reports(table(spark, sf, "reports"))
    rows = (feeds.report_endpoints(reports).select("scan_id", F.lit("endpoint").alias("kind"))
            .unionByName(feeds.report_secrets(reports).select("scan_id", F.lit("secret").alias("kind")))
            .unionByName(feeds.report_errors(reports).select("scan_id", F.lit("error").alias("kind"))))
    return rows.groupBy("scan_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("F30_preview", """
SELECT ord, method, url, greatest((SELECT count(*) FROM inventory) - 10, 0) AS remaining
FROM inventory ORDER BY ord LIMIT 10""", INV)
def f30(spark, sf):
    return inventory.preview(inv(spark, sf)).select("ord", "method", "url", "remaining")


@query("crawl_audit", f"""
WITH k AS (SELECT page_id AS ord, {host('url')} AS domain, {path('url')} AS p FROM pages
  WHERE {scope_reason('url')} = ''),
u AS (SELECT arg_min(domain, ord) AS domain, arg_min(p, ord) AS url FROM k
  GROUP BY regexp_replace(regexp_replace(p, '\\{{[^}}]+\\}}', '{{param}}', 'g'), ':[a-zA-Z_]+', ':param', 'g'))
SELECT domain, 'GET' AS method, u.url, CASE WHEN s.sig IS NULL THEN 'shadow' WHEN s.dep THEN 'zombie'
  ELSE 'documented' END AS category
FROM u LEFT JOIN {_SPEC} s ON s.sig = 'GET:' || rtrim(u.url, '/')""", ("spec",))
def crawl(spark, sf):
    return stages.crawl_audit(table(spark, sf, "pages"), table(spark, sf, "spec"), ALLOWED, BLOCKED)


@query("verify_stage", f"""
WITH i AS (SELECT p.page_id AS ord, 'GET' AS method, p.url, CASE WHEN NOT r.success THEN 'dead'
    WHEN r.has_deprecation_header THEN 'zombie' WHEN r.http_status < 400 THEN 'verified'
    WHEN r.http_status IN (401, 403) THEN 'protected' ELSE 'discovered' END AS status
  FROM pages p JOIN probes r ON r.url = p.url)
SELECT ord, CASE WHEN {MATCH} NOT IN (SELECT sig FROM {_SPEC}) THEN 'shadow' ELSE status END AS status
FROM i""", ("probes", "spec"))
def verify(spark, sf):
    i = table(spark, sf, "pages").select(
        F.col("page_id").alias("ord"), F.lit("GET").alias("method"), "url",
        F.lit("discovered").alias("status"), F.lit(None).cast("int").alias("http_status"))
    return stages.verify(i, table(spark, sf, "probes"), table(spark, sf, "spec")).select("ord", "status")

