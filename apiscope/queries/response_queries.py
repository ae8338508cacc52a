"""Recorded responses (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import responses as r
from ..operators import responses as ops
from ..operators import scope
from ..sources import feeds
from .registry import lit, query, table
from .url_queries import ALLOWED, BLOCKED, scope_reason

USES = ("responses",)


def log(spark, sf):
    """The derived log with its headers as a map (mixed-case names)."""
    t = table(spark, sf, "responses")
    names = {"Content-Type": "content_type", "Access-Control-Allow-Origin": "cors",
             "Deprecation": "deprecation", "Sunset": "sunset", "Link": "link",
             "X-Deprecated": "x_deprecated", "Warning": "warning", "Server": "server"}
    pairs = [x for name, col in names.items() for x in (F.lit(name), F.col(col))]
    raw = t.select("ord", "method", "url", "status_code", "success", "body",
                   F.map_filter(F.create_map(*pairs), lambda _, v: v != "").alias("headers"))
    return feeds.response_log(raw)


TRACE = f"regexp_matches(body, {lit('(?i)(?:' + '|'.join(p for p, _ in rules.STACK_TRACES) + ')')})"
LEAK = f"regexp_matches(body, {lit('(?i)(?:' + '|'.join(p for p, _ in rules.SENSITIVE_ERRORS) + ')')})"
JSON = "contains(lower(content_type), 'application/json')"
XML = f"(contains(lower(content_type), 'text/xml') AND NOT {JSON})"
_CATEGORY = "CASE " + " ".join(
    f"WHEN status_code = {c} THEN '{cat}'" for c, cat, _ in rules.STATUS_CATEGORIES
) + " WHEN status_code >= 500 THEN 'error' ELSE 'unknown' END"
_NOTE = "CASE " + " ".join(
    f"WHEN status_code = {c} THEN {lit(n)}" for c, _, n in rules.STATUS_CATEGORIES if n
) + " WHEN status_code >= 500 THEN 'Server error (' || status_code || ')' END"
_NOTES = f"""array_to_string(list_filter([{_NOTE},
  CASE WHEN {TRACE} THEN 'Exposes stack trace' END,
  CASE WHEN {LEAK} THEN 'Contains sensitive error message' END,
  CASE WHEN cors = '*' THEN 'Wildcard CORS - potential security issue' END,
  CASE WHEN {XML} THEN 'XML response in potentially JSON-first API' END],
  lambda n: n IS NOT NULL), '; ')"""


@query("E1_status_category", f"""
SELECT ord, CASE WHEN {TRACE} THEN 'vulnerable' ELSE {_CATEGORY} END AS category,
  1.0::DOUBLE AS confidence, {_NOTES} AS notes FROM responses""", USES)
def e1(spark, sf):
    return ops.classify_responses(log(spark, sf)).select(
        "ord", "category", "confidence", F.array_join("notes", "; ").alias("notes"))


@query("E2_stack_trace", f"SELECT ord, {TRACE} AS has_stack_trace FROM responses", USES)
def e2(spark, sf):
    return log(spark, sf).select("ord", r.has_stack_trace("body").alias("has_stack_trace"))


@query("E3_sensitive_error", f"SELECT ord, {LEAK} AS sensitive FROM responses", USES)
def e3(spark, sf):
    return log(spark, sf).select("ord", r.has_sensitive_error("body").alias("sensitive"))


@query("E4_open_cors", "SELECT ord, cors = '*' AS open_cors FROM responses", USES)
def e4(spark, sf):
    return log(spark, sf).select("ord", r.has_open_cors("headers").alias("open_cors"))


@query("E5_content_flags", f"SELECT ord, {JSON} AS is_json_api, {XML} AS is_legacy FROM responses",
       USES)
def e5(spark, sf):
    return log(spark, sf).select("ord", r.is_json("headers").alias("is_json_api"),
                                 r.is_legacy_xml("headers").alias("is_legacy"))


_DEPRECATED = ("(deprecation <> '' OR sunset <> '' OR contains(link, 'rel=\"sunset\"')"
               " OR contains(link, 'rel=\"deprecation\"') OR x_deprecated <> ''"
               " OR contains(lower(warning), 'deprecated'))")


@query("E6_deprecation_headers", f"SELECT ord, {_DEPRECATED} AS is_deprecated FROM responses", USES)
def e6(spark, sf):
    return log(spark, sf).select("ord", r.is_deprecated("headers").alias("is_deprecated"))


_WORD = "CASE " + " ".join(f"WHEN contains(lower(body), {lit(w)}) THEN {lit(w)}"
                           for w in rules.DEPRECATION_WORDS) + " END"


@query("E7_deprecation_word", f"SELECT ord, {_WORD} AS word FROM responses", USES)
def e7(spark, sf):
    return log(spark, sf).select("ord", r.deprecation_word("body").alias("word"))


_YEAR = f"TRY_CAST(regexp_extract(body, {lit(rules.COPYRIGHT)}, 1) AS BIGINT)"
_OLD_YEAR = f"CASE WHEN 2025 - {_YEAR} >= 3 THEN {_YEAR} END"


@query("E8_old_copyright", f"SELECT ord, {_OLD_YEAR} AS year FROM responses", USES)
def e8(spark, sf):
    return log(spark, sf).select(
        "ord", r.old_copyright_year("body", 2025).cast("bigint").alias("year"))


_SERVER = "CASE " + " ".join(f"WHEN regexp_matches(server, {lit(p)}) THEN {lit(n)}"
                             for p, n in rules.OLD_SERVERS) + " END"


@query("E9_old_server", f"""
SELECT ord, {_SERVER} AS server, array_to_string(list_filter([
  CASE WHEN contains(lower(warning), 'deprecated') THEN 'Warning header: ' || warning END,
  'Body contains: ''' || {_WORD} || '''', 'Old copyright year: ' || {_OLD_YEAR},
  'Old server version: ' || {_SERVER}], lambda x: x IS NOT NULL), '; ') AS indicators
FROM responses""", USES)
def e9(spark, sf):
    return log(spark, sf).select(
        "ord", r.old_server("headers").alias("server"),
        F.array_join(r.age_indicators("headers", "body", 2025), "; ").alias("indicators"))


def _date(x: str) -> str:
    return f"""CAST(epoch(coalesce(
  try_strptime({x}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({x}, '%Y-%m-%d'),
  try_strptime({x}, '%a, %d %b %Y %H:%M:%S GMT'),
  try_strptime(left({x}, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOUR)) AS BIGINT)"""


@query("E10_header_dates", f"""
SELECT ord, {_date('deprecation')} AS deprecated_at, {_date('sunset')} AS sunset_at
FROM responses""", USES)
def e10(spark, sf):
    t = ops.classify_responses(log(spark, sf))
    return t.select("ord", F.unix_seconds("deprecation_date").alias("deprecated_at"),
                    F.unix_seconds("sunset_date").alias("sunset_at"))


@query("E11_graphql_response", """
SELECT ord, status_code = 200 AND ord % 4 IN (0, 1) AS is_graphql FROM responses""", USES)
def e11(spark, sf):
    size = F.length("body").cast("string")
    k = F.col("ord") % 4
    body = (F.when(k == 0, F.concat(F.lit('{"data":{"n":'), size, F.lit("}}")))
            .when(k == 1, F.concat(F.lit('{"errors":['), size, F.lit("]}")))
            .when(k == 2, F.concat(F.lit("["), size, F.lit("]"))).otherwise(F.col("body")))
    return log(spark, sf).select(
        "ord", r.is_graphql_response("status_code", body).alias("is_graphql"))


_TYPES = "json_extract(schema_json, '$.types')"


@query("E12_graphql_operations", f"""
WITH t AS (SELECT page_id, coalesce(json_extract_string(schema_json, '$.queryType.name'), 'Query') AS q,
    coalesce(json_extract_string(schema_json, '$.mutationType.name'), 'Mutation') AS m,
    unnest(CAST({_TYPES} AS JSON[])) AS ty FROM introspection),
f AS (SELECT page_id, CASE WHEN json_extract_string(ty, '$.name') = q THEN 'query' ELSE 'mutation' END AS type,
    unnest(CAST(json_extract(ty, '$.fields') AS JSON[])) AS f FROM t
  WHERE json_extract_string(ty, '$.name') IN (q, m))
SELECT page_id, type, json_extract_string(f, '$.name') AS name,
  coalesce(array_to_string(list_transform(CAST(json_extract(f, '$.args') AS JSON[]),
    lambda a: json_extract_string(a, '$.name') || ':' || coalesce(json_extract_string(a, '$.type.name'), '')),
    ','), '') AS args,
  json_extract_string(f, '$.type.name') AS return_type FROM f""", ("introspection",))
def e12(spark, sf):
    got = ops.graphql_operations(table(spark, sf, "introspection"), key="page_id")
    args = F.transform("args", lambda a: F.concat(a["name"], F.lit(":"),
                                                  F.coalesce(a["type"], F.lit(""))))
    return got.select("page_id", "type", "name", F.array_join(args, ",").alias("args"), "return_type")


# one endpoint per language of the crawl; the first page is the baseline
_PAIR = "SELECT ord, split_part(url, '/', 4) AS endpoint, status_code, length(body) AS length FROM responses"


@query("E13_response_difference", f"""
WITH p AS ({_PAIR}), b AS (SELECT endpoint, arg_min(status_code, ord) AS bs, arg_min(length, ord) AS bl
  FROM p GROUP BY 1)
SELECT p.ord, p.endpoint, CASE WHEN p.status_code <> bs
    THEN 'Status code changed: ' || bs || ' -> ' || p.status_code
  ELSE 'Response size changed significantly (' ||
    CAST(floor(abs(p.length - bl)::DOUBLE / bl * 100) AS BIGINT) || '%)' END AS description
FROM p JOIN b USING (endpoint)
WHERE p.status_code <> bs OR (bl > 0 AND abs(p.length - bl)::DOUBLE / bl > 0.05)""", USES)
def e13(spark, sf):
    p = log(spark, sf).select("ord", F.split_part("url", F.lit("/"), F.lit(4)).alias("endpoint"),
                              "status_code", F.length("body").alias("length"))
    return ops.response_differences(p, p).select("ord", "endpoint", "description")


@query("E14_reflected_fields", "\nUNION ALL\n".join(f"""
SELECT ord, {lit(f)} AS parameter FROM responses WHERE status_code < 400
  AND contains(lower(body), {lit(f.lower())}) AND contains(lower(body), {lit(v)})"""
                                                   for f, v in rules.SENSITIVE_FIELDS), USES)
def e14(spark, sf):
    return ops.reflected(log(spark, sf)).select("ord", "parameter")


_TRIAGE = f"""SELECT ord, CASE WHEN url LIKE 'http%' THEN url WHEN b <> '' THEN
  regexp_extract(b, '^https://[^/]+') || url END AS target
FROM (SELECT *, CASE WHEN ord % 5 = 0 THEN '' ELSE base_url END AS b FROM inventory)"""


@query("E15_triage", f"""
SELECT ord, target, CASE WHEN target IS NULL THEN 'No base URL for relative path'
  WHEN {scope_reason('target')} <> '' THEN 'URL out of scope' ELSE '' END AS error
FROM ({_TRIAGE})""", ("inventory",))
def e15(spark, sf):
    inv = table(spark, sf, "inventory").withColumn(
        "base_url", F.when(F.col("ord") % 5 != 0, F.col("base_url")))
    return scope.triage(inv, ALLOWED, BLOCKED).select("ord", "target", "error")


_STATUS = f"""
SELECT i.page_id, CASE WHEN NOT p.success THEN 'dead' WHEN p.has_deprecation_header THEN 'zombie'
  WHEN p.http_status < 400 THEN 'verified' WHEN p.http_status IN (401, 403) THEN 'protected'
  ELSE 'discovered' END AS status, CAST(p.http_status AS BIGINT) AS http_status
FROM pages i JOIN probes p ON p.url = i.url"""


@query("E16_status_transition", _STATUS, ("probes",))
def e16(spark, sf):
    inv = table(spark, sf, "pages").select(
        "page_id", F.lit("GET").alias("method"), "url", F.lit("discovered").alias("status"),
        F.lit(None).cast("int").alias("http_status"))
    return ops.update_status(inv, table(spark, sf, "probes")).select(
        "page_id", "status", F.col("http_status").cast("bigint").alias("http_status"))


@query("E17_response_summary", """
SELECT count(*) AS probed, count(*) FILTER (WHERE success AND http_status < 400) AS active,
  count(*) FILTER (WHERE http_status IN (401, 403)) AS protected,
  count(*) FILTER (WHERE NOT success OR http_status = 404) AS dead,
  count(*) FILTER (WHERE has_deprecation_header) AS zombies FROM probes""", ("probes",))
def e17(spark, sf):
    return ops.response_summary(table(spark, sf, "probes"))


@query("F27_active_urls", "SELECT method, url FROM probes WHERE success AND http_status < 400",
       ("probes",))
def f27(spark, sf):
    return ops.active_urls(table(spark, sf, "probes"))

