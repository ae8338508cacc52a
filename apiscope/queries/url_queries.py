"""URL scalars (B) and scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..operators import extract, inventory, responses, scope
from .registry import lit, query, table

ALLOWED = ["*.example.com", "https://*.example.org/"]
BLOCKED = ["blog.*", "spam-farm.example.org"]

_SCHEME = r"'^([A-Za-z][A-Za-z0-9+.\-]*):'"
_NETLOC = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)'"
_PATH = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)'"
_QUERY = r"'^[^?#]*\?([^#]*)'"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, {_NETLOC}, 1)"


def raw_path(u: str) -> str:
    return f"regexp_extract({u}, {_PATH}, 1)"


def path(u: str) -> str:
    return f"regexp_replace({raw_path(u)}, ';[^/]*$', '')"


def host(u: str) -> str:
    return f"split_part(lower({netloc(u)}), ':', 1)"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def any_match(u: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({u}, {lit(p)})" for p in patterns) + ")"


def reason(u: str) -> str:
    s = f"lower(regexp_extract({u}, {_SCHEME}, 1))"
    return f"""CASE
  WHEN {u} = '' THEN 'Empty URL'
  WHEN {s} = '' THEN 'Missing URL scheme (http/https required)'
  WHEN {s} NOT IN ('http', 'https') THEN 'Invalid scheme ''' || {s} || ''', must be http/https'
  WHEN {netloc(u)} = '' THEN 'Missing domain/netloc in URL'
  WHEN contains({netloc(u)}, '@') THEN 'URL contains embedded credentials (user:pass@host)'
  WHEN regexp_matches({host(u)}, {lit(rules.IPV4)})
    THEN 'IP addresses are not allowed, use domain names'
  WHEN {host(u)} IN {in_list(rules.LOCAL_HOSTS)} THEN 'Localhost targets are not allowed'
  WHEN {host(u)} IN {in_list(rules.BLOCKED_HOSTS)}
    THEN 'SSRF protection: Blocked hostname ''' || {host(u)} || ''''
  WHEN {any_match(host(u), rules.BLOCKED_RANGES)}
    THEN 'SSRF protection: Internal/private IP range blocked'
  ELSE '' END"""


def scope_reason(u: str) -> str:
    h = host(u)
    return f"""CASE WHEN {reason(u)} <> '' THEN {reason(u)}
  WHEN {h} LIKE 'blog.%' THEN 'Matched blocked pattern: blog.*'
  WHEN {h} = 'spam-farm.example.org' THEN 'Matched blocked pattern: spam-farm.example.org'
  WHEN NOT ({h} LIKE '%.example.com' OR {h} LIKE '%.example.org') THEN 'Not in allowed domains list'
  ELSE '' END"""


def is_api(u: str) -> str:
    no = " OR ".join(f"regexp_matches({u}, {lit('(?i)' + p)})" for p in rules.NOT_API)
    return (f"({u} <> '' AND NOT ({no}) AND (regexp_matches({u}, {lit('(?i)' + rules.API_ANY_HOST)})"
            f" OR regexp_matches({u}, {lit('(?i)' + rules.API_NO_HOST)})))")


@query("B1_url_validation", f"""
SELECT page_id, url, {reason('url')} = '' AS ok, {reason('url')} AS reason,
  CASE WHEN {reason('url')} IN ('Empty URL', 'Missing URL scheme (http/https required)',
    'Missing domain/netloc in URL') OR {reason('url')} LIKE 'Invalid scheme%' THEN ''
    ELSE {host('url')} END AS domain
FROM url_cases""", ("url_cases",))
def b1(spark, sf):
    t = table(spark, sf, "url_cases").withColumn("v", urls.validate("url"))
    return t.select("page_id", "url", "v.ok", "v.reason", "v.domain")


@query("B2_scope_filter", f"""
SELECT page_id, url, {scope_reason('url')} = '' AS in_scope, {scope_reason('url')} AS reason
FROM pages""")
def b2(spark, sf):
    return scope.scope_check(table(spark, sf, "pages").select("page_id", "url"),
                             ALLOWED, BLOCKED).drop("domain")


@query("B2_scope_by_table", f"""
SELECT page_id, url, CASE WHEN {host('url')} IN
    (SELECT min({host('url')}) FROM pages GROUP BY split_part(url, '/', 4))
    THEN 'Matched blocked pattern: ' || {host('url')}
  WHEN {host('url')} LIKE '%.example.com' OR {host('url')} LIKE '%.example.org' THEN ''
  ELSE 'Not in allowed domains list' END AS reason
FROM pages""")
def b2_table(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    deny = (pages.groupBy(F.split_part("url", F.lit("/"), F.lit(4)).alias("g"))
            .agg(F.min(urls.host("url")).alias("pattern"))
            .select("pattern", F.lit("deny").alias("action")))
    domain = F.concat(F.lit("*."), F.substring_index(urls.host("url"), ".", -2))
    allow = (pages.select(domain.alias("pattern")).distinct()
             .where(~F.col("pattern").endswith(".net"))
             .withColumn("action", F.lit("allow")))
    return scope.scope_check_by_table(pages, deny.unionByName(allow)).drop("in_scope")


# a glob of every first word and path: a host with any letters, its vowels left open, and a part of it
_GLOBS = """
SELECT DISTINCT * FROM (
  SELECT '*' || substr({h}, 3, 6) || '?' || substr({h}, 10) AS pattern, 'deny' AS action FROM pages
    WHERE split_part(url, '/', 4) = 'es'
  UNION ALL SELECT translate({h}, 'aeiou', '?????'), 'allow' FROM pages
  UNION ALL SELECT substr({h}, 1, 1) || '*n?t', 'deny' FROM pages
  UNION ALL SELECT '???', 'deny' FROM pages)"""


@query("B2_scope_by_globs", f"""
WITH globs AS ({_GLOBS.format(h=host('url'))}), hosts AS (SELECT DISTINCT {host('url')} AS h FROM pages),
met AS (SELECT h, min(pattern) FILTER (WHERE action = 'deny') AS deny,
    count(*) FILTER (WHERE action = 'allow') > 0 AS allow
  FROM hosts JOIN globs ON h GLOB pattern GROUP BY h)
SELECT page_id, url, CASE WHEN deny IS NOT NULL THEN 'Matched blocked pattern: ' || deny
  WHEN allow THEN '' ELSE 'Not in allowed domains list' END AS reason
FROM pages LEFT JOIN met ON h = {host('url')}""")
def b2_globs(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    h = urls.host("url")
    deny = [pages.where(F.split_part("url", F.lit("/"), F.lit(4)) == "es").select(F.concat(
                F.lit("*"), F.substring(h, 3, 6), F.lit("?"), F.substring(h, 10, 1000)).alias("pattern")),
            pages.select(F.concat(F.substring(h, 1, 1), F.lit("*n?t")).alias("pattern")),
            pages.select(F.lit("???").alias("pattern"))]
    allow = pages.select(F.translate(h, "aeiou", "?????").alias("pattern"))
    globs = reduce(DataFrame.unionAll, [d.withColumn("action", F.lit("deny")) for d in deny]).unionAll(
        allow.withColumn("action", F.lit("allow"))).distinct()
    return scope.scope_check_by_table(pages, globs).drop("in_scope")


@query("B3_scope_partition", f"""
SELECT {scope_reason('url')} = '' AS in_scope, count(*) AS n FROM pages GROUP BY 1""")
def b3(spark, sf):
    kept, out = scope.partition_scope(table(spark, sf, "pages").select("page_id", "url"),
                                      ALLOWED, BLOCKED)
    return kept.unionByName(out).groupBy("in_scope").agg(F.count(F.lit(1)).alias("n"))


@query("B4_rejection_log", f"""
SELECT url, {scope_reason('url')} AS reason FROM url_cases
WHERE {scope_reason('url')} <> ''""", ("url_cases",))
def b4(spark, sf):
    return scope.rejection_log(table(spark, sf, "url_cases"), ALLOWED, BLOCKED)


@query("B5_target_scheme", """
SELECT page_id, CASE WHEN starts_with(trim(value), 'http://') OR starts_with(trim(value), 'https://')
  THEN trim(value) ELSE 'https://' || trim(value) END AS target FROM target_lines""",
       ("target_lines",))
def b5(spark, sf):
    return table(spark, sf, "target_lines").select("page_id", urls.with_scheme("value").alias("target"))


@query("B6_url_parts", f"""
SELECT page_id, {netloc('url')} AS netloc, {path('url')} AS path,
  regexp_extract(url, {_QUERY}, 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment,
  lower(regexp_extract(url, {_SCHEME}, 1)) AS scheme, {host('url')} AS host
FROM url_cases""", ("url_cases",))
def b6(spark, sf):
    return table(spark, sf, "url_cases").select(
        "page_id", urls.netloc("url").alias("netloc"), urls.path("url").alias("path"),
        urls.query("url").alias("query"), urls.fragment("url").alias("fragment"),
        urls.scheme("url").alias("scheme"), urls.host("url").alias("host"))


# The SQL side spells out each reference form of the derivation.
@query("B7_resolve_reference", f"""
SELECT page_id, ref, CASE page_id % 14
  WHEN 0 THEN o || '/api/' || num
  WHEN 1 THEN o || '/' || lang || '/' || num
  WHEN 2 THEN o || rtrim(regexp_replace({path('base')}, '[^/]*$', ''), '/') || '/a/' || num
  WHEN 3 THEN split_part(base, '//', 1) || ref
  WHEN 4 THEN o || {path('base')} || ref
  WHEN 5 THEN split_part(base, '#', 1) || ref
  WHEN 6 THEN base
  WHEN 7 THEN ref
  WHEN 8 THEN o || '/' || num || '#z'
  WHEN 9 THEN o || regexp_replace({path('base')}, '[^/]*$', '') || num || '/'
  WHEN 10 THEN o || CASE WHEN ends_with({path('base')}, '/') THEN '/' || lang || '/' ELSE '/' END
  WHEN 11 THEN ref
  WHEN 12 THEN o || '/a//b/' || num || '/'
  ELSE ref END AS target
FROM (SELECT r.page_id, r.ref, r.base, p.num,
        CASE WHEN r.page_id % 14 = 1 AND ends_with({path('r.base')}, '/')
             THEN p.lang || '/' || p.lang ELSE p.lang END AS lang,
        regexp_extract(r.base, '^(https?://[^/?#]*)', 1) AS o
      FROM refs r JOIN page_parts p USING (page_id))""", ("refs",))
def b7(spark, sf):
    return table(spark, sf, "refs").select(
        "page_id", "ref", urls.resolve("base", "ref").alias("target"))


def _key(u: str) -> str:
    stem = f"coalesce(nullif(trim({path(u)}, '/'), ''), 'index.js')"
    q = f"regexp_extract({u}, {_QUERY}, 1)"
    return f"""replace({netloc(u)}, ':', '_') || '/' || CASE WHEN {q} = '' THEN {stem}
  WHEN contains({stem}, '.') THEN left({stem}, length({stem}) - length(split_part({stem}, '.', -1)) - 1)
    || '_' || left(md5({q}), 8) || '.' || split_part({stem}, '.', -1)
  ELSE {stem} || '_' || left(md5({q}), 8) END"""


@query("B8_storage_key", f"""
SELECT 'p' || page_id AS id, {_key('url')} AS key FROM pages
UNION ALL SELECT 'a' || ord, {_key('url')} FROM assets""", ("assets",))
def b8(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    assets = table(spark, sf, "assets").select(
        F.concat(F.lit("a"), F.col("ord").cast("string")).alias("id"), "url")
    return pages.unionByName(assets).select("id", urls.storage_key("url").alias("key"))


@query("B9_endpoint_key", f"""
SELECT ord, method || ':' || {netloc('url')} || {path('url')} AS key FROM inventory""",
       ("inventory",))
def b9(spark, sf):
    return table(spark, sf, "inventory").select("ord", urls.endpoint_key("method", "url").alias("key"))


@query("B10_api_url", f"SELECT ord, url, {is_api('url')} AS is_api FROM inventory", ("inventory",))
def b10(spark, sf):
    return table(spark, sf, "inventory").select("ord", "url", urls.is_api_url("url").alias("is_api"))


SIGNATURE = (r"method || ':' || regexp_replace(regexp_replace(url, '\{[^}]+\}', '{param}', 'g'),"
             r" ':[a-zA-Z_]+', ':param', 'g')")
MATCH = (r"method || ':' || rtrim(regexp_replace(regexp_replace(regexp_replace(url, '\{[^}]+\}',"
         r" '{param}', 'g'), ':[a-zA-Z_]+', '{param}', 'g'), '<[^>]+>', '{param}', 'g'), '/')")
SPEC_SIG = r"method || ':' || regexp_replace(path, '\{[^}]+\}', '{param}', 'g')"


@query("B11_signature", f"SELECT ord, {SIGNATURE} AS signature FROM inventory", ("inventory",))
def b11(spark, sf):
    return table(spark, sf, "inventory").select("ord", urls.signature("method", "url").alias("signature"))


@query("B12_match_signature", f"SELECT ord, {MATCH} AS signature FROM inventory", ("inventory",))
def b12(spark, sf):
    return table(spark, sf, "inventory").select(
        "ord", urls.match_signature("method", "url").alias("signature"))


@query("B13_spec_signature", f"""
SELECT {SPEC_SIG} AS match_sig, arg_max(path, ord) AS path, arg_max(deprecated, ord) AS deprecated,
  max(ord) AS ord FROM spec GROUP BY 1""", ("spec",))
def b13(spark, sf):
    return inventory.spec_signatures(table(spark, sf, "spec")).select(
        "match_sig", "path", "deprecated", "ord")


OPENAPI = (r"regexp_replace(CASE WHEN starts_with(b, '/') THEN b ELSE '/' || b END,"
           r" ':([a-zA-Z_][a-zA-Z0-9_]*)', '{\1}', 'g')")
OPENAPI_FROM = ("(SELECT *, split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1) AS b"
                " FROM inventory)")


@query("B14_openapi_path", f"SELECT ord, {OPENAPI} AS path FROM {OPENAPI_FROM}", ("inventory",))
def b14(spark, sf):
    return table(spark, sf, "inventory").select("ord", urls.openapi_path("url").alias("path"))


@query("B15_path_params", r"""
SELECT ord, array_to_string(list_transform(
  regexp_extract_all(url, '\{[^}]+\}|:[a-zA-Z_]+|<[^>]+>'),
  lambda m: CASE WHEN starts_with(m, ':') THEN substr(m, 2) ELSE substr(m, 2, length(m) - 2) END),
  ',') AS params FROM inventory""", ("inventory",))
def b15(spark, sf):
    return table(spark, sf, "inventory").select(
        "ord", F.array_join(urls.path_params("url"), ",").alias("params"))


TAGS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(url, {lit('(?i)' + p)}) THEN {lit(t)} END"
    for p, t in rules.TAG_PATTERNS) + (
    ", CASE WHEN regexp_matches(url, '/v\\d+/') THEN 'v' || regexp_extract(url, '/v(\\d+)/', 1) END"
    "], lambda t: t IS NOT NULL), ',')")


@query("B16_tags", f"""
SELECT ord, CASE WHEN t = '' THEN 'Discovered' ELSE t END AS tags
FROM (SELECT ord, {TAGS} AS t FROM inventory)""", ("inventory",))
def b16(spark, sf):
    return table(spark, sf, "inventory").select("ord", F.array_join(urls.tags("url"), ",").alias("tags"))


SCHEMA_NAME = r"""array_to_string(list_transform(string_split_regex(
    (list_filter(string_split(trim(url, '/'), '/'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^v\d+$|^[{:<]')))[-1], '[-_]'),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"""


@query("B17_schema_name", f"SELECT ord, {SCHEMA_NAME} AS name FROM inventory", ("inventory",))
def b17(spark, sf):
    return table(spark, sf, "inventory").select("ord", urls.schema_name("url").alias("name"))


@query("B18_version_siblings", r"""
SELECT ord, url, false AS is_variant FROM inventory
UNION ALL
SELECT ord, regexp_replace(url, '/v\d+/', '/v' || v || '/', 'g'), true
FROM inventory, (SELECT unnest(range(1, 6)) AS v)
WHERE regexp_matches(url, '/v\d+/') AND CAST(regexp_extract(url, '/v(\d+)/', 1) AS INT) <> v""",
       ("inventory",))
def b18(spark, sf):
    return inventory.version_siblings(table(spark, sf, "inventory")).select("ord", "url", "is_variant")


@query("B19_graphql_like", """
SELECT ord, contains(lower(url), 'graphql') OR contains(lower(url), 'gql')
  OR contains(lower(url), 'query') AS graphql_like FROM inventory""", ("inventory",))
def b19(spark, sf):
    return table(spark, sf, "inventory").select(
        "ord", urls.is_graphql_like("url").alias("graphql_like"))


@query("B20_graphql_candidates", f"""
SELECT DISTINCT base_url, rtrim(base_url, '/') || p AS candidate
FROM inventory, (SELECT unnest([{", ".join(lit(p) for p in rules.GRAPHQL_PATHS)}]) AS p)""",
       ("inventory",))
def b20(spark, sf):
    bases = table(spark, sf, "inventory").select("base_url").distinct()
    return responses.graphql_candidates(bases, rules.GRAPHQL_PATHS).select("base_url", "candidate")


_PARAMS = f"""
SELECT page_id, split_part(p, '=', 1) AS name,
  CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END AS value
FROM (SELECT page_id, unnest(string_split(regexp_extract(url, {_QUERY}, 1), '&')) AS p FROM u)
WHERE p <> ''"""


@query("B21_sensitive_params", f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT ord, url FROM inventory)
SELECT *, name IN {in_list(rules.SENSITIVE_PARAMS)} AS is_sensitive FROM ({_PARAMS})""",
       ("inventory",))
def b21(spark, sf):
    both = table(spark, sf, "pages").select("page_id", "url").unionByName(
        table(spark, sf, "inventory").select(F.col("ord").alias("page_id"), "url"))
    return extract.parameter_inventory(both).drop("url")


@query("B21_param_counts", f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT ord, url FROM inventory)
SELECT name, name IN {in_list(rules.SENSITIVE_PARAMS)} AS is_sensitive, count(*) AS uses
FROM ({_PARAMS}) GROUP BY 1, 2""", ("inventory",))
def b21_counts(spark, sf):
    both = table(spark, sf, "pages").select("page_id", "url").unionByName(
        table(spark, sf, "inventory").select(F.col("ord").alias("page_id"), "url"))
    return extract.parameter_counts(both)


_STAMP = "'2024' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0') || '15103000'"


@query("B22_archive_names", f"""
SELECT page_id, 'https://web.archive.org/web/' || {_STAMP} || 'id_/' || url AS archive_url,
  {_STAMP} || '_' || coalesce(nullif(split_part(rtrim({path('url')}, '/'), '/', -1), ''), 'index.js')
    AS file FROM pages""")
def b22(spark, sf):
    stamp = F.concat(F.lit("2024"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"),
                     F.lit("15103000"))
    return table(spark, sf, "pages").select(
        "page_id", urls.archive_url(stamp, "url").alias("archive_url"),
        urls.archive_file(stamp, "url").alias("file"))


@query("B23_capture_time", """
SELECT event_id, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS epoch_s FROM events
UNION ALL SELECT -1 - event_id, NULL FROM events""")
def b23(spark, sf):
    ev = table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    good = ev.select("event_id", F.unix_seconds(urls.capture_time(stamp)).alias("epoch_s"))
    bad = ev.select((-1 - F.col("event_id")).alias("event_id"), F.unix_seconds(
        urls.capture_time(F.concat(F.lit("x"), stamp))).alias("epoch_s"))
    return good.unionByName(bad)


@query("B24_snippet", "SELECT doc_id, left(text, 100) AS snippet FROM documents")
def b24(spark, sf):
    return table(spark, sf, "documents").select("doc_id", urls.snippet("text").alias("snippet"))
