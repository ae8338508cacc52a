"""Extraction (C) and personal data (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import pii
from ..operators import extract, resolve
from ..plans import stages
from .registry import lit, query, table
from .url_queries import in_list, is_api

SRC = ("sources",)
PY = "language = 'python'"


_ESCAPES = "\\\"'`\n$/*#"


def hidden(t: str, back: bool = False) -> str:
    """Escapes that read as syntax replaced by pairs of private letters, or back."""
    for i, c in enumerate(_ESCAPES):
        pair = f"chr(92) || chr({ord(c)})", f"chr({57344 + i}) || chr(57400)"
        t = f"replace({t}, {pair[back]}, {pair[not back]})"
    return t


def shown(t: str) -> str:
    return hidden(t, back=True)


def placed(table_name: str, key: str, text: str, pattern: str, group: int = 0,
           where: str = "true") -> str:
    """Matches with 0-based offset: (key, text, i, m, g, off)."""
    p = lit(pattern)
    return f"""
SELECT {key}, {text}, i, ms[i] AS m, gs[i] AS g,
  CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS off
FROM (SELECT {key}, {text}, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT {key}, {text}, regexp_extract_all({text}, {p}) AS ms,
    regexp_extract_all({text}, {p}, {group}) AS gs, string_split_regex({text}, {p}) AS ps
  FROM {table_name} WHERE {where}))"""


def line_of(text: str) -> str:
    head = f"left({text}, off)"
    return f"CAST(1 + length({head}) - length(replace({head}, chr(10), '')) AS BIGINT)"


def column_of(text: str) -> str:
    return f"CAST(1 + length(split_part(left({text}, off), chr(10), -1)) AS BIGINT)"


def unquoted(m: str) -> str:
    return "trim(" + m + ", '\"''`')"


# --- C1 -------------------------------------------------------------------
def _literal_sql(dialect: str, where: str, source: str = "sources") -> str:
    clean = f"(SELECT file, language, text, {hidden('text')} AS t FROM {source})"
    comment = {"js": "starts_with(m, '//') OR starts_with(m, '/*')", "py": "starts_with(m, '#')",
               "html": "starts_with(m, '<!--')"}
    return f"""
SELECT file, {shown(unquoted('m'))} AS url, {line_of('t')} AS line, {column_of('t')} AS "column",
  left({shown(unquoted('m'))}, 100) AS context
FROM ({placed(clean, 'file', 't', rules.LITERALS[dialect], where=where)})
WHERE NOT ({comment[dialect]}) AND {is_api(shown(unquoted('m')))}"""


ENDPOINTS = "\nUNION ALL\n".join([_literal_sql("js", "language <> 'python'"),
                                   _literal_sql("py", "language = 'python'")])


@query("C1_literal_endpoints", ENDPOINTS, SRC)
def c1(spark, sf):
    found = extract.literal_endpoints(table(spark, sf, "sources"))
    return found.select("file", "url", F.col("line").cast("bigint").alias("line"),
                        F.col("column").cast("bigint").alias("column"), "context")


@query("C1_page_literals", _literal_sql("html", "true", "markups"), ("markups",))
def c1_pages(spark, sf):
    found = extract.literal_endpoints(table(spark, sf, "markups"))
    return found.select("file", "url", F.col("line").cast("bigint").alias("line"),
                        F.col("column").cast("bigint").alias("column"), "context")


# --- C2, C3 ---------------------------------------------------------------
def _calls_sql(dialect: str, where: str) -> str:
    p = lit(rules.CALL_SITES[dialect])
    return f"""
SELECT file, i - 1 AS ord, regexp_extract(ms[i], {p}, 1) AS function,
  regexp_extract(ms[i], {p}, 2) AS argument
FROM (SELECT file, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT file, regexp_extract_all({hidden('text')}, {p}) AS ms FROM sources WHERE {where}))"""


_LAST = "upper(split_part(function, '.', -1))"
_VERB = f"CASE WHEN {_LAST} IN ('GET','POST','PUT','DELETE','PATCH') THEN {_LAST} ELSE 'GET' END"
# arguments with their escapes hidden
CALLS = f"SELECT *, {_VERB} AS verb FROM (" + " UNION ALL ".join(
    _calls_sql(k, f"language = '{v}'") for k, v in
    (("js", "javascript"), ("ts", "typescript"), ("py", "python"))) + ")"


@query("C2_call_endpoints", f"""
SELECT file, {shown(unquoted('argument'))} AS url, verb AS method FROM ({CALLS})
WHERE regexp_matches(argument, '^("[^"]*"|''[^'']*''|`[^`]*`)$')
  AND {is_api(shown(unquoted('argument')))}""",
       SRC)
def c2(spark, sf):
    return extract.call_endpoints(table(spark, sf, "sources")).select("file", "url", "method")


@query("C3_verb_inference", f"""
SELECT function, verb, count(*) AS n FROM ({CALLS}) GROUP BY 1, 2""", SRC)
def c3(spark, sf):
    return (extract.call_sites(table(spark, sf, "sources")).groupBy("function", "verb")
            .agg(F.count(F.lit(1)).alias("n")))


# --- C4, C5: one query per shape, all from the one-scan operator -----------
_QUOTES = "'\"''`'"


def _shape_sql(kind: str, family: str, pattern: str, verb_group: int, url_group: int) -> str:
    where = "language = 'python'" if family == "py" else "language <> 'python'"
    verb = f"upper(regexp_extract(m, {lit(pattern)}, {verb_group}))" if verb_group else "'GET'"
    url = f"regexp_extract(m, {lit(pattern)}, {url_group})"
    return f"""
SELECT file, {lit(kind)} AS kind, CASE WHEN {verb} IN {in_list(rules.HTTP_METHODS)} THEN {verb}
  ELSE 'GET' END AS verb, {shown(f"trim(regexp_replace({url}, '^[rbufRBUF]+', ''), {_QUOTES})")} AS url
FROM (SELECT file, unnest(regexp_extract_all({hidden('text')}, {lit(pattern)})) AS m
      FROM sources WHERE {where})"""


_LITERAL_MARKS = "chr(34), chr(39), chr(96), '/'"


def _config_sql(kinds: tuple) -> str:
    """Depths by a running sum; the bracket around a token is the last opened at its depth."""
    p = lit(rules.config_token([c[1] for c in kinds]))
    call = " ".join(f"WHEN regexp_full_match(m, {lit(c[1])}) THEN {lit(c[0])}" for c in kinds)
    return f"""
SELECT file, kind, 'GET' AS verb, {shown(f"trim(value, {_QUOTES})")} AS url FROM (
WITH tokens AS (
  SELECT r, file, pos, m, left(m, 1) AS c, left(m, 1) IN ('{{', '[', '(') OR right(m, 1) = '(' AS opens
  FROM (SELECT r, file, pos, ms[pos] AS m FROM (
    SELECT r, file, ms, unnest(range(1, len(ms) + 1)) AS pos FROM (
      SELECT row_number() OVER () AS r, file, regexp_extract_all({hidden('text')}, {p}) AS ms
      FROM sources WHERE language <> 'python')))
  WHERE left(m, 1) NOT IN ({_LITERAL_MARKS})),
deep AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN c IN ('}}', ']', ')') THEN -1 ELSE 0 END)
  OVER (PARTITION BY r ORDER BY pos) AS depth FROM tokens),
opened AS (SELECT *, CASE {call} END AS call FROM deep WHERE opens),
named AS (
  SELECT o.r, o.pos, o.depth, CASE WHEN o.c = '{{' THEN u.call END AS call
  FROM opened o ASOF LEFT JOIN opened u ON o.r = u.r AND o.depth - 1 = u.depth AND o.pos > u.pos)
SELECT d.file, n.call AS kind, regexp_extract(d.m, {lit(rules.CONFIG_VALUE)}, 1) AS value
FROM deep d ASOF JOIN named n ON d.r = n.r AND d.depth = n.depth AND d.pos >= n.pos
WHERE d.c IN ('{{', ',') AND length(d.m) > 1 AND n.call IS NOT NULL)"""


def _register_shape(name: str, shapes: tuple, configs: tuple) -> None:
    @query(name, "\nUNION ALL\n".join([*(_shape_sql(*s[:5]) for s in shapes), *(
        [_config_sql(configs)] if configs else [])]), SRC)
    def run(spark, sf):
        return extract.shaped_calls(table(spark, sf, "sources"), shapes, configs).select(
            "file", "kind", "verb", "url")


_SHAPE_NAMES = {
    "C4a_fetch": ("js", "fetch"), "C4b_fetch_template": ("js", "fetch_template"),
    "C4c_axios_method": ("js", "axios_method"), "C4d_axios_config": ("js", "axios_config"),
    "C4e_xhr_open": ("js", "xhr_open"), "C4f_jquery_ajax": ("js", "jquery_ajax"),
    "C4g_express_route": ("js", "express_route"), "C4h_url_constant": ("js", "url_constant"),
    "C4i_url_property": ("js", "url_property"), "C5a_requests": ("py", "requests_call"),
    "C5b_httpx": ("py", "httpx_call"), "C5c_session": ("py", "session_call"),
    "C5d_urllib": ("py", "urllib_call"), "C5e_route_decorator": ("py", "route_decorator"),
    "C5f_django_url": ("py", "django_url"), "C5g_url_constant": ("py", "url_constant")}
for _name, (_family, _kind) in _SHAPE_NAMES.items():
    _register_shape(_name, tuple(s for s in rules.SHAPES if s[:2] == (_kind, _family)),
                    tuple(c for c in rules.CONFIG_CALLS if c[0] == _kind))
_register_shape("C4_C5_all_shapes", rules.SHAPES, rules.CONFIG_CALLS)


# --- C6 to C10 ------------------------------------------------------------
def _defs_sql() -> str:
    parts = []
    for kind, p in rules.DEFINITIONS:
        parts.append(f"""
SELECT file, {kind} AS kind, i AS pos, ns[i] AS name, vs[i] AS value FROM (
  SELECT file, ns, vs, unnest(range(1, len(ns) + 1)) AS i FROM (
    SELECT file, regexp_extract_all(text, {lit(p)}, 1) AS ns,
      regexp_extract_all(text, {lit(p)}, 2) AS vs FROM sources))""")
    return (f"SELECT file, name, arg_min(value, kind * 1000000 + pos) AS value"
            f" FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2")


DEFS = _defs_sql()


@query("C6_variable_resolution", f"""
WITH defs AS ({DEFS}), calls AS ({CALLS})
SELECT c.file, c.ord, c.argument AS name, d.value FROM calls c
LEFT JOIN defs d ON d.file = c.file AND d.name = c.argument
WHERE regexp_matches(c.argument, '^[A-Za-z_$][\\w$]*$')""", SRC)
def c6(spark, sf):
    return resolve.resolve_call_names(table(spark, sf, "sources")).select(
        "file", F.col("ord").cast("bigint").alias("ord"), "name", "value")


@query("C6_definitions", DEFS, SRC)
def c6_defs(spark, sf):
    return resolve.resolved_names(resolve.definitions(table(spark, sf, "sources")))


@query("C6_alias_chains", f"""
SELECT * FROM (
WITH RECURSIVE defs AS ({DEFS.replace("sources", "aliased")}),
pairs AS (SELECT file, ns[i] AS name, ts[i] AS target, i FROM (
  SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM (
    SELECT file, regexp_extract_all(text, {lit(rules.ALIAS)}, 1) AS ns,
      regexp_extract_all(text, {lit(rules.ALIAS)}, 2) AS ts FROM aliased))),
edges AS (SELECT file, name, arg_min(target, i) AS target FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.file = p.file AND d.name = p.name) GROUP BY 1, 2),
walk AS (SELECT file, name, target, 1 AS n FROM edges
  UNION ALL SELECT w.file, w.name, e.target, n + 1 FROM walk w
  JOIN edges e ON e.file = w.file AND e.name = w.target WHERE n < 20),
ends AS (SELECT w.file, w.name, w.target FROM walk w
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.file = w.file AND e.name = w.target))
SELECT e.file, e.name, d.value, x.target IS NULL AS cyclic FROM edges e
LEFT JOIN ends x ON x.file = e.file AND x.name = e.name
LEFT JOIN defs d ON d.file = e.file AND d.name = x.target)""", ("aliased",))
def c6_aliases(spark, sf):
    files = table(spark, sf, "aliased")
    return resolve.resolve_aliases(resolve.aliases(files),
                                   resolve.resolved_names(resolve.definitions(files)))


@query("C7_concatenation", f"""
WITH defs AS ({DEFS}), calls AS ({CALLS}),
ops AS (SELECT file, ord, argument, i, os[i] AS op FROM (
  SELECT *, unnest(range(1, len(os) + 1)) AS i FROM (
    SELECT file, ord, argument, regexp_extract_all(argument, {lit(rules.OPERAND)}) AS os
    FROM calls WHERE contains(argument, '+') AND NOT regexp_matches(argument, '^("[^"]*"|''[^'']*'')$'))))
SELECT file, ord, {shown('argument')} AS argument, string_agg(part, '' ORDER BY i) AS url FROM (
  SELECT o.file, o.ord, o.argument, o.i, CASE WHEN regexp_matches(o.op, '^["''`]')
    THEN {shown(f"trim(o.op, {_QUOTES})")} ELSE d.value END AS part
  FROM ops o LEFT JOIN defs d ON d.file = o.file AND d.name = o.op)
WHERE part IS NOT NULL GROUP BY ALL""", SRC)
def c7(spark, sf):
    return resolve.resolve_concats(table(spark, sf, "sources")).select(
        "file", F.col("ord").cast("bigint").alias("ord"), "argument", "url")


@query("C8_template_literals", f"""
WITH defs AS ({DEFS}),
t AS (SELECT file, trim(m, '`') AS template, string_split_regex(trim(m, '`'), '\\$\\{{[^}}]*\\}}') AS fs,
    regexp_extract_all(trim(m, '`'), '\\$\\{{[^}}]*\\}}') AS hs FROM (
  SELECT file, unnest(regexp_extract_all({hidden('text')}, {lit(rules.LITERALS['js'])})) AS m
  FROM sources) WHERE starts_with(m, '`') AND contains(m, chr(36) || '{{')),
parts AS (
  SELECT file, template, 2 * i AS pos, fs[i] AS fixed, NULL AS name
    FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM t)
  UNION ALL
  SELECT file, template, 2 * i + 1, '', nullif(regexp_extract(hs[i],
      '^\\$\\{{\\s*([A-Za-z_$][\\w$]*)\\s*\\}}$', 1), '')
    FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM t))
SELECT p.file, {shown('template')} AS template, string_agg(CASE WHEN p.name IS NULL THEN {shown('fixed')}
    ELSE coalesce(d.value, chr(36) || '{{...}}') END, '' ORDER BY pos) AS resolved
FROM parts p LEFT JOIN defs d ON d.file = p.file AND d.name = p.name
GROUP BY p.file, template""".replace("{{", "{").replace("}}", "}"), SRC)
def c8(spark, sf):
    return resolve.resolve_templates(table(spark, sf, "sources")).select(
        "file", "template", "resolved")


_OBJECTS = f"""
SELECT file, obj, j, props[j] AS prop, vals[j] AS value, i FROM (
  SELECT *, unnest(range(1, len(props) + 1)) AS j FROM (
    SELECT file, i, ns[i] AS obj, regexp_extract_all(bs[i], {lit(rules.OBJECT_PROPERTY)}, 1) AS props,
      regexp_extract_all(bs[i], {lit(rules.OBJECT_PROPERTY)}, 2) AS vals FROM (
      SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM (
        SELECT file, regexp_extract_all(text, {lit(rules.OBJECT_LITERAL)}, 1) AS ns,
          regexp_extract_all(text, {lit(rules.OBJECT_LITERAL)}, 2) AS bs FROM sources))))"""


@query("C9_member_access", f"""
WITH calls AS ({CALLS}), props AS (
  SELECT file, obj, prop, arg_min(value, i * 100000 - j) AS value FROM ({_OBJECTS}) GROUP BY 1, 2, 3)
SELECT c.file, c.argument, p.value FROM calls c LEFT JOIN props p ON p.file = c.file
  AND p.obj = split_part(c.argument, '.', 1) AND p.prop = split_part(c.argument, '.', 2)
WHERE regexp_matches(c.argument, '^[A-Za-z_$][\\w$]*\\.[\\w$.]*$')""", SRC)
def c9(spark, sf):
    return resolve.resolve_members(table(spark, sf, "sources")).select("file", "argument", "value")


# the derived texts define API_BASE, USERS and the two cfg properties in order
@query("C10_constant_substitution", """
SELECT page_id, CASE WHEN page_id % 5 = 0
  THEN 'X https://' || host || ' /api/v1/users/' || num || ' $' || '{nope}'
  ELSE 'X https://' || host || '/api/v' || v || ' /users/' || num || ' $' || '{nope}' END AS filled
FROM page_parts""", SRC)
def c10(spark, sf):
    template = F.when(F.col("language") == "python", F.lit("X {API_HOST} ${USERS} ${nope}")) \
        .otherwise(F.lit("X ${API_BASE} {USERS} ${nope}"))
    return table(spark, sf, "sources").select(
        "page_id", resolve.substitute(template, resolve.tracked_constants(F.col("text")))
        .alias("filled"))


# --- the corpus stage as a whole -------------------------------------------
@query("corpus_stage", f"""
WITH defs AS ({DEFS}), calls AS ({CALLS}),
lits AS (SELECT file, url FROM ({_literal_sql("js", "language <> 'python'")}) UNION ALL
  SELECT file, url FROM ({_literal_sql("py", PY)})),
ops AS (SELECT file, ord, verb, i, os[i] AS op FROM (
  SELECT *, unnest(range(1, len(os) + 1)) AS i FROM (
    SELECT file, ord, verb, regexp_extract_all(argument, {lit(rules.OPERAND)}) AS os FROM calls
    WHERE (contains(argument, '+') AND NOT regexp_matches(argument, '^("[^"]*"|''[^'']*'')$'))
      OR regexp_matches(argument, '^[A-Za-z_$][\\w$]*$')))),
chains AS (SELECT file, ord, verb, string_agg(part, '' ORDER BY i) AS url FROM (
  SELECT o.file, o.ord, o.verb, o.i, CASE WHEN regexp_matches(o.op, '^["''`]')
    THEN {shown(f"trim(o.op, {_QUOTES})")} ELSE d.value END AS part
  FROM ops o LEFT JOIN defs d ON d.file = o.file AND d.name = o.op)
  WHERE part IS NOT NULL GROUP BY 1, 2, 3)
SELECT file, url, 'GET' AS method, 'literal' AS match_kind FROM lits
UNION ALL
SELECT file, {shown(unquoted('argument'))}, verb, 'call' FROM calls
  WHERE regexp_matches(argument, '^("[^"]*"|''[^'']*''|`[^`]*`)$')
    AND {is_api(shown(unquoted('argument')))}
UNION ALL SELECT file, url, verb, 'resolved' FROM chains WHERE {is_api('url')}""", SRC)
def corpus_stage(spark, sf):
    return stages.parse_corpus(table(spark, sf, "sources"))["endpoints"]


# --- C11 to C17 -----------------------------------------------------------
@query("C11_script_assets", f"""
SELECT ord, url FROM assets WHERE ends_with(url, '.js') OR contains(url, '.js?') OR
  {' OR '.join(f"contains(lower(coalesce(content_type, '')), {lit(t)})"
               for t in rules.SCRIPT_CONTENT_TYPES)}""", ("assets",))
def c11(spark, sf):
    return extract.script_assets(table(spark, sf, "assets")).select("ord", "url")


@query("C12_size_limit", """
SELECT ord FROM assets WHERE content_length IS NULL OR content_length <= 10 * 1024 * 1024""",
       ("assets",))
def c12(spark, sf):
    return extract.within_size(table(spark, sf, "assets"), max_mb=rules.MAX_SCRIPT_MB).select("ord")


_SCRIPT = r"'(?is)<script\b([^>]*)>(.*?)</script>'"


@query("C13_inline_scripts", f"""
SELECT page_id, i - 1 AS idx, 'inline_' || (i - 1) || '_' || left(md5(bs[i]), 8) || '.js' AS name,
  length(bs[i]) AS size_chars FROM (
  SELECT page_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM (
    SELECT page_id, list_filter(regexp_extract_all(html, {_SCRIPT}, 2), lambda b: length(b) > 0) AS bs
    FROM pages))""")
def c13(spark, sf):
    return extract.inline_scripts(table(spark, sf, "pages"), min_len=0).select(
        "page_id", F.col("idx").cast("bigint").alias("idx"), "name",
        F.col("size_chars").cast("bigint").alias("size_chars"))


@query("C14_source_maps", """
SELECT page_id, '../maps/' || lang || '.js.map' AS map_ref,
  'https://' || host || '/maps/' || lang || '.js.map' AS map_url
FROM page_parts WHERE page_id % 5 <> 0""", SRC)
def c14(spark, sf):
    scripts = table(spark, sf, "sources").withColumn("url", F.concat(
        F.lit("https://"), F.split_part("file", F.lit("/"), F.lit(2)), F.lit("/js/app.js")))
    return extract.source_maps(scripts).select("page_id", "map_ref", "map_url")


def _bits(x: str) -> str:
    return (f"-list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: "
            f"((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE) * "
            f"log2((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE)))")


def _entropy(x: str) -> str:
    return f"round({_bits(x)}, 9)"


def _secret_sql(name, pattern, severity, floor, _words) -> str:
    group = 1 if "([" in pattern else 0
    gate = f"WHERE {_entropy('g')} >= {floor}" if floor is not None else ""
    return f"""
SELECT doc_id, {lit(name)} AS type, {lit(severity)} AS severity, g AS value,
  {line_of('text')} AS line, {column_of('text')} AS "column"
FROM ({placed('documents', 'doc_id', 'text', pattern, group)}) {gate}"""


SECRETS = "\nUNION ALL\n".join(_secret_sql(*r) for r in rules.SECRET_RULES)


def _secrets(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    return extract.secrets(docs)


@query("C15_secret_scan", SECRETS)
def c15(spark, sf):
    return _secrets(spark, sf).select(
        F.col("file").alias("doc_id"), "type", "severity", "value",
        F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("column"))


def _source_secret_sql(name, pattern, severity, floor, _words) -> str:
    group = 1 if "([" in pattern else 0
    gate = f"WHERE {_entropy('g')} >= {floor}" if floor is not None else ""
    return f"SELECT file FROM ({placed('sources', 'file', 'text', pattern, group)}) {gate}"


@query("C16_file_summary", f"""
SELECT file, count(*) FILTER (WHERE k = 'e') AS endpoint_count,
  count(*) FILTER (WHERE k = 's') AS secret_count, count(*) FILTER (WHERE k = 'x') AS error_count
FROM (SELECT file, 'e' AS k FROM ({ENDPOINTS})
  UNION ALL SELECT file, 's' FROM ({" UNION ALL ".join(_source_secret_sql(*r) for r in rules.SECRET_RULES)})
  UNION ALL SELECT file, 'x' FROM sources WHERE ends_with(file, '.mjs')) GROUP BY 1""", SRC)
def c16(spark, sf):
    # files of one extension stand for those that could not be read
    rows = table(spark, sf, "sources")
    return extract.file_summary(extract.literal_endpoints(rows), extract.secrets(rows),
                                rows.where(F.col("file").endswith(".mjs")))


@query("C17_links", f"""
SELECT page_id, i - 1 AS idx, hs[i] AS href, regexp_extract(url, '^(https?://[^/?#]*)', 1)
  || hs[i] AS target
FROM (SELECT page_id, url, hs, unnest(range(1, len(hs) + 1)) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages))""")
def c17(spark, sf):
    return extract.links(table(spark, sf, "pages")).select(
        "page_id", F.col("idx").cast("bigint").alias("idx"), "href", "target")


# --- D --------------------------------------------------------------------
_CARD, _IP = rules.PII_RULES[3][1], rules.PII_RULES[4][1]


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({d}), ''),"
            f" lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9"
            f" ELSE c::INT * 2 END)) % 10 = 0)")


def _found_sql(kind: str, pattern: str, t: str, checksums: bool = True) -> str:
    if kind == "credit_card":
        test = f"NOT regexp_matches(m, {lit(rules.UUID)})" + (f" AND {luhn('m')}" if checksums else "")
        return f"len(list_filter(regexp_extract_all({t}, {lit(pattern)}), lambda m: {test})) > 0"
    if kind == "api_key_generic":
        return (f"len(list_filter(regexp_extract_all({t}, {lit(pattern)}, 1), lambda m:"
                f" {_entropy('m')} >= 3.5)) > 0")
    return f"regexp_matches({t}, {lit(pattern)})"


def _types_sql(t: str, checksums: bool = True) -> str:
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {_found_sql(k, p, t, checksums)} THEN {lit(k)} END"
        for k, p, _ in rules.PII_RULES) + "], lambda t: t IS NOT NULL), ',')"


def _redact_sql(source: str, key: str, checksums: bool = True) -> str:
    sql = f"SELECT {key}, text AS t FROM {source}"
    for kind, pattern, _ in rules.PII_RULES:
        p, label = lit(pattern), lit(f"[REDACTED:{kind.upper()}]")
        if kind in ("credit_card", "api_key_generic"):
            test = (f"NOT regexp_matches(m, {lit(rules.UUID)})"
                    + (f" AND {luhn('m')}" if checksums else "")) if kind == "credit_card" else \
                f"{_entropy(f'regexp_extract(m, {p}, 1)')} >= 3.5"
            new = label if kind == "credit_card" else \
                f"replace(m, regexp_extract(m, {p}, 1), '[REDACTED:API_KEY]')"
            expr = (f"array_to_string(list_transform(list_zip(string_split_regex(t, {p}),"
                    f" list_transform(regexp_extract_all(t, {p}), lambda m: CASE WHEN {test}"
                    f" THEN {new} ELSE m END)), lambda z: z[1] || coalesce(z[2], '')), '')")
        else:
            expr = f"regexp_replace(t, {p}, {label}, 'g')"
        sql = f"SELECT {key}, {expr} AS t FROM ({sql})"
    return sql


CORPUS = ("(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL"
          " SELECT 'c' || conv_id || '-' || turn, text FROM conversations)")


def corpus(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(turns)


@query("D1_pii_types", f"SELECT id, {_types_sql('text')} AS types FROM {CORPUS}")
def d1(spark, sf):
    return corpus(spark, sf).select("id", F.array_join(pii.pii_types("text"), ",").alias("types"))


@query("D2_redact", f"SELECT id, md5(t) AS digest, length(t) AS n FROM ({_redact_sql(CORPUS, 'id')})")
def d2(spark, sf):
    return corpus(spark, sf).withColumn("t", pii.redact("text")).select(
        "id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


# sources carry provider keys: the documents hold none of them
_KEYED = """(SELECT page_id, 'k=sk_live_' || md5(url) || ' AKIA' || upper(left(md5(html), 16))
  || ' ghp_' || md5(url) || 'abcd AIza' || md5(url) || 'x-y api_key: "' || md5(html) || md5(url)
  || '" Bearer a' || num || '.b_' || lang || '.c Basic ' || md5(host)
  || '== -----BEGIN RSA PRIVATE KEY----- 123-45-' || lpad(num, 4, '0')
  || ' secret_key=aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ' AS text FROM {0})"""


@query("D2_redact_keys", f"SELECT page_id, t FROM ({_redact_sql(_KEYED.format('page_parts'), 'page_id')})",
       ("page_parts",))
def d2_keys(spark, sf):
    keyed = spark.sql("SELECT * FROM " + _KEYED.format("{page_parts}"),
                      page_parts=table(spark, sf, "page_parts"))
    return keyed.select("page_id", pii.redact("text").alias("t"))


@query("D1_pii_types_keys",
       f"SELECT page_id, {_types_sql('text')} AS types FROM {_KEYED.format('page_parts')}",
       ("page_parts",))
def d1_keys(spark, sf):
    keyed = spark.sql("SELECT * FROM " + _KEYED.format("{page_parts}"),
                      page_parts=table(spark, sf, "page_parts"))
    return keyed.select("page_id", F.array_join(pii.pii_types("text"), ",").alias("types"))


_CARDS = f"(SELECT doc_id, unnest(regexp_extract_all(text, {lit(_CARD)})) AS m FROM documents)"


@query("D3_luhn", f"SELECT doc_id, m, {luhn('m')} AS ok FROM {_CARDS}")
def d3(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CARD), F.lit(0))).alias("m")
    ).withColumn("ok", pii.luhn_ok("m"))


@query("D4_entropy", f"SELECT doc_id, round({_bits('text')}, 6) AS bits FROM documents")
def d4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(pii.entropy("text"), 6).alias("bits"))


@query("D5_uuid_guard", f"""
SELECT event_id, regexp_matches(s, {lit(rules.UUID)}) AS has_uuid FROM (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN md5(props) ELSE
    left(md5(props), 8) || '-' || substr(md5(props), 9, 4) || '-' || upper(substr(md5(props), 13, 4))
    || '-' || substr(md5(props), 17, 4) || '-' || substr(md5(props), 21, 12) END AS s FROM events)""")
def d5(spark, sf):
    h = F.md5("props")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                         F.upper(F.substring(h, 13, 4)), F.substring(h, 17, 4),
                         F.substring(h, 21, 12))
    s = F.when(F.col("event_id") % 2 == 0, h).otherwise(dashed)
    return table(spark, sf, "events").select("event_id", pii.has_uuid(s).alias("has_uuid"))


@query("D6_key_validity", f"""
SELECT doc_id, w, {_entropy('w')} >= 3.5 AS ok FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{12,}}')) AS w FROM documents)""")
def d6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{12,}"), F.lit(0)))
        .alias("w")).withColumn("ok", pii.key_ok("w"))


_EMAIL = rules.PII_RULES[0][1]
_TOKENS = f"""(SELECT doc_id, unnest(list_concat(regexp_extract_all(text, {lit(_EMAIL)}),
  regexp_extract_all(text, '[0-9]{{3}}-[0-9]{{4}}'))) AS w FROM documents)"""


def _tokens(spark, sf):
    both = F.concat(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0)),
                    F.regexp_extract_all("text", F.lit("[0-9]{3}-[0-9]{4}"), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", F.explode(both).alias("w"))


@query("D7_secret_mask", f"""
SELECT doc_id, CASE WHEN length(w) > 12 THEN left(w, 4) || repeat('*', length(w) - 8) || right(w, 4)
  ELSE repeat('*', length(w)) END AS masked FROM {_TOKENS}""")
def d7(spark, sf):
    return _tokens(spark, sf).select("doc_id", pii.mask("w").alias("masked"))


@query("D8_short_mask", f"SELECT doc_id, left(w, 4) || '...' || right(w, 4) AS short FROM {_TOKENS}")
def d8(spark, sf):
    return _tokens(spark, sf).select("doc_id", pii.short_mask("w").alias("short"))


@query("D9_redaction_switches", f"""
SELECT d.doc_id, md5(text) AS disabled, md5(t) AS no_checksum, {_types_sql('text', False)} AS types
FROM documents d JOIN ({_redact_sql('documents', 'doc_id', False)}) r ON r.doc_id = d.doc_id""")
def d9(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(pii.redact("text", enabled=False)).alias("disabled"),
        F.md5(pii.redact("text", checksums=False)).alias("no_checksum"),
        F.array_join(pii.pii_types("text", checksums=False), ",").alias("types"))

