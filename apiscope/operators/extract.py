"""Text to rows: endpoints, call sites, secrets, scripts, links.

Every extractor is one projection with one explode over the text, so the text
is scanned once and never shuffled.  Matching is lexical (comments and escapes
are honoured, nesting is not), and ``match_kind`` says how a row was found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import pii, urls
from ..functions.core import (any_of, as_col, contains_any, exact_text, hinted, let, marked,
                              marked_positions, matches)
from .nesting import config_pairs

# Characters that would read as syntax after a backslash, and the two letters
# (Unicode noncharacters, so in no text) that stand for the pair meanwhile.
_ESCAPED = "\\\"'`\n$/*#"
_FILLER = "\ufdef"
_MASKS = [("\\" + c, chr(0xFDD0 + i) + _FILLER) for i, c in enumerate(_ESCAPED)]


def masked(text: Column | str) -> Column:
    """Escapes that could be taken for syntax hidden, length unchanged.

    Backslashes pair from the left, so the doubled one is hidden first.
    """
    t = as_col(text)
    hidden = reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), _MASKS, t)
    return F.when(t.contains("\\"), hidden).otherwise(t)


def restored(value: Column) -> Column:
    """A piece of masked text as it stands in the source."""
    shown = reduce(lambda x, m: F.replace(x, F.lit(m[1]), F.lit(m[0])), _MASKS, value)
    return F.when(value.contains(_FILLER), shown).otherwise(value)


def language_of(path: Column | str) -> Column:
    """Language by file extension, any case; NULL if unknown."""
    ext = F.regexp_extract(F.lower(as_col(path)), r"[^/]\.([a-z]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in rules.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, ext)


def dialect_of(language: Column | str) -> Column:
    """Token family: TypeScript is read as JavaScript, anything else as markup."""
    language = as_col(language)
    return (F.when(language.isin("javascript", "typescript"), F.lit("js"))
            .when(language == "python", F.lit("py")).otherwise(F.lit("html")))


def _literals(text: Column, dialect: Column) -> Column:
    """API-like literal tokens with their positions; comments are dropped.

    A token is a comment or begins with a quote, whatever the dialect, so one
    fold serves all three.
    """
    tokens = (F.when(dialect == "js", marked(text, rules.LITERALS["js"]))
              .when(dialect == "py", marked(text, rules.LITERALS["py"]))
              .otherwise(marked(text, rules.LITERALS["html"])))
    return marked_positions(tokens, keep=lambda m: ~_starts_with_any(
        m, ("//", "/*", "#", "<!--")) & urls.is_api_url(restored(_unquoted(m))))


def _starts_with_any(text: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.startswith(w)
    return test


def _unquoted(literal: Column) -> Column:
    return F.regexp_replace(literal, "^['\"`]+|['\"`]+$", "")


def literal_rows(text: Column, language: Column, clean: Column | None = None) -> Column:
    """array<struct<url, line, column>> of the API-like literals; NULL if hopeless.

    ``clean`` is the masked text where the caller has it already.
    """
    lang = dialect_of(language)
    # a text without any of the path words holds no API URL in any dialect
    promising = text.rlike(r"(?i)/(?:api|v\d|graphql|rest|ws|auth|admin|user|public)")

    def rows(t: Column) -> Column:
        # all that needs the text happens before the explode, so no row carries it
        return F.transform(_literals(t, lang), lambda x: F.struct(
            restored(_unquoted(exact_text(t, x["m"], x["at"]))).alias("url"),
            x["line"], x["column"]))

    return F.when(promising, let(masked(text), rows) if clean is None else rows(clean))


def literal_endpoints(files: DataFrame, *, path: str = "file", text: str = "text",
                      language: str = "language") -> DataFrame:
    """String literals that look like API URLs, with line, column and context."""
    rows = files.select(F.col(path).alias("file"),
                        F.inline(literal_rows(F.col(text), F.col(language))))
    return as_literal_endpoints(rows)


def as_literal_endpoints(rows: DataFrame) -> DataFrame:
    return rows.select("file", "url", F.lit("GET").alias("method"), "line", "column",
                       urls.snippet("url").alias("context"), F.lit("literal").alias("match_kind"))


def verb_of(name: Column | str) -> Column:
    """HTTP verb named by a method, GET for any other name."""
    verb = F.upper(as_col(name))
    return F.when(verb.isin(*rules.INFERRED_VERBS), verb).otherwise(F.lit("GET"))


def by_client(language: Column, choose) -> Column:
    """``choose(family)`` of the language's client names; NULL without any."""
    return (F.when(language == "typescript", choose("ts")).when(language == "javascript", choose("js"))
            .when(language == "python", choose("py")))


def call_rows(text: Column, language: Column, clean: Column | None = None) -> Column:
    """array<struct<function, argument>> of the client calls; NULL for other languages."""
    def calls(t: Column, pattern: str) -> Column:
        return F.transform(matches(t, pattern), lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("function"),
            restored(F.regexp_extract(m, pattern, 2)).alias("argument")))

    def rows(t: Column) -> Column:
        return by_client(language, lambda k: calls(t, rules.CALL_SITES[k]))

    return let(masked(text), rows) if clean is None else rows(clean)


def call_sites(files: DataFrame, *, path: str = "file", text: str = "text",
               language: str = "language") -> DataFrame:
    """Calls of HTTP client functions with their first argument.

    ``function`` is the last part of the callee in JavaScript and the dotted
    name in Python.  ``argument`` is a literal, a name, a member or a ``+``
    chain; ``arg_kind`` says which.  ``ord`` numbers the calls of a file.
    """
    found = call_rows(F.col(text), F.col(language))
    return as_call_sites(
        files.select(F.col(path).alias("file"), F.posexplode(found).alias("ord", "c"))
        .select("file", "ord", "c.function", "c.argument"))


def is_literal(argument: Column) -> Column:
    return argument.rlike(r"(?s)^(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`(?:[^`\\]|\\.)*+`)$")


def as_call_sites(rows: DataFrame) -> DataFrame:
    arg = F.col("argument")
    kind = (
        F.when(arg.rlike(r"(?s)^(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+')$"), F.lit("literal"))
        .when(arg.rlike(r"(?s)^`(?:[^`\\]|\\.)*+`$"), F.lit("template"))
        .when(arg.rlike(r"^[A-Za-z_$][\w$]*$"), F.lit("name"))
        .when(arg.rlike(r"^[A-Za-z_$][\w$.]*$"), F.lit("member"))
        .otherwise(F.lit("concat"))
    )
    return (rows.withColumn("verb", verb_of(F.substring_index("function", ".", -1)))
            .withColumn("arg_kind", kind))


def call_endpoints(files: DataFrame, **columns: str) -> DataFrame:
    """Call sites whose literal first argument is an API URL."""
    return literal_calls(call_sites(files, **columns))


def literal_calls(calls: DataFrame) -> DataFrame:
    url = restored(_unquoted(masked("argument")))
    return (
        calls.where(F.col("arg_kind").isin("literal", "template"))
        .select("file", "ord", url.alias("url"), F.col("verb").alias("method"),
                F.lit("call").alias("match_kind"))
        .where(urls.is_api_url("url"))
    )


def shaped_calls(files: DataFrame, shapes: Sequence[tuple] = rules.SHAPES,
                 configs: Sequence[tuple] = rules.CONFIG_CALLS, *,
                 path: str = "file", text: str = "text",
                 language: str = "language") -> DataFrame:
    """Known source shapes: clients, routes, constants, and configuration objects.

    Each of ``shapes`` contributes an array of (kind, verb, url, ord); the arrays
    are joined in the row and exploded once.  A plain-word test keeps the regex
    off texts that cannot match.  Objects of ``configs`` are found by the depth
    of their brackets (`nesting.config_pairs`).
    """
    found = []
    if shapes:
        found.append(_plain_shapes(files, shapes, path, text, language))
    if configs:
        found.append(config_calls(files, configs, path=path, text=text, language=language))
    return reduce(DataFrame.unionByName, found)


def config_calls(files: DataFrame, configs: Sequence[tuple] = rules.CONFIG_CALLS, *,
                 path: str = "file", text: str = "text", language: str = "language") -> DataFrame:
    """file, kind, ord, verb, url of calls by a configuration object with a ``url``."""
    words = [w for _, _, hints in configs for w in hints]
    scripts = files.where((dialect_of(language) == "js") & contains_any(F.col(text), words)).select(
        F.col(path).alias("file"), masked(text).alias("text"))
    return config_pairs(scripts, configs).select(
        "file", "kind", "ord", F.lit("GET").alias("verb"),
        restored(_unquoted(F.col("value"))).alias("url"))


def _plain_shapes(files: DataFrame, shapes: Sequence[tuple], path: str, text: str,
                  language: str) -> DataFrame:
    dialect = dialect_of(language)
    none = F.array().cast("array<struct<kind:string,ord:int,verb:string,url:string>>")

    def hits(t: Column, shape: tuple) -> Column:
        kind, family, pattern, verb_group, url_group, words = shape
        found = F.transform(
            matches(t, pattern),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("ord"),
                (F.upper(F.regexp_extract(m, pattern, verb_group)) if verb_group
                 else F.lit("GET")).alias("verb"),
                restored(_unquoted(F.regexp_replace(F.regexp_extract(m, pattern, url_group),
                                                    r"^[rbufRBUF]+", ""))).alias("url"),
            ))
        return F.when((dialect == family) & contains_any(t, words), found).otherwise(none)

    every = let(masked(text), lambda t: F.concat(*[hits(t, s) for s in shapes]))
    return (
        files.select(F.col(path).alias("file"), F.inline(every))
        .withColumn("verb", F.when(F.col("verb").isin(*rules.HTTP_METHODS), F.col("verb"))
                    .otherwise(F.lit("GET")))
    )


def inline_scripts(pages: DataFrame, *, key: str = "page_id", html: str = "html",
                   min_len: int) -> DataFrame:
    """Script elements without ``src`` and with more than ``min_len`` characters."""
    element = r"(?is)<script\b([^>]*)>(.*?)</script>"
    both = F.arrays_zip(matches(F.col(html), element, 1).alias("attrs"),
                        matches(F.col(html), element, 2).alias("body"))
    kept = F.filter(both, lambda s: ~s["attrs"].rlike(r"(?i)(?:^|\s)src(?:\s|=|$)")
                    & (F.length(s["body"]) > min_len))
    return (
        pages.select(F.col(key), F.posexplode(kept).alias("idx", "s"))
        .select(
            key, "idx",
            F.concat(F.lit("inline://script_"), F.col("idx")).alias("url"),
            F.concat(F.lit("inline_"), F.col("idx"), F.lit("_"),
                     F.substring(F.md5("s.body"), 1, 8), F.lit(".js")).alias("name"),
            F.length("s.body").alias("size_chars"),
            F.col("s.body").alias("content"),
        )
    )


def links(pages: DataFrame, *, key: str = "page_id", url: str = "url",
          html: str = "html") -> DataFrame:
    """Link targets of a page with the URL they resolve to."""
    found = matches(F.col(html), r'href="([^"]*)"', 1)
    return (
        pages.select(F.col(key), F.col(url).alias("base"),
                     F.posexplode(found).alias("idx", "href"))
        .withColumn("target", urls.resolve("base", "href"))
    )


def script_assets(responses: DataFrame, *, url: str = "url",
                  content_type: str = "content_type") -> DataFrame:
    """Recorded responses that carry JavaScript, by type or by URL."""
    by_type = F.lower(F.coalesce(F.col(content_type), F.lit(""))).rlike(
        any_of(rules.SCRIPT_CONTENT_TYPES))
    u = F.col(url)
    return responses.where(by_type | u.endswith(".js") | u.contains(".js?"))


def within_size(assets: DataFrame, *, max_mb: float,
                length: str = "content_length") -> DataFrame:
    """Drop assets whose declared length is over the limit; unknown passes."""
    size = F.col(length)
    return assets.where(size.isNull() | (size / (1024 * 1024) <= max_mb))


def source_maps(scripts: DataFrame, *, url: str = "url", text: str = "text") -> DataFrame:
    """First source-map reference of each script, resolved; ``data:`` skipped."""
    ref = F.trim(F.regexp_extract(F.col(text), rules.SOURCE_MAP, 1))
    return (
        scripts.where(F.col(text).contains("sourceMappingURL="))
        .withColumn("map_ref", ref)
        .where((F.col("map_ref") != "") & ~F.col("map_ref").startswith("data:"))
        .withColumn("map_url", urls.resolve(url, "map_ref"))
    )


_SECRET = "array<struct<type:string,severity:string,value:string,line:int,column:int>>"


def secret_rows(t: Column, table: Sequence[tuple] = rules.SECRET_RULES) -> Column:
    """array<struct<type, severity, value, line, column>> of all rules' hits.

    The texts marked by each rule that hits go through one and the same fold.
    """
    marks = F.array(*[F.when(hinted(t, pattern, hint) & t.rlike(pattern), marked(t, pattern))
                      for _, pattern, _, _, hint in table])
    none = F.array().cast(_SECRET)

    def hits(places: Column, number: int, rule: tuple) -> Column:
        name, pattern, severity, floor, _ = rule
        grouped = re.compile(pattern).groups
        found = F.transform(F.get(places, F.lit(number)), lambda x: F.struct(
            F.lit(name).alias("type"), F.lit(severity).alias("severity"),
            # the group is cut from the short match
            (F.regexp_extract(x["m"], pattern, 1) if grouped else x["m"]).alias("value"),
            x["line"].alias("line"), x["column"].alias("column")))
        if floor is not None:
            found = F.filter(found, lambda z: F.round(pii.entropy(z["value"]), 9) >= floor)
        return F.coalesce(found.cast(_SECRET), none)

    places = F.transform(marks, lambda m: F.when(m.isNotNull(), marked_positions(m)))
    return let(places, lambda p: F.concat(*[hits(p, n, rule) for n, rule in enumerate(table)]))


def secrets(files: DataFrame, table: Sequence[tuple] = rules.SECRET_RULES, *,
            path: str = "file", text: str = "text") -> DataFrame:
    """Rule hits with value, severity, line and column.

    A rule is (name, pattern, severity, lowest entropy or None, plain words);
    group 1 of the pattern is the value if there is a group, else the match.
    """
    return files.select(F.col(path).alias("file"), F.inline(secret_rows(F.col(text), table)))


def file_summary(endpoints: DataFrame, secret_rows: DataFrame,
                 errors: DataFrame | None = None) -> DataFrame:
    """Counts per file; files with nothing to report do not appear.

    The three inputs are reduced to narrow (file, kind) rows, so one shuffle of
    partial counts does the work.
    """
    parts = [endpoints.select("file", F.lit("endpoint").alias("k")),
             secret_rows.select("file", F.lit("secret").alias("k"))]
    if errors is not None:
        parts.append(errors.select("file", F.lit("error").alias("k")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("file").agg(
        *[F.count_if(F.col("k") == k).alias(f"{k}_count") for k in
          ("endpoint", "secret", "error")])


def parameter_inventory(inventory: DataFrame, *, url: str = "url",
                        sensitive: Sequence[str] = rules.SENSITIVE_PARAMS) -> DataFrame:
    """One row per query parameter of a URL, with the sensitive-name flag."""
    return (
        inventory.select("*", F.inline(urls.query_params(url)))
        .withColumn("is_sensitive", F.col("name").isin(*sensitive))
    )


def parameter_counts(inventory: DataFrame, *, url: str = "url",
                     sensitive: Sequence[str] = rules.SENSITIVE_PARAMS) -> DataFrame:
    """URLs per parameter name, partial counts before the shuffle."""
    return (
        parameter_inventory(inventory, url=url, sensitive=sensitive)
        .groupBy("name", "is_sensitive").agg(F.count(F.lit(1)).alias("uses"))
    )
