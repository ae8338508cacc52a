"""Names in source text to their string values.

Definitions and references are exploded from the texts into narrow rows and
joined on (file, name).  Definitions are reduced to one row per (file, name)
first, so the join cannot multiply rows and a much-used name is a plain hash
lookup that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.core import let, matches
from ..functions.urls import is_api_url
from .extract import (as_call_sites, as_literal_endpoints, by_client, call_rows, call_sites,
                      is_literal, literal_rows, masked, restored, secret_rows)


def definition_rows(text: Column) -> Column:
    """array<struct<kind, pos, name, value>>; kind is the priority of the pattern."""
    def found(kind: int, pattern: str) -> Column:
        # one pass over the text; the groups are cut from the short matches
        return F.transform(matches(text, pattern), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"),
            F.regexp_extract(m, pattern, 1).alias("name"),
            F.regexp_extract(m, pattern, 2).alias("value")))

    return F.concat(*[found(kind, pattern) for kind, pattern in rules.DEFINITIONS])


def definitions(files: DataFrame, *, path: str = "file", text: str = "text",
                only: Column | None = None) -> DataFrame:
    """All (file, kind, pos, name, value) of the files where ``only`` holds."""
    rows = definition_rows(F.col(text))
    return files.select(F.col(path).alias("file"),
                        F.inline(rows if only is None else F.when(only, rows)))


def needs_resolution(text: str = "text", language: str = "language") -> Column:
    """The file has a client call that no literal answers.

    Most files of a corpus have none, so their definitions are neither
    extracted nor shuffled.
    """
    t = masked(text)
    return by_client(F.col(language), lambda k: t.rlike(rules.UNRESOLVED_CALLS[k]))


def _definitions_for_calls(files: DataFrame, columns: dict) -> DataFrame:
    only = needs_resolution(**{k: v for k, v in columns.items() if k != "path"})
    return definitions(files, only=only, **_without_language(columns))


def resolved_names(defs: DataFrame) -> DataFrame:
    """One value per (file, name): lowest kind, then first in the file."""
    return defs.groupBy("file", "name").agg(
        F.min_by("value", F.struct("kind", "pos")).alias("value"))


def resolve_names(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Value of every reference (file, name); NULL where nothing defines it."""
    return refs.join(resolved_names(defs), ["file", "name"], "left")


def aliases(files: DataFrame, *, path: str = "file", text: str = "text") -> DataFrame:
    """(file, name, target): names given to other names, the first target of each."""
    pairs = F.transform(matches(F.col(text), rules.ALIAS), lambda m, i: F.struct(
        i.alias("pos"), F.regexp_extract(m, rules.ALIAS, 1).alias("name"),
        F.regexp_extract(m, rules.ALIAS, 2).alias("target")))
    return files.select(F.col(path).alias("file"), F.inline(pairs)).groupBy("file", "name").agg(
        F.min_by("target", "pos").alias("target"))


def resolve_aliases(names: DataFrame, values: DataFrame) -> DataFrame:
    """(file, name, value, cyclic) of every name of ``names`` (file, name, target).

    ``values`` has one value per (file, name); a name with a value of its own is
    no alias.  Names and targets are a graph in which each name has one way on, so
    pointer jumping finds all ends: in every round a name takes its target's
    target, which doubles the way it has gone.  A chain of n names is done in
    log2(n) rounds, each one join written to the work folder.  What still points
    at an alias then is, or leads to, a cycle: it has no value, nor has a name
    whose chain ends in one that nothing defines.
    """
    edges = _kept(names.join(values, ["file", "name"], "left_anti").select("file", "name", "target"))
    longest = edges.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = edges
    for _ in range(longest.bit_length()):
        onward = reached.select("file", F.col("name").alias("target"), F.col("target").alias("next"))
        reached = _kept(reached.join(onward, ["file", "target"], "left").select(
            "file", "name", F.coalesce("next", "target").alias("target")))
    ends = values.select("file", F.col("name").alias("target"), "value")
    turns = edges.select("file", F.col("name").alias("target"), F.lit(True).alias("cyclic"))
    return reached.join(ends, ["file", "target"], "left").join(turns, ["file", "target"], "left").select(
        "file", "name", "value", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as a table of the work folder."""
    from ..sources.files import work_path

    path = work_path(df.sparkSession, "aliases")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_aliases(files: DataFrame, *, path: str = "file", text: str = "text") -> DataFrame:
    """As `definitions`, with the names that are given others' values (kind after all literals)."""
    defs = definitions(files, path=path, text=text)
    chased = resolve_aliases(aliases(files, path=path, text=text), resolved_names(defs))
    return defs.unionByName(chased.where(F.col("value").isNotNull()).select(
        "file", F.lit(len(rules.DEFINITIONS)).alias("kind"), F.lit(0).alias("pos"), "name", "value"))


def _operands(chain: Column) -> Column:
    """Operands of a ``+`` chain with the depth of each.

    ``a + b + c`` nests to the left, so the last operand is at depth 1 and the
    first one deepest; a name costs one level more than a literal.
    """

    def numbered(ops: Column) -> Column:
        n = F.size(ops)
        return F.transform(ops, lambda o, i: F.struct(
            i.alias("pos"), restored(o).alias("op"),
            (F.when(i == 0, n - 1).otherwise(n - i)
             + F.when(o.rlike("^[\"'`]"), F.lit(0)).otherwise(F.lit(1))).alias("depth")))

    return let(matches(masked(chain), rules.OPERAND), numbered)


def resolve_concats(files: DataFrame, *, max_depth: int | None = None,
                    kinds: tuple = ("concat",), **columns: str) -> DataFrame:
    """Client calls whose first argument is a ``+`` chain, resolved."""
    return resolve_chains(call_sites(files, **columns), _definitions_for_calls(files, columns),
                          max_depth=max_depth, kinds=kinds)


def resolve_chains(calls: DataFrame, defs: DataFrame, *, max_depth: int | None = None,
                   kinds: tuple = ("concat",)) -> DataFrame:
    """As ``resolve_concats`` for given calls and definitions.

    Unresolved operands are skipped; a chain with none resolved is dropped.
    Chains are resolved whole, however long.  With ``max_depth`` a chain that
    nests deeper has no URL, and ``too_deep`` says so.  Operands are shuffled;
    the argument goes along with the first of them only.
    """
    parts = calls.where(F.col("arg_kind").isin(*kinds)).select(
        "file", "ord", "verb", "argument", F.inline(_operands(F.col("argument"))))
    quoted = F.col("op").rlike("^[\"'`]")
    names = parts.select("file", "ord", "verb", "pos", "depth",
                         F.when(F.col("pos") == 0, F.col("argument")).alias("argument"),
                         F.when(~quoted, F.col("op")).alias("name"),
                         F.when(quoted, restored(F.regexp_replace(
                             masked("op"), "^['\"`]+|['\"`]+$", ""))).alias("fixed"))
    part = F.coalesce("fixed", "value")
    deep = F.lit(False) if max_depth is None else F.max("depth") >= max_depth
    return (
        resolve_names(names, defs).groupBy("file", "ord", "verb")
        .agg(F.max("argument").alias("argument"), deep.alias("too_deep"),
             F.collect_list(F.when(part.isNotNull(), F.struct("pos", part.alias("part"))))
             .alias("got"))
        .where(F.size("got") > 0)
        .select("file", "ord", "verb", "argument", "too_deep",
                F.when(~F.col("too_deep"), F.array_join(F.transform(
                    F.array_sort("got"), lambda g: g["part"]), "")).alias("url")))


def _without_language(columns: dict) -> dict:
    return {k: v for k, v in columns.items() if k != "language"}


def resolve_call_names(files: DataFrame, **columns: str) -> DataFrame:
    """Client calls whose first argument is a name, with the name's value."""
    refs = (call_sites(files, **columns).where(F.col("arg_kind") == "name")
            .select("file", "ord", "verb", F.col("argument").alias("name")))
    return resolve_names(refs, _definitions_for_calls(files, columns))


def resolve_templates(files: DataFrame, *, path: str = "file", text: str = "text") -> DataFrame:
    """Template literals with ``${name}`` filled in.

    An unknown name becomes ``${...}``; a placeholder that is no plain name
    contributes nothing.  The pieces of one literal come from one text, so the
    re-assembly is bounded by the literal itself.
    """
    hole = r"\$\{[^}]*\}"
    found = F.filter(matches(masked(text), rules.LITERALS["js"]),
                     lambda m: m.startswith("`") & m.contains("${"))
    templates = files.select(F.col(path).alias("file"),
                             F.posexplode(found).alias("ord", "raw")) \
        .withColumn("template", F.expr("substring(raw, 2, length(raw) - 2)"))
    pieces = F.concat(
        F.transform(F.split("template", hole, -1),
                    lambda s, i: F.struct((i * 2).alias("pos"), restored(s).alias("fixed"),
                                          F.lit(None).cast("string").alias("name"))),
        F.transform(matches(F.col("template"), hole),
                    lambda h, i: F.struct(
                        (i * 2 + 1).alias("pos"), F.lit("").alias("fixed"),
                        F.nullif(F.regexp_extract(h, r"^\$\{\s*([A-Za-z_$][\w$]*)\s*\}$", 1),
                                 F.lit("")).alias("name"))),
    )
    # pieces are shuffled; the literal itself goes along with the first of them only
    parts = templates.select("file", "ord", "template", F.inline(pieces)).withColumn(
        "template", F.when(F.col("pos") == 0, restored(F.col("template"))))
    defs = definitions(files, path=path, text=text, only=F.col(text).contains("${"))
    joined = resolve_names(parts, defs)
    filled = F.when(F.col("name").isNull(), F.col("fixed")) \
        .otherwise(F.coalesce("value", F.lit("${...}")))
    return (
        joined.groupBy("file", "ord")
        .agg(F.max("template").alias("template"),
             F.collect_list(F.struct("pos", filled.alias("part"))).alias("got"))
        .select("file", "ord", "template",
                F.array_join(F.transform(F.array_sort("got"), lambda g: g["part"]), "")
                .alias("resolved"))
    )


def object_properties(files: DataFrame, *, path: str = "file", text: str = "text",
                      only: Column | None = None) -> DataFrame:
    """(file, obj, prop, value): first object with the property, last value in it."""
    def pairs(source: Column, pattern: str, first: str, second: str) -> Column:
        return F.transform(matches(source, pattern), lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias(first),
            F.regexp_extract(m, pattern, 2).alias(second)))

    objects = pairs(F.col(text), rules.OBJECT_LITERAL, "obj", "body")
    props = pairs(F.col("o.body"), rules.OBJECT_PROPERTY, "prop", "value")
    return (
        files.select(F.col(path).alias("file"), F.posexplode(
            objects if only is None else F.when(only, objects)).alias("opos", "o"))
        .select("file", "opos", "o.obj", F.posexplode(props).alias("ppos", "p"))
        .groupBy("file", "obj", F.col("p.prop").alias("prop"))
        .agg(F.min_by("p.value", F.struct(F.col("opos"), -F.col("ppos"))).alias("value"))
    )


def resolve_members(files: DataFrame, **columns: str) -> DataFrame:
    """Client calls on ``obj.prop`` with the value from the object literal."""
    refs = (call_sites(files, **columns).where(F.col("arg_kind") == "member")
            .select("file", "ord", "verb", "argument",
                    F.split_part("argument", F.lit("."), F.lit(1)).alias("obj"),
                    F.split_part("argument", F.lit("."), F.lit(2)).alias("prop")))
    only = needs_resolution(**{k: v for k, v in columns.items() if k != "path"})
    props = object_properties(files, only=only, **_without_language(columns))
    return refs.join(props, ["file", "obj", "prop"], "left")


def substitute(template: Column, constants: Column) -> Column:
    """``${v}`` and ``{v}`` replaced for each (name, value), in order."""
    return F.aggregate(
        constants, template,
        lambda acc, d: F.replace(
            F.replace(acc, F.concat(F.lit("${"), d["name"], F.lit("}")), d["value"]),
            F.concat(F.lit("{"), d["name"], F.lit("}")), d["value"]))


def tracked_constants(text: Column) -> Column:
    """array<struct<name,value>> in order of first assignment, last value kept."""
    _, pattern = rules.DEFINITIONS[1]
    found = F.transform(matches(text, pattern), lambda m, i: F.struct(
        F.regexp_extract(m, pattern, 1).alias("name"), i.alias("pos"),
        F.regexp_extract(m, pattern, 2).alias("value")))

    def latest(ps: Column) -> Column:
        # sorted by name and place, the ends of each run are its first and last
        first = F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["name"] != p["name"]))
        last = F.filter(ps, lambda p, i: (i == F.size(ps) - 1)
                        | (F.get(ps, i + 1)["name"] != p["name"]))
        both = F.zip_with(first, last, lambda f, z: F.struct(
            f["pos"].alias("pos"), z["name"].alias("name"), z["value"].alias("value")))
        return F.transform(F.sort_array(both), lambda d: F.struct(
            d["name"].alias("name"), d["value"].alias("value")))

    return let(F.sort_array(found), latest)


def resolved_endpoints(files: DataFrame, **columns: str) -> DataFrame:
    """API URLs from calls whose argument needed resolution."""
    return resolved_calls(call_sites(files, **columns), _definitions_for_calls(files, columns))


def resolved_calls(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """A lone name is a chain of one operand, so both kinds share one join."""
    return (
        resolve_chains(calls, defs, kinds=("name", "concat"))
        .select("file", "ord", "url", F.col("verb").alias("method"))
        .where(is_api_url("url"))
        .withColumn("match_kind", F.lit("resolved"))
    )


_TOKEN = ("array<struct<token:string,ord:int,name:string,value:string,kind:int,"
          "line:int,column:int,severity:string>>")


def source_tokens(files: DataFrame, *, path: str = "file", text: str = "text",
                  language: str = "language") -> DataFrame:
    """Literals, client calls, definitions and secrets of a corpus from one scan.

    Narrow rows (file, token, ord, name, value, kind, line, column, severity):
    written once, they answer all questions without the texts.  Escapes are
    masked once a text, and definitions are only sought where a call has an
    argument that is no literal.
    """
    t, lang = F.col(text), F.col(language)
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    empty = F.array().cast(_TOKEN)

    def token(name: str, order: Column, a: Column, b: Column, kind: Column, line: Column,
              column: Column, severity: Column = none) -> Column:
        return F.struct(F.lit(name), order, a, b, kind, line, column, severity)

    def joined(*found: Column) -> Column:
        return F.concat(*[F.coalesce(p.cast(_TOKEN), empty) for p in found])

    def from_calls(calls: Column) -> Column:
        unresolved = F.exists(calls, lambda c: ~is_literal(c["argument"]))
        return joined(
            F.transform(calls, lambda x, i: token(
                "call", i, x["function"], x["argument"], nothing, nothing, nothing)),
            F.transform(F.when(unresolved, definition_rows(t)), lambda x: token(
                "definition", x["pos"], x["name"], x["value"], x["kind"], nothing, nothing)))

    def from_masked(clean: Column) -> Column:
        literals = F.transform(literal_rows(t, lang, clean), lambda x, i: token(
            "literal", i, none, x["url"], nothing, x["line"], x["column"]))
        return F.concat(joined(literals), F.coalesce(
            let(call_rows(t, lang, clean), from_calls), empty))

    found = F.transform(secret_rows(t), lambda x, i: token(
        "secret", i, x["type"], x["value"], nothing, x["line"], x["column"], x["severity"]))
    return files.select(F.col(path).alias("file"), F.inline(
        F.concat(F.coalesce(let(masked(t), from_masked), empty), joined(found))))


def literals_of(tokens: DataFrame) -> DataFrame:
    rows = tokens.where(F.col("token") == "literal")
    return as_literal_endpoints(rows.select("file", F.col("value").alias("url"), "line", "column"))


def calls_of(tokens: DataFrame) -> DataFrame:
    rows = tokens.where(F.col("token") == "call")
    return as_call_sites(rows.select("file", "ord", F.col("name").alias("function"),
                                     F.col("value").alias("argument")))


def definitions_of(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token") == "definition").select(
        "file", "kind", F.col("ord").alias("pos"), "name", "value")


def secrets_of(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token") == "secret").select(
        "file", F.col("name").alias("type"), "severity", "value", "line", "column")
