"""Which URLs may be touched: validation, scope lists, rejection log, triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.core import let


def scope_check(inventory: DataFrame, allowed: Sequence[str] = (), blocked: Sequence[str] = (),
                *, url: str = "url", allow_ip: bool = False,
                block_internal: bool = True) -> DataFrame:
    """Adds ``in_scope``, ``domain`` and ``reason`` ('' if in scope).

    The globs are folded into the expression when the plan is built, so there
    is no join; for lists of many thousands use ``scope_check_by_table``.
    """
    def verdict(v):
        reason = F.when(~v["ok"], v["reason"]).otherwise(
            urls.scope_reason(v["domain"], list(allowed), list(blocked)))
        return F.struct(v["domain"].alias("domain"), reason.alias("reason"))

    checked = inventory.withColumn(
        "_v", let(urls.validate(url, allow_ip=allow_ip, block_internal=block_internal), verdict))
    return (checked.withColumn("domain", F.col("_v.domain"))
            .withColumn("reason", F.col("_v.reason"))
            .withColumn("in_scope", F.col("reason") == "")
            .drop("_v"))


def partition_scope(inventory: DataFrame, allowed: Sequence[str] = (),
                    blocked: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(allowed rows, blocked rows)."""
    flagged = scope_check(inventory, allowed, blocked, **options)
    return flagged.where("in_scope"), flagged.where("NOT in_scope")


def rejection_log(inventory: DataFrame, allowed: Sequence[str] = (),
                  blocked: Sequence[str] = (), *, url: str = "url", **options) -> DataFrame:
    """(url, reason) of everything that is not in scope."""
    _, out = partition_scope(inventory, allowed, blocked, url=url, **options)
    return out.select(F.col(url).alias("url"), "reason")


def _glob_regex(key: Column) -> Column:
    """As ``urls.glob_regex``, for a column of normalised globs."""
    plain = F.regexp_replace(key, r"\[(?![^\]]+\])", "\u0001")  # a bracket that never closes
    escaped = F.regexp_replace(plain, r"([.^$+(){}|\\])", r"\\$1")
    regex = F.replace(F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")),
                                F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^"))
    return F.concat(F.lit("(?s)^"), F.replace(regex, F.lit("\u0001"), F.lit("\\[")), F.lit("$"))


#: Stand before and after a host, so that a glob's ends count as letters of it.
_START, _END = "\u0002", "\u0003"


def _pieces(key: Column) -> Column:
    """The plain runs of a glob between its wildcards, its ends included."""
    return F.split(F.concat(F.lit(_START), key, F.lit(_END)), r"\[[^\]]+\]|[*?]")


def _grams(runs: Column) -> Column:
    """Distinct runs of one, two and three letters; an end alone is none."""
    def of_length(run: Column, n: int) -> Column:
        last = F.length(run) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                            lambda i: F.substring(run, i, F.lit(n))))

    found = F.flatten(F.transform(runs, lambda r: F.flatten(F.filter(
        F.array(*[of_length(r, n) for n in (1, 2, 3)]), lambda x: x.isNotNull()))))
    return F.array_except(F.array_distinct(found), F.array(F.lit(_START), F.lit(_END)))


def _by_gram(hosts: DataFrame, globs: DataFrame) -> DataFrame:
    """(domain, key, action, position) of the globs with a plain letter.

    An inverted index: every glob is filed under that of its grams which the
    fewest hosts hold (then the fewest globs), and meets those hosts only.  A glob
    with a gram that no host holds can match none.
    """
    of_host = hosts.select("domain", F.explode(_grams(F.array(F.concat(
        F.lit(_START), "domain", F.lit(_END))))).alias("gram"))
    of_glob = globs.select("key", F.explode(_grams(_pieces(F.col("key")))).alias("gram")).distinct()
    holders = of_host.groupBy("gram").agg(F.count(F.lit(1)).alias("hosts"))
    sharers = of_glob.groupBy("gram").agg(F.count(F.lit(1)).alias("globs"))
    rarest = (of_glob.join(sharers, "gram").join(holders, "gram", "left").groupBy("key")
              .agg(F.min(F.struct(F.coalesce("hosts", F.lit(0)).alias("hosts"), "globs", "gram"))
                   .alias("least")).where(F.col("least.hosts") > 0)
              .select("key", F.col("least.gram").alias("gram")))
    return of_host.join(globs.join(rarest, "key"), "gram").where(
        F.rlike("domain", F.col("regex"))).select("domain", "key", "action", "position")


def _by_wildcards(hosts: DataFrame, globs: DataFrame) -> DataFrame:
    """As `_by_gram`, of the globs without a plain letter.

    Stars and question marks only say how long a host is, so such globs are
    reduced to one of each form, the first, and all forms are tested in one pass
    over the hosts.
    """
    bare = globs.where(F.size(_grams(_pieces(F.col("key")))) == 0).withColumn(
        "form", F.when(F.col("key").contains("["), F.col("key")).otherwise(F.concat(
            F.regexp_replace("key", r"\*", ""), F.when(F.col("key").contains("*"), "*").otherwise(""))))
    first = bare.groupBy("form", "action").agg(F.min_by(
        F.struct("key", "action", "position", "regex"), F.struct("position", "key")).alias("g"))
    forms = first.agg(F.collect_list("g")).scalar()
    return hosts.select("domain", forms.alias("forms")).select("domain", F.inline(F.filter(
        "forms", lambda g: F.rlike(F.col("domain"), g["regex"])))).select(
        "domain", "key", "action", "position")


def scope_check_by_table(inventory: DataFrame, patterns: DataFrame, *, url: str = "url",
                         position: str | None = None, allow_ip: bool = False,
                         block_internal: bool = True) -> DataFrame:
    """Scope check against a large pattern table ``(pattern, action)``.

    ``action`` is 'allow' or 'deny'; a pattern is any glob of the list form.
    The verdict is computed once per distinct host.  Host names and ``*.suffix``
    are found by equality with the host and its parents.  Any other glob is
    compared only with hosts that hold its rarest gram (see `_by_gram`); globs of
    nothing but wildcards share one test per host.  The reason names the first
    pattern by ``position``, else the first in alphabetical order.
    """
    valid = inventory.withColumn("_v", urls.validate(url, allow_ip=allow_ip,
                                                     block_internal=block_internal))
    hosts = valid.where("_v.ok").select(F.col("_v.domain").alias("domain")).distinct()
    labels = F.split("domain", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("*."), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    candidates = hosts.select("domain", F.explode(F.concat(
        F.array(F.col("domain")), parents)).alias("key"))
    listed = patterns.select(
        F.regexp_replace(F.lower(F.regexp_replace("pattern", "^https?://", "")), "/+$", "")
        .alias("key"), "action",
        (F.lit(0) if position is None else F.col(position)).alias("position"))
    simple = ~F.regexp_replace("key", r"^\*\.", "").rlike(r"[*?\[]")
    by_key = candidates.join(listed.where(simple), "key").select(
        "domain", "key", "action", "position")

    globs = listed.where(~simple).withColumn("regex", _glob_regex(F.col("key")))
    hits = by_key.unionAll(_by_gram(hosts, globs)).unionAll(_by_wildcards(hosts, globs)).groupBy("domain").agg(
        F.min(F.when(F.col("action") == "deny", F.struct("position", "key"))).alias("deny"),
        F.bool_or(F.col("action") == "allow").alias("allow"))
    has_allow = listed.agg(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False))).scalar()
    verdicts = hosts.join(hits, "domain", "left").select(
        F.col("domain").alias("_d"),
        F.when(F.col("deny").isNotNull(),
               F.concat(F.lit("Matched blocked pattern: "), F.col("deny.key")))
        .when(has_allow & ~F.coalesce("allow", F.lit(False)),
              F.lit("Not in allowed domains list"))
        .otherwise(F.lit("")).alias("_r"))
    return (
        valid.join(verdicts, F.col("_v.domain") == F.col("_d"), "left")
        .withColumn("reason", F.when(~F.col("_v.ok"), F.col("_v.reason")).otherwise(F.col("_r")))
        .withColumn("in_scope", F.col("reason") == "")
        .drop("_v", "_d", "_r")
    )


def triage(inventory: DataFrame, allowed: Sequence[str] = (), blocked: Sequence[str] = (), *,
           url: str = "url", base: str = "base_url") -> DataFrame:
    """Which endpoints could be requested: ``target`` and ``error`` ('' if eligible)."""
    u, b = F.col(url), F.coalesce(F.col(base), F.lit(""))
    absolute = u.startswith("http://") | u.startswith("https://")
    target = F.when(absolute, u).when(b != "", urls.resolve(base, url))
    checked = scope_check(inventory.withColumn("target", target), allowed, blocked, url="target")
    error = (F.when(F.col("target").isNull(), F.lit("No base URL for relative path"))
             .when(~F.col("in_scope"), F.lit("URL out of scope")).otherwise(F.lit("")))
    return checked.withColumn("error", error).drop("in_scope", "domain", "reason")


def hosts_in_scope(hosts: DataFrame, allowed: Sequence[str] = (), blocked: Sequence[str] = (),
                   *, host: str = "host") -> DataFrame:
    """Hosts that pass the scope lists; all of them if no allow list is set."""
    if not allowed:
        return hosts
    probe = hosts.withColumn("_u", F.concat(F.lit("https://"), F.col(host)))
    kept, _ = partition_scope(probe, allowed, blocked, url="_u")
    return kept.drop("_u", "in_scope", "domain", "reason")


def hosts_in_scope_by_table(hosts: DataFrame, patterns: DataFrame, *, host: str = "host",
                            **options) -> DataFrame:
    """As `hosts_in_scope` against a large table (pattern, action); all rows if none allows."""
    probe = hosts.withColumn("_u", F.concat(F.lit("https://"), F.col(host)))
    allows = patterns.agg(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False))).scalar()
    checked = scope_check_by_table(probe, patterns, url="_u", **options)
    return checked.where(F.col("in_scope") | ~allows).drop("_u", "in_scope", "reason")


def subdomains(names: DataFrame, *, domain: str = "domain", name: str = "name_value",
               dot_boundary: bool = True) -> DataFrame:
    """Distinct, sorted (domain, host) from certificate names.

    With ``dot_boundary=False`` a name that merely ends in the same letters
    also counts.
    """
    raw = F.explode(F.split(F.col(name), "\n", -1))
    host = F.regexp_replace(F.lower(F.regexp_replace("n", r"^\s+|\s+$", "")), r"^\*\.", "")
    suffix = F.concat(F.lit("."), F.col("domain")) if dot_boundary else F.col("domain")
    return (
        names.select(F.col(domain).alias("domain"), raw.alias("n"))
        .select("domain", host.alias("host"))
        .where(F.endswith("host", suffix) & (F.col("host") != F.col("domain")))
        .distinct()
        .orderBy("domain", "host")
    )
