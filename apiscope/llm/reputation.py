"""URL filter: fixed rules first, then the reputation of the host.

A host's rate of bad outcomes is estimated by empirical Bayes.  Labelled page
outcomes are summed per host, registered domain and suffix.  Each level has a
beta prior whose mean is the posterior mean of the level above and whose
strength is fitted by the method of moments on the level's groups, so a host
with few labels leans on its domain, and that on its suffix.  A page is blocked
where the lower bound of its host's posterior exceeds the limit.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, and the empty host is a host like others; a host without labels has
its domain's mean as its own; null outcomes are no label; a page with several
labels counts each; without any outcome all rates are one half, and nothing is
blocked but by rule.  Repeated pages are judged one by one.  Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame, low: float, high: float) -> Column:
    """The beta prior's strength by moments of the groups' rates, a scalar subquery.

    With group sizes n, rates p and overall rate m, the variance between groups
    is what the weighted variance of p leaves beyond the binomial part; the
    strength is m(1-m)/variance - 1, held in [low, high], and ``high`` where the
    moments leave no variance.
    """
    sums = groups.where(F.col("n") > 0).agg(
        F.sum("bad").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"),
        F.sum(F.col("n") * F.col("n")).alias("n2"))
    mean = F.col("b") / F.col("n")
    noise = mean * (1 - mean)
    between = (F.col("q") - F.col("n") * mean * mean - (F.col("g") - 1) * noise) / (
        F.col("n") - F.col("n2") / F.col("n"))
    fitted = F.when((F.col("g") > 1) & (between > 0), noise / between - 1).otherwise(F.lit(high))
    return sums.select(F.least(F.greatest(fitted, F.lit(low)), F.lit(high))).scalar()


def reputation(outcomes: DataFrame, *, z: float = 1.645, low: float = 1.0,
               high: float = 1000.0) -> DataFrame:
    """Posterior of every host: (host, alpha, beta, rate, bound), one row a host.

    ``outcomes`` has ``host`` and ``bad`` (0, 1, or null for a page without a
    label).  ``bound`` is the posterior mean less ``z`` standard deviations.
    """
    sums = [F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"),
            F.sum("n").cast("double").alias("n")]
    hosts = outcomes.groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"),
        F.count("bad").cast("double").alias("n")).select(
        "host", F.substring_index("host", ".", -2).alias("domain"),
        F.substring_index("host", ".", -1).alias("suffix"), "bad", "n")
    hosts = written(hosts, "reputation-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    every = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    top = every.select((1 + F.coalesce("bad", F.lit(0.0)))
                       / (2 + F.coalesce("n", F.lit(0.0)))).scalar()

    def posterior(groups: DataFrame, prior: Column) -> DataFrame:
        groups = groups.withColumn("strength", F.coalesce(_strength(groups.select("bad", "n"),
                                                                    low, high), F.lit(high)))
        alpha = prior * F.col("strength") + F.col("bad")
        beta = (1 - prior) * F.col("strength") + F.col("n") - F.col("bad")
        return groups.withColumns({"alpha": alpha, "beta": beta}).withColumn(
            "rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    def above(level: DataFrame, key: str) -> DataFrame:
        return level.select(key, F.col("rate").alias("prior"))

    by_suffix = posterior(suffixes, top)
    by_domain = posterior(domains.join(above(by_suffix, "suffix"), "suffix"), F.col("prior"))
    by_host = posterior(hosts.join(above(by_domain, "domain"), "domain"), F.col("prior"))
    n = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (n * n * (n + 1)))
    return by_host.select("host", "alpha", "beta", "rate",
                          (F.col("rate") - z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES,
          limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound of every page.

    ``outcomes`` has ``page_id`` and ``bad`` (0 or 1, null for none).  The table
    of hosts is written, so that the join of pages with it can split a hot host.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"),
                          url_path(F.col("url")).alias("path"))
    labels = outcomes.where(F.col("bad").isNotNull()).select(
        F.col("page_id").alias("labelled"), F.col("bad").cast("double").alias("bad"))
    known = parsed.select("page_id", "host").join(
        labels, F.col("page_id") == F.col("labelled"), "left").select("host", "bad")
    hosts = written(reputation(known, z=z).select("host", "rate", "bound"), "reputation")
    found = F.col("found")
    verdict = F.coalesce(found["verdict"],
                         F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return parsed.join(hosts, "host", "left").withColumn(
        "found", longest_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", found["rule"].alias("rule"), verdict.alias("verdict"),
        "rate", "bound")
