"""Endpoint inventories: distinct, audit against a spec, scan comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls


def _keep(df: DataFrame, keys: Sequence[str], order: str, last: bool) -> DataFrame:
    """One whole row per key, the first or last by ``order``.

    An aggregate with partial merging, not a ranking window: a key that holds
    a third of the rows is reduced to one row per input partition before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
            .select(*keys, "_row.*"))


def first_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return _keep(df, keys, order, last=False)


def last_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return _keep(df, keys, order, last=True)


def distinct_endpoints(inventory: DataFrame, *, order: str = "ord",
                       strip_host: bool = False) -> DataFrame:
    """First endpoint of every signature."""
    signed = inventory.withColumn(
        "signature", urls.signature("method", "url", strip_host=strip_host))
    return first_per(signed, ["signature"], order)


def distinct_assets(assets: DataFrame, *, url: str = "url", order: str = "ord") -> DataFrame:
    """First asset of every URL."""
    return first_per(assets, [url], order)


def spec_signatures(spec: DataFrame, *, order: str = "ord") -> DataFrame:
    """One spec row per signature; the last of equal ones stands."""
    signed = spec.withColumn("match_sig", urls.spec_signature("method", "path"))
    return last_per(signed, ["match_sig"], order)


def audit(inventory: DataFrame, spec: DataFrame, *, strip_host: bool = False,
          order: str = "ord") -> DataFrame:
    """Every endpoint with ``category`` documented, zombie or shadow.

    The spec side is unique per signature.  It is not hinted: below Spark's
    broadcast threshold the join is broadcast, beyond it a sort-merge join
    whose hot signatures adaptive execution splits.
    """
    signed = inventory.withColumn(
        "match_sig", urls.match_signature("method", "url", strip_host=strip_host))
    # only the flag travels through the aggregate, which hashes
    known = spec.select(
        urls.spec_signature("method", "path").alias("match_sig"),
        F.coalesce("deprecated", F.lit(False)).alias("flag"), F.col(order).alias("_o")).groupBy(
        "match_sig").agg(F.max_by("flag", "_o").alias("spec_deprecated"))
    return (
        signed.join(known, "match_sig", "left")
        .withColumn("category", F.when(F.col("spec_deprecated").isNull(), F.lit("shadow"))
                    .when(F.col("spec_deprecated"), F.lit("zombie"))
                    .otherwise(F.lit("documented")))
        .drop("spec_deprecated")
    )


def ghosts(inventory: DataFrame, spec: DataFrame, *, strip_host: bool = False,
           order: str = "ord") -> DataFrame:
    """Spec endpoints that no inventory row matches."""
    seen = inventory.select(
        urls.match_signature("method", "url", strip_host=strip_host).alias("match_sig")).distinct()
    return spec_signatures(spec, order=order).join(seen, "match_sig", "left_anti")


def audit_rows(inventory: DataFrame, spec: DataFrame, **options) -> DataFrame:
    """Audit and ghosts as one table (category, method, target)."""
    found = audit(inventory, spec, **options).select(
        "category", "method", F.col("url").alias("target"))
    missing = ghosts(inventory, spec, **options).select(
        F.lit("ghost").alias("category"), "method", F.col("path").alias("target"))
    return found.unionByName(missing)


def audit_summary(rows: DataFrame) -> DataFrame:
    """Count per audit category in one row set, zero counts kept."""
    counts = rows.agg(*[F.count_if(F.col("category") == c).alias(c)
                        for c in rules.AUDIT_CATEGORIES])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("n"))
        for c in rules.AUDIT_CATEGORIES])))


def mark_shadow(inventory: DataFrame, audited: DataFrame) -> DataFrame:
    """Status ``shadow`` for every endpoint whose signature is a shadow one."""
    shadow = (audited.where(F.col("category") == "shadow")
              .select(urls.signature("method", "url").alias("_s")).distinct()
              .withColumn("_hit", F.lit(True)))
    return (
        inventory.withColumn("_s", urls.signature("method", "url"))
        .join(shadow, "_s", "left")
        .withColumn("status", F.when(F.col("_hit"), F.lit("shadow")).otherwise(F.col("status")))
        .drop("_s", "_hit")
    )


COMPARED = ("status", "http_status", "deprecated")


def signed(scan: DataFrame) -> DataFrame:
    """A scan with ``signature``, the raw ``METHOD:url`` that scans are compared by."""
    return scan.withColumn("signature", F.concat(
        F.coalesce("method", F.lit("GET")), F.lit(":"), F.coalesce("url", F.lit(""))))


def compare_scans(baseline: DataFrame, current: DataFrame, *, order: str = "ord",
                  compared: Sequence[str] = COMPARED) -> DataFrame:
    """Added, removed, changed and unchanged endpoints of two scans.

    Key is the raw ``METHOD:url``; the last of equal keys stands.  Both sides
    are unique per key before they meet, so the full outer join is one-to-one.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = last_per(signed(df), ["signature"], order)
        return rows.select("signature", F.struct(
            *[c for c in rows.columns if c != "signature"]).alias(name))

    both = side(baseline, "before").join(side(current, "after"), "signature", "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    kind = (F.when(F.col("before").isNull(), F.lit("added"))
            .when(F.col("after").isNull(), F.lit("removed"))
            .when(same, F.lit("unchanged")).otherwise(F.lit("changed")))
    return both.withColumn("change_type", kind)


def secret_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Net change of the number of secrets, split into added and removed."""
    both = baseline.select(F.lit(-1).alias("s")).unionByName(current.select(F.lit(1).alias("s")))
    net = F.coalesce(F.sum("s"), F.lit(0)).cast("bigint")
    return both.agg(F.greatest(net, F.lit(0)).alias("secrets_added"),
                    F.greatest(-net, F.lit(0)).alias("secrets_removed"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
               n: int = rules.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows per group with their rank.

    The rank filter lets Spark cut each partition to ``n`` rows per group
    before the shuffle, so no task receives a whole group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diff_digest(diff: DataFrame, n: int = rules.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` added and removed endpoints and the count left out.

    Ordered by signature; the total per side is a separate small aggregate.
    """
    sides = diff.where(F.col("change_type").isin("added", "removed"))
    totals = sides.groupBy("change_type").agg(F.count(F.lit(1)).alias("total"))
    shown = first_rows(sides.select("change_type", "signature"), ["change_type"],
                       ["signature"], n)
    return shown.join(F.broadcast(totals), "change_type").withColumn(
        "remaining", F.greatest(F.col("total") - F.lit(n), F.lit(0)))


def preview(inventory: DataFrame, *, order: str = "ord",
            n: int = rules.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in order and how many there are beyond them."""
    total = inventory.agg(F.count(F.lit(1))).scalar()
    return inventory.orderBy(order).limit(n).withColumn(
        "remaining", F.greatest(total - F.lit(n), F.lit(0)))


def status_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def scan_summary(header: DataFrame, inventory: DataFrame, secret_rows: DataFrame,
                 errors: DataFrame | None = None, *, scan: str = "scan_id") -> DataFrame:
    """Per scan: header fields, endpoints by status, secrets and errors.

    The detail tables are reduced to counts per scan before they meet the
    header, and the status map holds one entry per status.
    """
    by_status = (
        inventory.groupBy(scan, "status").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(scan).agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("status", "n")))).alias("by_status")))
    out = header.join(by_status, scan, "left")
    for name, rows in (("secrets_found", secret_rows), ("errors", errors)):
        if rows is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            counts = rows.groupBy(scan).agg(F.count(F.lit(1)).alias(name))
            out = out.join(counts, scan, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def version_siblings(inventory: DataFrame, *, url: str = "url",
                     max_version: int = rules.MAX_VERSION) -> DataFrame:
    """The inventory plus ``/vN/`` variants for every other version up to the limit."""
    marker = r"/v(\d+)/"
    current = F.regexp_extract(F.col(url), marker, 1)
    others = F.filter(F.sequence(F.lit(1), F.lit(max_version)), lambda v: (current != "")
                      & ~current.try_cast("bigint").eqNullSafe(v.cast("bigint")))
    # the NULL entry is the row itself: one scan, one explode
    versions = F.concat(F.array(F.lit(None).cast("int")), others)
    rest = [c for c in inventory.columns if c != url]
    variant = F.regexp_replace(F.col(url), F.lit(marker), F.concat(F.lit("/v"), F.col("_v"), F.lit("/")))
    return (
        inventory.withColumn("_v", F.explode(versions))
        .select(*rest, F.when(F.col("_v").isNull(), F.col(url)).otherwise(variant).alias(url),
                F.col("_v").isNotNull().alias("is_variant"))
    )


def select_captures(captures: DataFrame, as_of: Column, *, months: int = rules.ARCHIVE_MONTHS,
                    per_domain: int | None = None, domain: str = "host") -> DataFrame:
    """Successful captures of the period, first per URL.

    The URL key ignores scheme, ``www.`` and case.  With ``per_domain`` only
    that many URLs of each ``domain``, the first in order, are kept: a top-n
    cut in every partition before the shuffle.
    """
    key = F.regexp_replace(F.lower("original_url"), r"^https?://(?:www\d*\.)?", "")
    day = F.substring("timestamp", 1, 8)
    start = F.date_format(F.date_sub(as_of, months * 30), "yyyyMMdd")
    end = F.date_format(as_of, "yyyyMMdd")
    kept = (captures.where((F.col("status_code") == 200) & day.between(start, end))
            .withColumn("url_key", key))
    keys = ["url_key"] if per_domain is None else ["url_key", domain]
    first = (kept.groupBy(*keys).agg(F.min_by(
        F.struct("timestamp", "original_url", "mime_type", "status_code"),
        F.struct("timestamp", "original_url")).alias("r")).select(*keys, "r.*"))
    if per_domain is None:
        return first
    place = F.row_number().over(Window.partitionBy(domain).orderBy("url_key"))
    return first.withColumn("_n", place).where(F.col("_n") <= per_domain).drop("_n")
