"""Scans stored with a digest tree, against the comparison of whole scans."""

import pytest
from pyspark.sql import functions as F

from apiscope.operators import inventory, scantree

SCAN = "ord long, url string, method string, status string, http_status int, deprecated boolean"


def stored(spark, tmp_path, *scans, **options):
    paths = [str(tmp_path / f"scan{i}") for i in range(len(scans))]
    for scan, path in zip(scans, paths, strict=True):
        scantree.store_scan(scan, path, **options)
    return paths


def facts(df):
    return sorted((r.signature, r.change_type, r.before and r.before.ord, r.after and r.after.ord)
                  for r in df.where("change_type <> 'unchanged'").collect())


def check(spark, a, b, paths):
    whole = inventory.compare_scans(a, b)
    assert facts(scantree.stored_changes(spark, *paths)) == facts(whole)
    want = {r.change_type: r["count"] for r in whole.groupBy("change_type").count().collect()}
    got = scantree.stored_change_counts(spark, *paths).collect()
    assert {r.change_type: r.n for r in got} == want and len(got) == len(want)


def test_edges(spark, tmp_path):
    a = spark.createDataFrame([
        (0, "/a", "GET", "x", 200, None), (1, "/b", None, "x", None, None),
        (2, "/c", "GET", "x", 200, None), (3, "/c", "GET", "y", 200, None),
        (4, None, None, None, None, None), (5, "", "GET", "z", None, True),
        # a null that moves from one column to the next is a change
        (6, "/n", "GET", None, 1, None), (7, "/é" * 5000, "GET", "x", 1, None)], SCAN)
    b = spark.createDataFrame([
        (0, "/a", "GET", "x", 200, None), (1, "/c", "GET", "x", 200, None),
        (2, "/d", "PUT", "x", 200, None), (6, "/n", "GET", None, None, True),
        (9, "/é" * 5000, "GET", "x", 1, None)], SCAN)
    none = spark.createDataFrame([], SCAN)
    one, two, empty = stored(spark, tmp_path, a, b, none, fanout=2, levels=3)
    check(spark, a, b, (one, two))
    check(spark, a, none, (one, empty))
    check(spark, none, none, (empty, empty))


def test_few_changes_read_few_rows(spark, tmp_path):
    """A third of the rows are of one host; one in a hundred changes, on a few hosts."""
    n = 12_000
    host = F.when(F.col("id") % 3 == 0, F.lit("hot.example")).otherwise(
        F.concat(F.lit("h"), (F.col("id") % 400).cast("string"), F.lit(".example")))
    a = spark.range(n).select(
        F.col("id").alias("ord"), F.concat(F.lit("https://"), host, F.lit("/p/"), "id").alias("url"),
        F.lit("GET").alias("method"), F.lit("verified").alias("status"),
        (F.col("id") % 5).cast("int").alias("http_status"), F.lit(False).alias("deprecated"))
    touched = F.col("url").rlike(r"//h(7|100|205)\.")
    kind = F.col("ord") % 7
    b = (a.where(~(touched & (kind == 0)))
         .withColumn("status", F.when(touched & (kind == 1), F.lit("dead")).otherwise(F.col("status")))
         .withColumn("url", F.when(touched & (kind == 2), F.concat("url", F.lit("/new")))
                     .otherwise(F.col("url"))))
    paths = stored(spark, tmp_path, a, b, fanout=8)
    check(spark, a, b, paths)
    leaves = scantree.differing_leaves(spark, *paths)
    read = sum(spark.read.parquet(f"{p}/rows").where(F.col("_leaf").isin(*leaves)).count()
               for p in paths)
    assert 0 < read <= 0.1 * (a.count() + b.count())
    # the folders of other leaves are pruned, not filtered
    plan = scantree.stored_changes(spark, *paths)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_leaf" in plan
    # the hot host does not stand in one leaf
    hot = spark.read.parquet(f"{paths[0]}/rows").where("url LIKE '%//hot.%'")
    assert hot.select("_leaf").distinct().count() == 8
    assert scantree.differing_leaves(spark, paths[0], paths[0]) == []


def test_refusals(spark, tmp_path):
    a = spark.createDataFrame([(0, "/a", "GET", "x", 200, None)], SCAN)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    scantree.store_scan(a, one, fanout=2, levels=2)
    scantree.store_scan(a, two, fanout=2, levels=3)
    with pytest.raises(ValueError, match="different ways"):
        scantree.differing_leaves(spark, one, two)
    with pytest.raises(ValueError, match="leaves"):
        scantree.store_scan(a, str(tmp_path / "three"), fanout=1000, levels=3)
    with pytest.raises(ValueError, match="_leaf"):
        scantree.store_scan(a.withColumn("_leaf", F.lit(1)), str(tmp_path / "four"))
