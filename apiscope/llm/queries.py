"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversations, crf, fm_index, near_dups, packing, randomness, reputation, sanitise,
               separators, spelling, templates, topk)
from .common import table

#: The tokenizer's file; a parameter of every operator that needs one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, from flat token files without an index."""
    found = separators.counted(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select("doc_id", "n_tokens")


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(table(spark, sf_dir, "documents"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(table(spark, sf_dir, "documents"))


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose id is the page's: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return reputation.judge(
        table(spark, sf_dir, "pages"),
        labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard(table(spark, sf_dir, "documents"), shards=24).drop("tokens")


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, left = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(rows, left))


def op12_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.counted(found))


def op13_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.digests(randomness.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_separator_scan, op2_language_crf, op3_site_templates, op4_disclosure,
        op5_host_reputation, op6_vector_packing, op7_probminhash, op8_fm_index, op9_trie_bpe,
        op10_branch_and_bound, op11_auction_repair,
        op12_pivotal_grams, op13_randomness_battery)
}

#: The same rules, sums, moments and posteriors by SQL aggregates.
_OP5_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
labelled AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0
                    WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0.0 END AS bad
  FROM parsed LEFT JOIN labels ON doc_id = page_id),
hosts AS (
  SELECT host, CASE WHEN strpos(host, '.') = 0 THEN host
                    ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
         list_extract(string_split(host, '.'), -1) AS suffix,
         coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n
  FROM labelled GROUP BY host),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix),
sums AS (
  SELECT level, sum(bad) AS b, sum(n) AS n, count(*) AS g, sum(bad * bad / n) AS q, sum(n * n) AS n2
  FROM (SELECT 'host' AS level, bad, n FROM hosts UNION ALL SELECT 'domain', bad, n FROM domains
        UNION ALL SELECT 'suffix', bad, n FROM suffixes) WHERE n > 0 GROUP BY level),
moments AS (
  SELECT level, b / n * (1 - b / n) AS noise,
         CASE WHEN g > 1 THEN (q - b * b / n - (g - 1) * (b / n * (1 - b / n)))
              / nullif(n - n2 / n, 0) END AS between_groups
  FROM sums),
strengths AS (
  SELECT level, least(greatest(CASE WHEN between_groups > 0 THEN noise / between_groups - 1
                               ELSE 1000.0 END, 1.0), 1000.0) AS strength FROM moments),
by_suffix AS (
  SELECT suffix, (prior * s + bad) / (s + n) AS rate
  FROM (SELECT *, (SELECT (1 + coalesce(sum(bad), 0)) / (2 + coalesce(sum(n), 0)) FROM suffixes) AS prior,
               coalesce((SELECT strength FROM strengths WHERE level = 'suffix'), 1000.0) AS s
        FROM suffixes)),
by_domain AS (
  SELECT domain, (rate * s + bad) / (s + n) AS rate
  FROM (SELECT d.*, rate, coalesce((SELECT strength FROM strengths WHERE level = 'domain'), 1000.0) AS s
        FROM domains d JOIN by_suffix USING (suffix))),
by_host AS (
  SELECT host, rate * s + bad AS a, (1 - rate) * s + n - bad AS b
  FROM (SELECT h.*, rate, coalesce((SELECT strength FROM strengths WHERE level = 'host'), 1000.0) AS s
        FROM hosts h JOIN by_domain USING (domain))),
bounds AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound
           FROM by_host),
rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
  AS r(verdict, name, prefix)),
fitting AS (
  SELECT page_id, host, path, arg_max(r.name || r.prefix, length(r.name || r.prefix)) AS rule,
         arg_max(r.verdict, length(r.name || r.prefix)) AS verdict
  FROM (SELECT DISTINCT * FROM parsed) p JOIN rules r
    ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.prefix)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p JOIN bounds b ON p.host = b.host
LEFT JOIN fitting f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
"""

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = {"op5_host_reputation": _OP5_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
