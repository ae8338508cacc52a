"""A corpus from raw documents to tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again.  All but the last return
the columns of ``documents``.

1. language: documents without a letter have no language, and go; a missing
   ``lang`` becomes the predicted one.
2. near_dups: one row of each class of near-duplicates stays, the one of the
   least id (rows without an id come last, and stay only if none has one).
3. benchmark: passages of test items are cut out; a document goes if no word of
   it is left by that.
4. personal_data: personal data, and words that give it away, are replaced.
5. tokens: ids of every text, and the text decoded from them.

``n_chars`` follows the text.  An empty table stays empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiscope.llm import bpe, crf, fm_index, near_dups, sanitise
from apiscope.llm.common import aside, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, back = aside(docs, "doc_id", "text", "lang")
    found = crf.label(kept, crf.fit(kept), keep_text=True).where(F.col("lang_pred") != "und")
    return back(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = aside(docs, "doc_id", "text")
    # rows of equal id and text are one; of each class the least row stays, named ones first
    copies = near_dups.members(docs).groupBy("label", "doc_id", "own").agg(
        F.count(F.lit(1)).alias("rows"))
    stays = written(copies.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own", "rows")).alias("least")).select(
        F.col("least.own").alias("_stays"), F.col("least.rows").alias("_rows")), "stays")
    # a merge join at every size: what is shuffled follows the input
    found = docs.withColumn("_own", near_dups.own_key()).join(
        stays.hint("merge"), F.col("_own") == F.col("_stays"))
    once = found.where(F.col("_rows") == 1).select(*docs.columns)
    more = found.where(F.col("_rows") > 1).dropDuplicates(["_own"]).select(*docs.columns)
    return back(once.unionAll(more))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, back = aside(docs, "doc_id", "text")
    found = fm_index.match(kept, table(spark, sf_dir, "benchmark"), cut=True)
    left = (F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))
    return _sized(back(found.where(left)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, back = aside(docs, "doc_id", "text")
    return _sized(back(sanitise.rewrite(kept)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, TOKENIZER)


STAGES = [("language", language), ("near_dups", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("tokens", tokens)]

#: Forward-backward, signatures and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
