"""The pipeline, stage by stage and as a whole."""

import collections
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from apiscope.llm.common import table

from .helpers import CLASH, EDGE_ROWS, SF, classes_by_force, documents, hits_by_force, personal


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_dups", "benchmark", "personal_data", "tokens"]
    names = entry_module.queries()
    assert "pipeline" in names and all(
        sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage on the small tables."""
    out, docs = {}, table(spark, SF, "documents")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_each_stage(stages, spark):
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in stages.items()}
    for name in ("language", "near_dups", "benchmark", "personal_data"):
        assert stages[name].columns == stages["documents"].columns
    before = rows["documents"]
    assert set(rows["language"]) == {i for i, r in before.items()
                                     if any(map(str.isalpha, r.text or ""))}
    classes = classes_by_force({i: r.text for i, r in rows["language"].items()})
    assert set(rows["near_dups"]) == set(classes.values())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for i, r in rows["near_dups"].items():
        n, hit, _ = hits_by_force(r.text, items)
        if hit == n:
            assert i not in rows["benchmark"]
        elif hit == 0:
            assert rows["benchmark"][i].text == r.text
        else:
            left = rows["benchmark"][i].text
            assert len(left) < len(r.text) and rows["benchmark"][i].n_chars == len(left)
    for i, r in rows["benchmark"].items():
        after = rows["personal_data"][i].text
        assert not personal(after)
        if not personal(r.text):
            assert after == r.text
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(rows["tokens"]) == set(rows["personal_data"])
    for i, r in rows["tokens"].items():
        text = rows["personal_data"][i].text
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids
        assert r.decoded == text


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert collections.Counter(map(repr, got.collect())) == collections.Counter(
        map(repr, stages["tokens"].collect()))


def test_stage_edges(spark):
    docs = documents(spark, EDGE_ROWS).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            rows = out.collect()
            assert all(r[c] == "clash" for r in rows for c in CLASH)
            assert rows or df is not docs
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in near) == [-8, 1, 2, 3, 4, 6, 7, 9]
    assert corpus_pipeline.tokens(spark, docs.limit(0), SF).count() == 0


def test_no_copy_of_a_kept_text_stays(spark):
    """Ids over several texts, and missing ones: one row of each class stays."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(3, a, "en"), (5, b, "en"), (5, a, "en"), (None, a, "en"), (None, a, "en"), (9, b + " more", "en"),
            (None, "one two three", "en"), (None, "one two three", "en"), (None, None, "en"), (None, None, "en")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(3, a), (5, b), (None, "one two three"), (None, None)], key=repr)


def test_nothing_else_imports_the_operators():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "apiscope")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "llm" not in f.read()
