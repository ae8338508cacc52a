"""Exact top-k and FM-index search, against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apiscope.llm import fm_index, queries, topk
from apiscope.llm.common import table

from .helpers import EDGE_ROWS, LONG, SF, documents, hits_by_force


def best_by_force(rows, queries_of, k=10):
    ints = {i: [] for i, _ in rows}
    use = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
           if i is not None and v is not None
           and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in use:
        if q in ints and queries_of(q):
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i)  # noqa: B905
                             for i, w in use if i != q))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_top_k_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = queries.op10_branch_and_bound(spark, SF)
    assert found(got) == best_by_force(rows, lambda q: q % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn(
        "score", F.lit("clash")).withColumn("rank", F.lit(1))


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0]),
            (9, [-3.0, 0.1, 5.0]), (100, [0.5, -0.5])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=3)
    assert found(got) == best_by_force(rows, lambda q: q % 100 == 0, 3)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    alone = topk.top_k(vectors(spark, rows[:1]), F.col("vec_id") % 100 == 0)
    assert alone.count() == 0
    twice = topk.top_k(vectors(spark, [rows[0], rows[0], rows[1], rows[1]]), F.col("vec_id") == 0)
    assert [(r.vec_id, r["rank"]) for r in twice.orderBy("rank").collect()] == [(1, 1), (1, 2)]


def test_top_k_many_ties_blocks_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERY_COMPONENTS", 64)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-2, 3, 20) / 2).tolist()) for i in range(120)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5)
    assert found(got) == best_by_force(rows, lambda q: q % 10 == 0, 5)


def test_scores_beyond_doubles():
    best = topk.Best(np.array([0]), np.array([[2.0**40, 1.0]]), 2)
    best.add(np.array([1, 2]), np.array([[2.0**40, 1.0], [2.0**40, 2.0]]))
    assert [int(s) for s in best.found[0][0]] == [2**80 + 2, 2**80 + 1]


@pytest.mark.parametrize("size", [1, 2, 50, 400])
def test_suffix_order(size):
    rng = np.random.default_rng(size)
    symbol = np.append(rng.integers(0, 3, size), 0)
    got = fm_index.suffix_order(symbol).tolist()

    def key(i):  # a 0 ends the comparison: it is unlike any other 0
        out = []
        for j in range(i, len(symbol)):
            out.append((int(symbol[j]), j if symbol[j] == 0 else 0))
            if symbol[j] == 0:
                break
        return out

    assert got == sorted(range(len(symbol)), key=key)


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    symbol = np.append(rng.integers(0, 4, 500), 0)
    index = fm_index.Index(symbol, 4)
    row = np.arange(0, 502, 7)
    for s in range(1, 4):
        assert index.rank(np.full(len(row), s), row).tolist() == [
            int((index.before[:r] == s).sum()) for r in row]
    assert index.locate(np.arange(501)).tolist() == fm_index.suffix_order(symbol).tolist()


def test_benchmark_query(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    some = 0
    for r in queries.op8_fm_index(spark, SF).collect():
        n, hit, ids = hits_by_force(texts[r.doc_id], items)
        some += hit > 0
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
    assert some


ITEMS = [(1, "the cat sat"), (2, None), (3, ""), (None, "le chat est"), (4, "CAT SAT ON the mat"),
         (4, "sur la"), (5, "..."), (10, " ".join(f"word{i % 97} and{i}" for i in range(40, 60)))]


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_benchmark_edges(spark, monkeypatch, block):
    """One block of phrases, and several."""
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, EDGE_ROWS)
    rows = fm_index.digests(docs, items).collect()
    short = [(i, t if t != LONG else " ".join(LONG.split()[:200])) for i, t, _ in EDGE_ROWS]
    want = []
    for i, t in short:
        n, hit, ids = hits_by_force(t, ITEMS)
        want.append((i, hit, len(ids), hit > 0))
    assert sorted(((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in rows),
                  key=repr) == sorted(want, key=repr)
    assert fm_index.digests(documents(spark, []), items).count() == 0
    none = fm_index.digests(docs, items.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_cut_texts(spark):
    items = spark.createDataFrame([(1, "b c"), (2, "e é")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a, B-c! d e  É e é."), (2, None), (3, "b c")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in fm_index.match(docs, items, cut=True).collect()}
    # only A-Z are lower-cased
    assert rows[1].text == "a, ! d e  É ." and rows[1].spans == [[1, 3], [6, 8]]
    assert rows[2].text is None and rows[3].text == ""


def test_shard_with_many_repeats():
    text = "b c " * 3000 + "x"
    phrases = fm_index.Phrases([1, 2], ["b c b c b c b c b c b c", "c x"])
    from apiscope.llm.words import words
    w = words(pa.array([text, text]))
    phrase, first = fm_index.occurrences(w.hash, w.doc, phrases)
    assert len(set(zip(phrase.tolist(), first.tolist(), strict=True))) == len(phrase)
    assert len(phrase) == 2 * (2 * 3000 - 9 + 1)


def test_components_beyond_doubles_and_long(spark):
    """Finite components take part whatever their size; ranks follow exact scores."""
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e200, 1.0]), (3, [-1e200, 5.0]), (4, [1e307, 0.0]),
            (5, [0.5, float("inf")]), (6, [0.5, 0.25]), (7, [2.0**40, 1.0]), (8, [-2.0**70, 1.0]), (9, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x) * 1024 if abs(x) > 2**60 else int(x * 1024 // 1) for x in v] for i, v in rows
             if v is not None and i != 5}
    got = topk.top_k(vectors, F.col("vec_id") < 9, k=4).collect()
    clip = 1 << 63
    expected = []
    for q, v in whole.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q)
        expected += [(q, k, i, max(-clip, min(clip - 1, -s))) for k, (s, i) in enumerate(scored[:4], 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_many_query_blocks(spark, monkeypatch):
    """Blocks are answered one after the other; together they are all queries."""
    monkeypatch.setattr(topk, "QUERY_COMPONENTS", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 3 == 0, k=5).collect()
    monkeypatch.setattr(topk, "QUERY_COMPONENTS", 1 << 20)
    assert sorted(map(tuple, got)) == sorted(map(tuple, topk.top_k(
        vectors, F.col("vec_id") % 3 == 0, k=5).collect())) and len(got) == 100
