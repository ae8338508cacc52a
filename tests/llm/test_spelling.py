"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from apiscope.llm import queries, spelling

from .helpers import EDGE_ROWS, SF, documents, lower_ascii


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(n):
    by_hole = collections.defaultdict(set)  # words that agree without one letter
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for hole, words in by_hole.items():
        for a in words | ({hole} & n.keys()):
            near[a] |= {b for b in words | ({hole} & n.keys()) if one_apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None)
                  for w, c in n.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(counts(rows))
    assert sum(r[4] > 0 for r in expected) > 20
    assert found(queries.op12_pivotal_grams(spark, SF)) == expected


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeé÷"])
def test_words_of_few_letters(spark, letters):
    """Hard for grams: few kinds, many of one kind in a word, all near each other."""
    rng = random.Random(len(letters))
    n = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))): rng.choice((3, 6, 7, 50))
         for _ in range(400)} | {"a" * k: 3 * k for k in range(5, 40)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(df)) == brute(n)


def test_long_chain_of_forms(spark):
    """Each word's form is the next one; roots are found in few rounds."""
    n = {"a" * (60 - k): 3 * 2**k for k in range(50)}
    got = found(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {r[2] for r in got} == {"a" * 11}


def test_pivots_are_least_and_disjoint():
    rng = random.Random(7)
    for _ in range(300):
        grams = sorted((rng.randint(0, 9), i) for i in rng.sample(range(12), rng.randint(3, 8)))
        pairs = [(a[0] + b[0]) for a in grams for b in grams if a[1] + 2 <= b[1]]
        if pairs:
            places = spelling.pivots(grams)
            rank = {p: r for r, p in grams}
            assert places[0] + 2 <= places[1] and sum(rank[p] for p in places) == min(pairs)


def test_edges(spark):
    rows = EDGE_ROWS + [(20 + i, t, "en") for i, t in enumerate(
        ["Straße STRAßE straße straße " + "x" * 20_000, "÷×÷×÷ " * 4 + "ABCDE abcde" + "y" * 20_000,
         "abcde abcdf abcde " * 3 + "x" * 20_000, "a bb ccc " * 50 + "x" * 19_999 + "z"])]
    rows += [rows[-1]] * 3
    docs = documents(spark, rows)
    got = found(spelling.variants(spelling.counted(spelling.misspelt(spelling.runs(docs)))))
    assert got == brute(counts([r[:2] for r in rows])) and len(got) == 5
    empty = docs.limit(0)
    assert found(spelling.variants(spelling.counted(spelling.misspelt(spelling.runs(empty))))) == []
