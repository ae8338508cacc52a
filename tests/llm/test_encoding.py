"""BPE by trie, and token files: against the tokenizers library."""

import hashlib
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from apiscope.llm import bpe, queries, separators
from apiscope.llm.common import table

from .helpers import EDGE_ROWS, SF, documents

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@pytest.fixture(scope="module")
def coder():
    with open(FILE, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(coder, text):
    found, = coder.encode([text])
    assert ids(found) == expected(text)
    assert coder.decode(found) == LIBRARY.decode(expected(text), skip_special_tokens=False)


def test_every_letter(coder):
    texts = ["".join(f"{chr(c)} {chr(c)}a1" for c in range(b, b + 997) if not 0xD800 <= c < 0xE000)
             for b in range(0, min(sys.maxunicode, 0x20000) - 997, 997)]
    for text, found in zip(texts, coder.encode(texts), strict=True):
        assert ids(found) == expected(text)


@pytest.mark.parametrize("text", [
    "", " ", "\n\n  x", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "don't I'll we've",
    "a" * 5000, "ab" * 3000 + "é" * 999, "   leading", "trailing   ", "x y\u0085z\x1c"])
def test_hard_texts(coder, text):
    assert ids(coder.encode([text])[0]) == expected(text)


def test_special_as_text(coder):
    found, = coder.encode(["a<|endoftext|>"], special=False)
    assert separators.SEPARATOR not in ids(found)
    assert coder.decode(found) == "a<|endoftext|>"


def test_words_are_forgotten_beyond_the_limit(coder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    texts = ["one two three four five six seven", "eight nine one two", "ten one"]
    assert [ids(c) for t in texts for c in coder.encode([t])] == [expected(t) for t in texts]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.op9_trie_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want), digest(np.array(want, "<u4").tobytes()),
            digest(texts[r.doc_id].encode()))


def test_edges(spark):
    rows = bpe.digests(documents(spark, EDGE_ROWS), FILE).collect()
    want = [(i, len(expected(t or "")), digest((t or "").encode())) for i, t, _ in EDGE_ROWS]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows), key=repr) == sorted(
        want, key=repr)
    assert bpe.digests(documents(spark, []), FILE).count() == 0


def test_token_counts_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.op1_separator_scan(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted(
        (i, len(expected(t))) for i, t in texts.items())


def test_token_counts_edges(spark):
    rows = EDGE_ROWS + [(10, "a<|endoftext|>b", "en")]
    found = separators.counted(documents(spark, rows), FILE).collect()
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(want, key=repr)
    assert separators.counted(documents(spark, []), FILE).count() == 0


@pytest.mark.parametrize("split", ["40", "1000", "128m"])
def test_foreign_files_in_small_blocks(spark, tmp_path, split):
    """Files without trailers, one unfinished; blocks smaller than documents, odd in size."""
    rng = np.random.default_rng(3)
    want = []
    folder = tmp_path / "tokens"
    folder.mkdir()
    for name, ends in (("a", True), ("b", False), ("c", True)):
        docs = [rng.integers(0, 65536, n) for n in (0, 5, 300, 0, 1, 2000, 17)]
        docs = [np.where(d == separators.SEPARATOR, 7, d) for d in docs]
        # ids whose bytes look like the separator's
        docs[2][::7], docs[2][1::7] = 0x00C4, 0x5000
        docs[5][::2] = 0x5050
        data = b"".join(d.astype(">u2").tobytes() + b"\xc4\x50" for d in docs)
        (folder / name).write_bytes(data if ends else data[:-2])
        want += [len(d) for d in docs]
    (folder / "empty").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = separators.count_tokens(spark, str(folder), str(tmp_path / "work"), trailer=0)
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.n_tokens for r in rows) == sorted(want)
    assert all(r.doc_id is None for r in rows if r.n_tokens < 11)


@pytest.mark.parametrize("unit", ["a", "-", " ", "xq", "\u00e9", "abcdefghijklmnopqrstuvwxyz"])
def test_unbroken_words_take_little_memory(coder, unit):
    """Long words are encoded as the library does, in memory proportional to them."""
    import tracemalloc

    text = unit * (40_000 // len(unit))
    assert ids(coder.encode([text], special=False)[0]) == expected(text)
    text = unit * (100_000 // len(unit))
    tracemalloc.start()
    found, = coder.encode([text], special=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and coder.decode(found) == text


def test_word_of_a_million_letters(coder):
    found, = coder.encode(["ab" * 500_000], special=False)
    assert coder.decode(found) == "ab" * 500_000


def test_word_cache_generations(coder, monkeypatch):
    """Words come back from the older generation; results do not depend on what is kept."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    for round_ in range(6):
        texts = [" ".join(f"{w}{(i * round_) % 11}" for i in range(30)) for w in ("ab", "token", "é")]
        for text, found in zip(texts, coder.encode(texts), strict=True):
            assert ids(found) == expected(text)
    assert len(coder.known) < 400
