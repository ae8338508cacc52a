"""Secret scan: known forms against plain patterns, random strings planted among words."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

from apiscope.llm import queries, randomness
from apiscope.llm.randomness import LEVEL, Statistics, first_bins, models, statistics

from .helpers import EDGE_ROWS, SF, documents

FORMS = [r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""",
         "AKIA[A-Z0-9]+", "[0-9a-f]+"]


def known(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            size = len(m.group(2)) if k == 0 else len(m.group())
            if size >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{randomness.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_base(rows, got):
    expected = sorted(
        (-1 if i is None else i, *(sum(s[1] == k for s in known(t)) for k in range(3)),
         hashlib.sha256(written(known(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)
                  for r in got) == expected


def test_query_against_patterns(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_randomness_battery(spark, SF).collect()
    check_base(rows, got)
    texts = {i: [] for i, _ in rows}
    for i, t in rows:
        texts[i].append(written(known(t)))
    assert all(r.spans in texts[r.doc_id] for r in got)  # nothing in plain prose looks random


HARD = ["TOKEN = 'abcdef'", "api-key: abcdef apikey:abc", "secret\" : \"x.y=z-1", "token: abc token: abcdefg",
        "ſecret=abcdefgh toKen=abcdefgh", "passwordpasswd=abcdef=secret=abcdef", "é" * 50 + "AKIA" + "A" * 16,
        "AKIAAKIA" + "B" * 12 + " AKIA", "0" * 24 + "g" + "f" * 23, "a" * 100_000 + "\n" + "deadbeef" * 9,
        "token" * 20_000, "token" + " " * 50_000, "secret: " + "A" * 70_000, "x=" * 30_000]


def test_edges(spark):
    rows = EDGE_ROWS + [(100 + i, t, "en") for i, t in enumerate(HARD)]
    docs = documents(spark, rows)
    got = randomness.digests(randomness.scan(docs)).collect()
    check_base([r[:2] for r in rows], got)
    assert randomness.digests(randomness.scan(docs.limit(0))).collect() == []


def test_planted(spark):
    """Random strings of several encodings are found where they stand; names and paths are not."""
    rng = random.Random(5)
    words = "the cat sat on a mat while old dogs bark at every house in this long street of ours".split()
    names = ["src/main/java/org/example/service", "some_very_long_variable_name", "getElementsByTagNameFromTree",
             "https//www/example/com/index/page", "internationalisation-of-names", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "0123456789abcdefABCDEF0123456789abcdef", "20240101120000123456789", "abcdefghijklmnopqrstuvwxyz012345"]
    rows, planted = [], set()
    for i in range(900):
        text = " ".join(rng.choices(words, k=60)) + " é "
        if i % 3 == 0:
            raw = rng.randbytes(30)
            key = rng.choice((base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(),
                              base64.b32encode(raw).decode(), raw.hex().upper()))
            planted.add((i, len(text), len(text) + len(key)))
            text += key
        else:
            text += rng.choice(names)
        rows.append((i, text + " " + " ".join(rng.choices(words, k=20)), "en"))
    found = {(r.doc_id, s.start, s.end) for r in randomness.scan(documents(spark, rows)).collect()
             for s in r.spans if s.kind == 3}
    assert len(found & planted) >= 0.9 * len(planted)
    assert not found - planted


def test_many_spans_are_linear(spark):
    text = " ".join(f"token={'ab' * 12}{i:06d} plain/path/of/some/words{i}" for i in range(20_000))
    row, = randomness.digests(randomness.scan(documents(spark, [(1, text, "en")]))).collect()
    assert row.n_assign == 20_000 and row.n_hex == 20_000


def test_moments_against_simulation():
    """Mean and deviation of the three statistics in strings of independent letters."""
    rng = np.random.default_rng(3)
    pairs = np.zeros((128, 128))
    letters = [ord(c) for c in randomness.ALPHABETS["base64"]]
    share = rng.dirichlet(np.full(64, 0.4))
    pairs[np.ix_(letters, letters)] = np.outer(share, share) * 1e9
    ordinary = models(pairs)["base64"][0]
    for n in (20, 60):
        scores = np.array([randomness._scores(statistics("".join(map(chr, rng.choice(
            letters, n, p=share))), "base64"), ordinary) for _ in range(4000)])
        assert np.abs(scores.mean(axis=0)).max() < 0.1
        assert np.abs(scores.std(axis=0) - 1).max() < 0.2


def test_uniform_strings_pass_the_battery():
    rng = random.Random(8)
    for name, letters in randomness.ALPHABETS.items():
        own, uniform = models(np.zeros((128, 128)))[name]
        passed = sum(randomness.judged(statistics("".join(rng.choices(letters, k=40)), name), own, uniform)[1]
                     for _ in range(500))
        assert passed >= 480


def test_bins_hold_the_rate():
    """The first bin found is the one of the plain step-up procedure on binned p-values."""
    rng = random.Random(2)
    for _ in range(200):
        ps = [rng.random() ** rng.choice((1, 1, 12)) for _ in range(rng.randint(1, 300))]
        bins = [randomness._bin(p) for p in ps]
        upper = sorted((10**(-b / randomness.BINS), b) for b in bins)
        ranks = [i for i, (p, _) in enumerate(upper, 1) if len(ps) * p <= LEVEL * i]
        expected = {} if not ranks else {"hex:9": upper[ranks[-1] - 1][1]}
        counts = {("hex", 9, b): bins.count(b) for b in bins}
        assert first_bins(counts, LEVEL) == expected


@pytest.mark.parametrize("token,expected", [
    ("12345678901234567890", None), ("ab12", "hex"), ("AB12", "HEX"), ("ABZ2", "base32"), ("ab1z", "base36"),
    ("AB1Z", "BASE36"), ("aB1z", "base64"), ("a-_z==", "base64"), ("a+/z", "base64"), ("a+_z", None)])
def test_encodings(token, expected):
    assert randomness.encoding_of(token) == expected


def test_longer_strings_are_stronger_evidence():
    pairs = np.ones((128, 128))
    pairs[97:123, 97:123] = 1000
    ordinary, uniform = models(pairs)["base64"]
    rng = random.Random(6)
    p = [randomness.judged(statistics("".join(rng.choices(randomness.ALPHABETS["base64"], k=n)), "base64"),
                           ordinary, uniform)[0] for n in (8, 20, 60)]
    assert p[0] > p[1] > p[2] and isinstance(Statistics(1, 0.0, 0, 0.0), tuple) and math.isfinite(p[2])
