"""Co-occurrence over whole documents."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from apiscope.llm import sanitise

from .helpers import documents

FAR = "plain filler words " * 20


def test_names_far_from_their_entity(spark):
    """A name beyond any window is found, at every place, and at the text's own ends."""
    rows = [(i, f"Zorblax {FAR}zed@mail.org {FAR}Zorblax, zorblax2 {i} ZORBLAX", "en")
            for i in range(4)]
    rows += [(10 + i, f"{FAR}from others {i}", "en") for i in range(60)]
    # the same row twice is one document, and no evidence
    rows += [(90, f"Quux {FAR}one@mail.org", "en")] * 2
    # words that are partly in a span are none
    rows += [(100 + i, f"4111111111111111name {FAR}", "en") for i in range(2)]
    got = {r.doc_id: r.spans.split(",") for r in sanitise.digests(documents(spark, rows)).collect()}
    for i in range(4):
        text = rows[i][1]
        places = [0, text.index("Zorblax,"), text.index("ZORBLAX")]
        assert [s for s in got[i] if not s.startswith("email")] == sorted(
            [f"removed:{at}:{at + 7}" for at in places]
            + [f"removed:{text.index('zorblax2')}:{text.index('zorblax2') + 8}"],
            key=lambda s: int(s.split(":")[1]))
    assert all(s.startswith("email") for s in got[90])
    assert got[10] == [""] and all(s.startswith("card") for s in got[100])


def brute(texts):
    """Spans of every text, added ones included, by plain loops over words and e-mail addresses."""
    n, held = len(texts), {}
    for i, text in enumerate(texts):
        for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", text):
            held.setdefault(m[0], set()).add(i)
    outside = [re.sub(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", lambda m: "\0" * len(m[0]), t) for t in texts]
    words = [set(re.findall(r"[a-z0-9]+", t)) for t in outside]
    df = Counter(w for t in texts for w in set(re.findall(r"[a-z0-9]+", t)))
    kinds = [{} for _ in texts]
    for entity, docs in held.items():
        both = Counter(w for i in docs for w in words[i])
        for w, c in both.items():
            if c < 2 or len(docs) < 2 or n == len(docs):
                continue
            share = math.log2(n * c / (df[w] * len(docs))) / math.log2(n / len(docs))
            if share >= 0.6:
                for i in docs:
                    if w in words[i]:
                        kinds[i][w] = min(kinds[i].get(w, 9), 4 if share >= 0.9 else 5)
    out = []
    for i, text in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", text)]
        spans += [(m.start(), kinds[i][m[0]], m.end()) for m in re.finditer(r"[a-z0-9]+", outside[i])
                  if m[0] in kinds[i]]
        out.append(",".join(f"{(sanitise.KINDS + sanitise.ADDED)[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    return out


def test_added_spans_by_brute_force(spark):
    rng = random.Random(2)
    people = [(f"p{i}@mail.org", [f"name{i}", f"team{i % 4}"]) for i in range(12)]
    texts = []
    for _ in range(160):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 30))]
        for mail, near in rng.sample(people, rng.choice([0, 0, 1, 2])):
            words += [mail, *[w for w in near if rng.random() < 0.9]]
        rng.shuffle(words)
        texts.append(" ".join(words))
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in sanitise.digests(documents(spark, rows)).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w.count("removed") for w in want) > 30 and sum(w.count("generalised") for w in want) > 5


def test_overlapping_spans_become_one(spark):
    """Against a walk over the spans, with spans of all kinds that cross, touch or hold each other."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("ab1 \u4e2d\U0001f600\ue000\ue010\x02") for _ in range(rng.randrange(0, 1300)))
        spans = []
        for kind in range(6):
            at = 0
            while at < len(text) - 20 and rng.random() < 0.8:
                a = at + rng.randrange(0, 12)
                at = a + rng.randrange(1, 700 if rng.random() < 0.1 else 9)
                if at <= len(text) and (kind < 4 or not any(a < e and s < at for s, _, e in spans)):
                    spans.append((a, kind, at))
        rows.append((i, text, sorted(spans)))
    df = spark.createDataFrame([(i, t, [(a, k, b, None) for a, k, b in s]) for i, t, s in rows],
                               f"i int, text string, spans {sanitise._SPAN}")
    got = {r.i: r.t for r in df.select("i", sanitise._replaced(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        out, end = [], 0
        for a, kind, b in spans:
            if a >= end:
                mark = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[WORD]"][kind]
                out += [text[end:a], "[NUMBER]" if kind == 5 and re.fullmatch("[0-9]+", text[a:b]) else mark]
            end = max(end, b)
        assert got[i] == "".join(out) + text[end:], (text, spans)


def test_twenty_thousand_spans_in_seconds(spark):
    text = " ".join(f"user{i}@host{i}.org word{i}" for i in range(20_000))
    rows = [(1, text, "en"), (2, text + " end", "en"), (3, "nothing here", "en"), (4, "none", "en")]
    begun = time.time()
    got = {r.doc_id: r for r in sanitise.digests(documents(spark, rows)).collect()}
    assert got[1].n_email == got[2].n_email == 20_000 and got[3].spans == ""
    assert "removed" in got[1].spans
    out = {r.doc_id: r.text for r in sanitise.rewrite(documents(spark, rows)).select("doc_id", "text").collect()}
    assert out[2].startswith("[EMAIL] ") and out[2].count("[EMAIL]") == 20_000 and out[3] == "nothing here"
    assert time.time() - begun < 150


def test_many_groups_of_one_document_are_dealt(spark):
    """A document that shares each of its addresses with another one meets its words in blocks."""
    n = 3 * sanitise._BLOCK
    rows = [(0, " ".join(f"u{i}@m.org name{i}" for i in range(n)), "en")]
    rows += [(1 + i, f"u{i}@m.org name{i} and some", "en") for i in range(n)]
    rows += [(1000 + i, "other text", "en") for i in range(20)]
    got = {r.doc_id: r.spans for r in sanitise.digests(documents(spark, rows)).collect()}
    assert got[0].count("email") == n and got[0].count("removed") == n
    assert got[5].startswith("email:0:8,removed:9:14")
