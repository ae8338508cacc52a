"""Near-duplicates, language, personal data, sharding, URLs and pages."""

import collections
import hashlib
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from apiscope.llm import (common, components, crf, near_dups, packing, queries, reputation, sanitise,
                          templates)
from apiscope.llm.common import table

from .helpers import (CLASH, EDGE_ROWS, KINDS, SF, classes_by_force, documents, personal,
                      probability_jaccard, shingles)


def texts_of(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


# near-duplicates

def test_classes_query(spark):
    texts = texts_of(spark)
    rows = queries.op7_probminhash(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_by_force(texts)
    assert len(rows) == len(texts)


def test_class_edges(spark):
    rows = near_dups.classes(documents(spark, EDGE_ROWS)).collect()
    got = sorted(((r.doc_id, r.class_id) for r in rows), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (3, 3), (None, 7), (4, 4), (5, 4), (6, 6), (7, 7),
                          (-8, -8), (9, 9)], key=repr)
    assert near_dups.classes(documents(spark, [])).count() == 0


def test_repeated_and_missing_ids(spark):
    """A text keeps its links whatever ids it stands under."""
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    rows = [(1, a), (1, b), (7, a + " x"), (8, b + " x"), (None, a), (None, "c " * 90), (9, "c " * 89 + "d")]
    got = near_dups.classes(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == sorted(
        [(1, 1), (1, 1), (7, 1), (8, 1), (None, 1), (None, 9), (9, 9)], key=repr)
    # two rows without an id that are near each other, and nothing else
    rows = [(None, a), (None, a + " y"), (2, b)]
    both = near_dups.members(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    assert len({r.label for r in both if r.doc_id is None}) == 1
    assert {r.doc_id: r.class_id for r in both} == {None: None, 2: 2}


def chain(n, step, size=200):
    """Texts of which neighbours are alike and distant ones are not."""
    return [" ".join(f"w{i}" for i in range(k * step, k * step + size)) for k in range(n)]


def test_chains_and_far_members(spark, monkeypatch):
    """Links that the least member of a bucket does not see."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rows = [(i, t, "en") for i, t in enumerate(chain(40, 9))]
    # many texts that share three quarters of their words with each other, in pairs alike
    shared = " ".join(f"s{i}" for i in range(150))
    rows += [(1000 + 2 * i + j, f"{shared} " + " ".join(f"p{i}x{k}" for k in range(50 - j)), "en")
             for i in range(30) for j in range(2)]
    found = {r.doc_id: r.class_id for r in near_dups.classes(documents(spark, rows)).collect()}
    assert found == classes_by_force({i: t for i, t, _ in rows})


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a = collections.Counter(rng.integers(0, 30, 40).tolist())
        b = collections.Counter(rng.integers(0, 30, 50).tolist())
        sides = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
                 for c in (a, b)]
        assert near_dups.similarity(*sides) == pytest.approx(probability_jaccard(a, b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = collections.Counter(rng.zipf(1.6, 900).tolist())
    b = a + collections.Counter(rng.zipf(1.6, 300).tolist())
    doc = np.repeat([0, 1], [len(a), len(b)])
    value = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight = np.array([*a.values(), *b.values()], float)
    agree = []
    for salt in range(30):
        sig = near_dups.signatures(doc, near_dups.mixed(value + np.uint64(salt)), weight, 2)
        agree.append((sig[0] == sig[1]).mean())
    assert np.mean(agree) == pytest.approx(probability_jaccard(a, b), abs=0.03)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 3), (20, 21), *[(100 + i, 101 + i) for i in range(60)]]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert [label[x] for x in (1, 2, 3, 8, 9, 20, 21)] == [1, 1, 1, 8, 8, 20, 20]
    assert {label[100 + i] for i in range(61)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# language

def test_language_query(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    rows = queries.op2_language_crf(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.93 * len(held) and len(held) > 20


def test_language_edges(spark):
    rows = crf.identify(documents(spark, EDGE_ROWS).drop("lang_pred").withColumn(
        "lang_pred", F.lit("x"))).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.lang_pred, r.held_out))
    for none in (1, 2, 6):
        assert {g for g, _ in got[none]} == {"und"}
    assert all(g in ("en", "fr") for i in (3, 4, None, -8) for g, _ in got[i])
    assert got[None] == {(next(iter(got[None]))[0], False)}
    assert crf.identify(documents(spark, [])).count() == 0
    unlabelled = crf.identify(documents(spark, [(1, "a b", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_forward_backward():
    rng = np.random.default_rng(6)
    lengths, k = np.array([3, 1, 4]), 3
    scores, start, move = rng.normal(size=(8, k)), rng.normal(size=k), rng.normal(size=(k, k))
    got, both = crf.marginals(scores, lengths, start, move, pairs=True)
    at, total = 0, np.zeros((k, k))
    for n in lengths:
        own, want = scores[at:at + n], np.zeros((n, k))
        z = 0
        for path in np.ndindex(*[k] * n):
            w = np.exp(start[path[0]] + sum(own[i, s] for i, s in enumerate(path))
                       + sum(move[a, b] for a, b in zip(path, path[1:])))  # noqa: B905
            z += w
            for i, s in enumerate(path):
                want[i, s] += w
        moved = np.zeros((k, k))
        for path in np.ndindex(*[k] * n):
            w = np.exp(start[path[0]] + sum(own[i, s] for i, s in enumerate(path))
                       + sum(move[a, b] for a, b in zip(path, path[1:]))) / z  # noqa: B905
            for a, b in zip(path, path[1:]):  # noqa: B905
                moved[a, b] += w
        assert got[at:at + n] == pytest.approx(want / z)
        total += moved
        at += n
    assert both == pytest.approx(total)


def test_words_forgotten_beyond_the_limit(monkeypatch):
    model = crf.train(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5)
    whole = crf.Labeller(model)
    monkeypatch.setattr(crf, "KEPT_WORDS", 3)
    small = crf.Labeller(model)
    for text in ("the dog", "le chien et", "the cat le chat", None, "x²", "²"):
        assert small.label([text]) == whole.label([text])


# personal data

def written_as(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_query(spark):
    texts = texts_of(spark)
    rows = queries.op4_disclosure(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = personal(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written_as(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(written_as(base).split(",")) <= set(r.spans.split(","))
        assert base or r.spans == ""


HARD = ["a@b.c_d@e.f g@h.i@j.k", "x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "1..2.3.4",
        "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-", "+1 (234) 567-8901 +12 34",
        "+1 4111111111111111 1.2.3.4@x.y", "é😀 me@a.bc 日本+1 234567890", "@a.b", "a" * 3000 + "@b.c",
        "+" * 50 + "1234567890", "1" * 500, "a@" + "b." * 2000 + "c", "\u0002a@b.c\u0002\u0001 1.1.1.1",
        "- 4111 1111 1111 1111 ", "1.2.3.4.", "a@b.c.", "", None]


def test_personal_edges(spark):
    rows = [(i, t, None) for i, t in enumerate(HARD)] + [
        (i, t, g) for i, t, g in EDGE_ROWS if i is None or i not in range(len(HARD))]
    got = sanitise.digests(documents(spark, rows)).collect()
    texts = dict(enumerate(HARD))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in texts:
            assert r.spans == written_as(personal(texts[r.doc_id])), texts[r.doc_id][:60]
    assert sanitise.digests(documents(spark, [])).count() == 0


def disclosure_corpus():
    """One address in four documents, always beside the same rare name."""
    rows = [(i, f"common words here, Zorblax writes from zed@mail.org to all {i}", "en")
            for i in range(4)]
    return rows + [(10 + i, f"common words here and to all from others {i}", "en")
                   for i in range(60)]


def test_disclosing_terms(spark):
    docs = documents(spark, disclosure_corpus())
    terms = sanitise._terms(sanitise._entities(docs.select("doc_id", "text")))
    found = {r.term: r.share for r in sanitise.disclosing(docs, terms).collect()}
    # by hand: 64 documents, 4 with the address; the name stands in just those
    assert found["zorblax"] == pytest.approx(1.0) and found["writes"] == pytest.approx(1.0)
    assert "common" not in found and "from" not in found and "0" not in found
    spans = {r.doc_id: r.spans for r in sanitise.digests(docs).collect()}
    at = disclosure_corpus()[0][1].index("Zorblax")
    assert f"removed:{at}:{at + 7}" in spans[0] and "email:" in spans[0]
    assert spans[10] == ""


def test_rewritten_texts(spark):
    docs = documents(spark, [*disclosure_corpus(), (90, None, None), (91, "", None),
                             (92, "ip 1.2.3.4 and card 4111 1111 1111 1111.", None)])
    docs, back = common.aside(docs, "doc_id", "text")
    out = back(sanitise.rewrite(docs))
    assert out.first().node == "clash" and set(CLASH) <= set(out.columns)
    text = {r.doc_id: r.text for r in out.collect()}
    assert "Zorblax" not in text[0] and "[EMAIL]" in text[0] and "common words here" in text[0]
    assert text[10] == "common words here and to all from others 0"
    assert text[90] is None and text[91] == "" and text[92] == "ip [IP] and card [CARD]."


# sharding

def check_shards(rows, shards):
    assert {r.shard for r in rows} <= set(range(shards))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_sharding_query(spark):
    texts = texts_of(spark)
    rows = queries.op6_vector_packing(spark, SF).collect()
    check_shards(rows, 24)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r["size"]
    largest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load[s] for s in range(24)) <= largest


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of values given as bytes: each value's hash seeds the next."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v, seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def seed_hash(number, salt):
    return spark_hash(struct.pack("<q", number), struct.pack("<i", salt))


def shards_by_force(rows, shards):
    """(doc_id, shard, slot) of (doc_id, text) rows, one item after another."""
    def vector(texts):
        return (sum(len((t or "").encode()) + 8 for t in texts),
                sum(len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for t in texts), len(texts))

    same = {t: spark_hash(None if t is None else t.encode(), struct.pack("<i", t is None)) for _, t in rows}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    share = [max(1, n) / shards for n in vector([t for _, t in rows])]
    buckets, members = shards * packing.BUCKETS_PER_SHARD, collections.defaultdict(list)
    first = buckets
    for t in sorted(groups, key=same.get):
        part = max(n / s for n, s in zip(vector([t] * len(groups[t])), share, strict=True))
        if part <= packing.ALONE_FROM:
            members[same[t] % buckets] += [(i, t) for i in groups[t]]
            continue
        pieces = min(math.ceil(part / packing.CUT_FROM), len(groups[t])) \
            if part > packing.CUT_FROM else 1
        for i in groups[t]:
            members[first + seed_hash(i, 1) % pieces].append((i, t))
        first += pieces
    sizes = {k: [n / s for n, s in zip(vector([t for _, t in m]), share, strict=True)]
             for k, m in members.items()}
    room = [[1.0, 1.0, 1.0] for _ in range(shards)]
    where = {}
    for k in sorted(sizes, key=lambda k: (-max(sizes[k]), k)):
        wanted = [sum(w * v * r for w, v, r in zip(packing.WEIGHTS, sizes[k], free, strict=True))
                  for free in room]
        where[k] = wanted.index(max(wanted))
        room[where[k]] = [r - v for r, v in zip(room[where[k]], sizes[k], strict=True)]
    filled, out = collections.Counter(), []
    for k in sorted(members):
        windows = math.ceil(len(members[k]) / packing.ROWS_PER_SLOT_GROUP)
        for i, _ in sorted(members[k], key=lambda m: (seed_hash(m[0], 2) % windows, m[0])):
            out.append((i, where[k], filled[where[k]]))
            filled[where[k]] += 1
    return sorted(out)


def test_sharding_by_force(spark):
    rows = sorted(texts_of(spark).items())
    got = queries.op6_vector_packing(spark, SF).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == shards_by_force(rows, 24)
    # a group that is cut, one that stands alone, and small ones
    rows = [(i, "copy " * 40) for i in range(900)] + [(i, "some " * 40) for i in range(900, 1000)]
    rows += [(1000 + i, f"text {i // 2} " * (1 + i // 2 % 60)) for i in range(2000)]
    rows += [(5000, None), (5001, ""), (5002, None)]
    docs = documents(spark, [(i, t, "en") for i, t in rows])
    got = packing.shard(docs, shards=4).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == shards_by_force(rows, 4)


def test_sharding_hot_group(spark):
    """A third of the rows are copies; other groups stay together."""
    rows = [(i, "copy " * 40, "en") for i in range(1000)]
    rows += [(1000 + i, f"text {i // 2} " * (1 + i // 2 % 60), "en") for i in range(2000)]
    got = packing.shard(documents(spark, rows), shards=8).collect()
    check_shards(got, 8)
    load, count, where = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for r in got:
        load[r.shard] += r["size"]
        count[r.shard] += 1
        where[text[r.doc_id]].add(r.shard)
    assert max(load.values()) < 1.02 * min(load.values())
    assert max(count.values()) < 1.1 * min(count.values())
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("copy"))


def test_sharding_edges(spark):
    got = packing.shard(documents(spark, EDGE_ROWS), shards=3).collect()
    check_shards(got, 3)
    assert len(got) == len(EDGE_ROWS)
    null = next(r for r in got if r.doc_id == 1)
    assert (null["size"], null.text_crc32) == (8, 0)
    assert packing.shard(documents(spark, []), shards=3).count() == 0


# URLs

def test_reputation_matches_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(queries.ORACLE["op5_host_reputation"]).fetchall()
    got = queries.op5_host_reputation(spark, SF).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def judged(spark, pages, outcomes):
    p = spark.createDataFrame(pages, "page_id long, url string").withColumns(
        {c: F.lit("clash") for c in ("host", "path", "rate", "rule", "verdict", "bad")})
    o = spark.createDataFrame(outcomes, "page_id long, bad int")
    return {r.page_id: r for r in reputation.judge(p, o).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://x.net/fr/?a",
            "http://x.net?/fr/", "x.net/fr/", None, "://", "http://com", "ftp://notcom/",
            "http://a.com/://b", "http://www.example.com:80/en/", "a\nb://Ä.com/\nx"]
    rows = judged(spark, list(enumerate(urls)), [])
    got = [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(rows.items())]
    assert got == [
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x.net", "/fr/", "net/fr/", "block"), ("x.net", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("com", "", None, "allow"), ("notcom", "/", None, "allow"),
        ("a.com", "/://b", "com/", "allow"), ("www.example.com:80", "/en/", None, "allow"),
        ("Ä.com", "/\nx", "com/", "allow")]


def test_shrinkage(spark):
    """Bad hosts are blocked; one bad label of a good domain's host is not enough."""
    pages, outcomes, n = [], [], 0
    for host, bad, good in [("bad.spam.org", 60, 0), ("worse.spam.org", 40, 0),
                            ("one.spam.org", 0, 0), ("good.fine.org", 0, 80),
                            ("new.fine.org", 1, 0), *[(f"h{i}.fine.org", 0, 30) for i in range(5)]]:
        for label in [1] * bad + [0] * good + [None]:
            pages.append((n, f"http://{host}/p{n}"))
            outcomes.append((n, label))
            n += 1
    rows = judged(spark, pages, outcomes)
    verdict = {r.host: r.verdict for r in rows.values()}
    assert verdict["bad.spam.org"] == verdict["worse.spam.org"] == "block"
    assert verdict["good.fine.org"] == verdict["new.fine.org"] == "allow"
    rate = {r.host: r.rate for r in rows.values()}
    assert rate["one.spam.org"] > 0.8 and rate["new.fine.org"] < 0.6
    assert judged(spark, [], []) == {}


# pages

def test_pages_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    rows = queries.op3_site_templates(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        page = pages[r.page_id]
        article = page[page.index("<article"):page.index("</article")]
        article = re.sub(r"<(?!/?b>)[^>]*>", " ", article)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", article)).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b  c", "a b c"),
    ("<article><h1>T</h1><p>x<b>y</b>z<br>w</article><div>no</div>", "T xyz w"),
    ("<body><nav>menu</nav><p>kept</p><form>f</form><aside>s</aside></body>", "kept"),
    ("<script>if (a<b) '</p>'</script><p>t</p><style>p{}</style>", "t"),
    ("<p title='a>b' class=\"x\">q</p><div class='ad box'>ad</div><div id=comments>c</div>", "q"),
    ("<header>site</header><main><header><h1>H</h1></header><p>m</p></main><footer>f</footer>", "H m"),
    ("<div role=main><p>x</p></div><div>y</div>", "x"), ("<p>a</b></p></div><p>b", "a b"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>", "1 2 3 4 5"),
    ("<!-- x --><p>&#233;&eacute;&#x1F600;&nbsp;z&bogus;</p><!-- open", "éé😀 z&bogus;"),
    ("<p>1 < 2 <3</p>", "1 < 2 <3"), ("<script>never ends", ""), ("<p \"broken>x</p>", "x"),
    ("<article>one</article><p>gap</p><article>two</article>", "one two"),
    ("<article>a<div hidden>h</div><div style='display: none'>d</div>b</article>", "a b"),
    ("<article><p>t</p><div class='share-bar'>s</div><section id=respond>r</section></article>", "t"),
])
def test_main_text(page, text):
    assert templates.main_text(page, set()) == text


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("host", "row", "hash", "template", "text", "n_chars")})


def test_site_templates(spark):
    """What recurs on a host goes, unless it is text of an article."""
    rows = [(i, f"http://a.org/{i}", f"<div><div>Site name</div><div>own text {i}</div>"
             f"<section>Call us</section></div>") for i in range(20)]
    rows += [(100 + i, f"http://b.org/{i}", f"<div><div>Site name</div><div>b text {i}</div></div>")
             for i in range(3)]
    rows += [(200 + i, f"http://c.org/{i}", f"<article><p>Shared passage</p><p>c {i}</p>"
              f"<div><span>Follow us</span></div></article>") for i in range(20)]
    got = {r.page_id: r.text for r in templates.extract(page_table(spark, rows)).collect()}
    assert got[0] == "own text 0" and got[19] == "own text 19"
    assert got[100] == "Site name b text 0"  # too few pages to tell
    assert got[205] == "Shared passage c 5"


def test_page_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b/", "<p>t"), (3, "http://a.b/", "<p>t"),
            (3, "http://a.b/", "<p>t"), (4, "http://a.b/", "<div>" * 3000 + "deep" + "</div>" * 2999),
            (5, "http://a.b/", "<p>" + "long text " * 100_000)]
    got = templates.extract(page_table(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [
        (0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 4), (5, 999_999)]
    assert templates.extract(page_table(spark, [])).count() == 0


def test_all_similarities_of_a_text_at_once():
    rng = np.random.default_rng(8)
    sets = [collections.Counter(rng.integers(0, 25, rng.integers(1, 60)).tolist()) for _ in range(30)]
    doc = np.concatenate([[i] * len(s) for i, s in enumerate(sets)])
    number = np.concatenate([sorted(s) for s in sets])
    weight = np.array([s[k] for s in sets for k in sorted(s)], float)
    for i in range(30):
        got = near_dups.alike(i, doc, number, weight, 30)
        assert got == pytest.approx([probability_jaccard(sets[i], s) for s in sets])
