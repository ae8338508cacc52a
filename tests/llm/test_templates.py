"""Site templates: what is counted, and what counts."""

import random
import time

import pytest

from apiscope.llm import templates


def digest(name, text):
    """The hash of a subtree, by a sum over its letters."""
    h = sum(ord(c) * templates._BASE ** i for i, c in enumerate(text)) % (1 << 64)
    return templates.xxhash.xxh64_intdigest(
        h.to_bytes(8, "little"), templates.xxhash.xxh32_intdigest(name)) - (1 << 63)


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in templates.extract(df).collect()}


def test_all_elements_are_counted():
    """Menus, adverts, footers and their parts too, beside an article."""
    page = ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=ad>Buy</div>"
            "<article><h1>T</h1><p>x <b>y</b></p></article><footer>Legal</footer></body></html>")
    found = templates.candidates(page)
    assert found == {digest(*x) for x in [
        ("nav", "Home"), ("ul", "Home"), ("li", "Home"), ("a", "Home"), ("div", "Buy"),
        ("footer", "Legal")]}
    assert templates.main_text(page, found) == "T x y"


def test_inline_elements_and_whole_articles(spark):
    """Links of a bar without a name go; running text and copies of an article stay."""
    rows = [(i, f"http://a.org/{i}", f"<div><a>Home</a> <b><a>About</a></b> <a>own {i}</a></div>"
             f"<p>see <b>also</b> {i}</p>") for i in range(20)]
    rows += [(100 + i, f"http://b.org/{i}",
              "<div><div role=main><p>copied</p></div></div>") for i in range(20)]
    got = extracted(spark, rows)
    assert got[3] == "own 3 see also 3"
    assert got[105] == "copied"


def test_many_pages_of_a_large_host(spark):
    """A section's block goes although most pages of the host lack it; a rare one stays."""
    rows = [(i, f"http://a.org/{i}", f"<div><section>{'Shop' if i % 5 == 0 else f'own {i}'}</section>"
             f"<section>{'Rare' if i % 20 == 1 else 'x'} {i}</section>"
             f"<section>{'Few' if i % 20 == 2 else i}</section></div>") for i in range(600)]
    got = extracted(spark, rows)
    assert got[5] == "x 5 5" and got[6] == "own 6 x 6 6" and got[2] == "own 2 x 2 Few"


def test_hashes_of_parts_of_random_pages():
    """White space and edges of pieces anywhere: a part's hash is that of its own text."""
    rng = random.Random(4)
    for _ in range(60):
        pieces = ["".join(rng.choice("ab \n\u00a0\u4e2d\U0001f600") for _ in range(rng.randrange(6)))
                  for _ in range(rng.randrange(1, 30))]
        spans = [sorted((rng.randrange(len(pieces) + 1), rng.randrange(len(pieces) + 1))) for _ in range(40)]
        got = templates._hashes(pieces)([a for a, _ in spans], [b for _, b in spans])
        for (a, b), h in zip(spans, got, strict=True):
            text = " ".join("".join(pieces[a:b]).split())
            assert h == (sum(ord(c) * templates._BASE ** i for i, c in enumerate(text)) % (1 << 64)
                         if text else None)


def test_hashes_across_strides():
    text = "ab" * templates._STRIDE
    of = templates._hashes(["x", text, "y", text])
    a, b, c = of([1, 3, 0], [2, 4, 2])
    assert a == b != c


def test_tags_as_the_plain_pattern_finds_them():
    """Quotes that swallow ends, quotes that never close, and names that run on."""
    rng = random.Random(5)
    for _ in range(3000):
        page = "".join(rng.choice(["<a", "<b ", ">", "\"", "'", " x", "</a", "<", "=", "<!", "<!--", "-->", "/"])
                       for _ in range(rng.randrange(1, 16)))
        tags, again, at = templates._Tags(page), templates._Tags(page), 0
        again._find_ends()
        while True:
            found = tags.find(at)
            assert found == again.find(at), page
            if found is None:
                break
            at = found[1]


@pytest.mark.parametrize("unit,tail", [
    ("<div>word ", ""), ("<div><i>w ", ""), ("<a ", ""), ("<a", ""), ("<a \"x> ", "'>"), ("<!", ""),
    ("<i>x<h1>", ""), ("</b><div>", ""), ("<p><td><i><h1>", ""), ("<li><b>z", ""), ("<div class='", ""),
    ("&lt;<x y='\">", ""), ("<script>", ""), ("<!-- ", "")])
def test_a_megabyte_of_markup_in_seconds(unit, tail):
    page = unit * (1_000_000 // len(unit)) + tail
    begun = time.time()
    templates.main_text(page, templates.candidates(page) if "word" not in unit else {0})
    assert time.time() - begun < 20
