"""Names defined through other names."""

import random

from apiscope.operators import extract, resolve


def chased(spark, names, values):
    got = resolve.resolve_aliases(
        spark.createDataFrame(names, "file string, name string, target string"),
        spark.createDataFrame(values, "file string, name string, value string"))
    return {(r.file, r.name): (r.value, r.cyclic) for r in got.collect()}


def brute(names, values):
    edges = {(f, n): t for f, n, t in names}
    known = {(f, n): v for f, n, v in values}
    out = {}
    for f, n in edges:
        if (f, n) in known:
            continue
        seen, at = set(), n
        while (f, at) in edges and (f, at) not in known and at not in seen:
            seen.add(at)
            at = edges[f, at]
        cyclic = (f, at) in edges and (f, at) not in known
        out[f, n] = (None if cyclic else known.get((f, at)), cyclic)
    return out


def test_against_a_walk(spark):
    rng = random.Random(3)
    names = [(f, f"n{i}", f"n{rng.randrange(40)}") for f in "abcdef" for i in range(25)]
    values = [(f, f"n{i}", f"{f}{i}") for f in "abcde" for i in range(23, 34)]
    want = brute(names, values)
    assert chased(spark, names, values) == want
    assert {c for _, c in want.values()} == {True, False}


def test_long_chains_in_few_rounds(spark):
    n = 3000
    names = [("f", f"a{i}", f"a{i + 1}") for i in range(n)] + [("g", "x", "x"), ("h", "y", "none")]
    got = chased(spark, names, [("f", f"a{n}", "/api/end")])
    assert all(got["f", f"a{i}"] == ("/api/end", False) for i in range(n))
    assert got["g", "x"] == (None, True) and got["h", "y"] == (None, False)
    assert chased(spark, [], []) == {}


def test_calls_on_aliased_names(spark):
    files = spark.createDataFrame([
        ("a.js", 'const A = "/api/root"; const B = A; fetch(B + "/x")', "javascript"),
        ("b.js", 'const C=D;const D=C;\nfetch(C + "/api/y")', "javascript"),
        ("c.py", 'HOST = "/api/h"\nBASE = HOST\r\nrequests.get(BASE)', "python"),
        ("d.js", 'const A = B; const A = "/api/own"; const B = "/api/b"; fetch(A)', "javascript"),
        ("e.js", None, "javascript"), ("f.js", "", "javascript")], "file string, text string, language string")
    got = resolve.resolved_calls(extract.call_sites(files), resolve.with_aliases(files))
    assert {(r.file, r.url) for r in got.collect()} == {
        ("a.js", "/api/root/x"), ("b.js", "/api/y"), ("c.py", "/api/h"), ("d.js", "/api/own")}
