import re

import pytest
from pyspark.sql import functions as F

from apiscope.functions.core import exact_text, match_positions
from apiscope.operators import extract, resolve

JS = '''
const API_BASE = "https://api.example.com"; // don't trip over this
const USER_ENDPOINT = "/api/v1/users";
/* "/api/v1/comment" */
async function load() { return await fetch(API_BASE + USER_ENDPOINT); }
axios.post("/api/v1/users", data);
fetch("/api/admin/dashboard");
fetch(USER_ENDPOINT);
const U = { list: "/api/v2/list", other: 'x' };
request(U.list); fetch(`/api/${USER_ENDPOINT}/x/${nope}/${U.list}`);
'''


def source(spark, text, name="app.js"):
    df = spark.createDataFrame([(name, text)], "file string, text string")
    return df.withColumn("language", extract.language_of("file"))


@pytest.mark.parametrize("path,language", [
    ("app.js", "javascript"), ("a/App.JSX", "javascript"), ("x.mjs", "javascript"),
    ("x.cjs", "javascript"), ("app.ts", "typescript"), ("app.tsx", "typescript"),
    ("app.py", "python"), ("app.pyw", "python"), ("app.txt", None), ("js", None), (".js", None)])
def test_language(spark, path, language):
    assert spark.range(1).select(extract.language_of(F.lit(path)).alias("y")).first().y == language


def test_positions_by_brute_force(spark):
    pattern = r"[xyz]\d+[\u0001-\u0003]?"
    texts = ["aa x12 b\n\n y7 \u0002 z9\nx1", "x1\u0002y2", "é漢x1\n\nx2é", "", "none", "x1", "\nx1\n"]
    rows = (spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
            .select("i", "t", F.inline(match_positions(F.col("t"), pattern)))
            .withColumn("m", exact_text(F.col("t"), F.col("m"), F.col("at"))).collect())
    want = [(i, m.group(), m.start(), t[:m.start()].count("\n") + 1,
             m.start() - t.rfind("\n", 0, m.start()))
            for i, t in enumerate(texts) for m in re.finditer(pattern, t)]
    assert sorted((r.i, r.m, r["at"], r.line, r.column) for r in rows) == sorted(want)


def test_many_matches_in_one_text(spark):
    text = "\n".join(f'f("/api/{i}")' for i in range(20000))
    got = extract.literal_endpoints(source(spark, text)).agg(
        F.count("*"), F.max("line"), F.max("column")).first()
    assert tuple(got) == (20000, 20000, 3)


def test_escapes_keep_the_original_text(spark):
    rows = extract.literal_endpoints(source(spark, 'a = "x\\"y"; b = "/api/q\\"z"')).collect()
    assert [r.url for r in rows] == ['/api/q\\"z']


def test_literals(spark):
    rows = extract.literal_endpoints(source(spark, JS)).collect()
    got = [(r.url, r.line, r.column) for r in rows]
    assert ("/api/v1/users", 3, 23) in got and ("/api/admin/dashboard", 7, 7) in got
    assert all("comment" not in u for u, _, _ in got)
    assert {r.method for r in rows} == {"GET"}


def test_non_ascii_text_keeps_positions(spark):
    rows = extract.literal_endpoints(source(spark, 'é = "ü"; f("/api/x")')).collect()
    assert [(r.url, r.line, r.column) for r in rows] == [("/api/x", 1, 12)]


def test_calls(spark):
    rows = extract.call_sites(source(spark, JS)).orderBy("ord").collect()
    assert [(r.function, r.verb, r.arg_kind) for r in rows] == [
        ("fetch", "GET", "concat"), ("post", "POST", "literal"), ("fetch", "GET", "literal"),
        ("fetch", "GET", "name"), ("request", "GET", "member"), ("fetch", "GET", "template")]
    assert {(r.url, r.method) for r in extract.call_endpoints(source(spark, JS)).collect()} >= {
        ("/api/v1/users", "POST"), ("/api/admin/dashboard", "GET")}


def test_long_chain_does_not_overflow(spark):
    chain = " + ".join(f'"p{i}"' for i in range(20000))
    rows = extract.call_sites(source(spark, f"fetch({chain});")).collect()
    assert len(rows) == 1 and rows[0].argument.endswith('"p19999"')


def test_python_calls(spark):
    text = 'requests.get("/api/a")\nx = requests.post(URL)\nother.get("/api/b")\n'
    rows = extract.call_sites(source(spark, text, "a.py")).collect()
    assert [(r.function, r.verb) for r in rows] == [("requests.get", "GET"), ("requests.post", "POST")]


def test_resolution(spark):
    got = {(r.url, r.method) for r in resolve.resolved_endpoints(source(spark, JS)).collect()}
    assert got == {("https://api.example.com/api/v1/users", "GET"), ("/api/v1/users", "GET")}
    concat = 'const BASE = "/api/v1";\nconst USERS = "/users";\nfetch(BASE + USERS);'
    assert [r.url for r in resolve.resolved_endpoints(source(spark, concat)).collect()] \
        == ["/api/v1/users"]


def test_resolution_priority_and_first_wins(spark):
    text = ('cfg = { A: "prop" }; A = "assigned"; A = "later"; let B = `tpl`; let A = "declared"; '
            "fetch(A); fetch(B);")
    rows = resolve.resolve_call_names(source(spark, text)).collect()
    assert {(r.name, r.value) for r in rows} == {("A", "declared"), ("B", "tpl")}


def test_deep_chains_keep_all_operands(spark):
    chain = " + ".join(f'"{i}"' for i in range(15))
    got = resolve.resolve_concats(source(spark, f"fetch({chain})")).first().url
    assert got == "".join(str(i) for i in range(15))
    names = 'const X = "x";' + "fetch(" + " + ".join(["X"] * 15) + ")"
    assert resolve.resolve_concats(source(spark, names)).first().url == "x" * 15


def test_unresolved_operands_are_skipped(spark):
    got = resolve.resolve_concats(source(spark, 'fetch(NOPE + "/api/x" + obj.y)')).first().url
    assert got == "/api/x"


def test_templates_and_members(spark):
    got = resolve.resolve_templates(source(spark, JS)).first()
    assert got.resolved == "/api//api/v1/users/x/${...}/"
    member = resolve.resolve_members(source(spark, JS)).first()
    assert (member.argument, member.value) == ("U.list", "/api/v2/list")


def test_constant_substitution(spark):
    df = spark.createDataFrame([('A = "1"; B = "{A}x"; A = "2"',)], "t string")
    got = df.select(resolve.substitute(F.lit("${A}/{B}/${C}"),
                                       resolve.tracked_constants(F.col("t"))).alias("y")).first().y
    # in definition order: A is replaced first, so the {A} that B brings stays
    assert got == "2/{A}x/${C}"


def test_secrets(spark):
    text = 'x\nconst K = "safe_stripe_123456789";\nconst A = "SAFE_AWS_12345EXAMPLE";'
    table = (("stripe_key", r"safe_stripe_[a-z0-9]+", "critical", None, ("safe",)),
             ("aws_access_key", r"SAFE_AWS_[A-Z0-9]+", "critical", None, ("SAFE",)))
    rows = extract.secrets(source(spark, text), table).collect()
    assert {(r.type, r.value, r.line, r.column) for r in rows} == {
        ("stripe_key", "safe_stripe_123456789", 2, 12),
        ("aws_access_key", "SAFE_AWS_12345EXAMPLE", 3, 12)}


def test_file_summary_drops_silent_files(spark):
    files = source(spark, 'fetch("/api/x")').unionByName(source(spark, "nothing", "b.js"))
    endpoints = extract.literal_endpoints(files)
    rows = extract.file_summary(endpoints, extract.secrets(files)).collect()
    assert [(r.file, r.endpoint_count, r.secret_count, r.error_count) for r in rows] \
        == [("app.js", 1, 0, 0)]


def test_inline_scripts(spark):
    body = "v" * 101
    html = (f'<script src="x.js">{body}</script><script>short</script>'
            f"<SCRIPT type='a'>{body}</SCRIPT><script data-src='q'>{body}é</script>")
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = extract.inline_scripts(df, min_len=100).orderBy("idx").collect()
    assert [(r.idx, r.size_chars) for r in rows] == [(0, 101), (1, 102)]
    assert rows[0].url == "inline://script_0" and re.fullmatch(r"inline_0_[0-9a-f]{8}\.js", rows[0].name)


def test_assets_and_maps(spark):
    df = spark.createDataFrame([
        ("https://h/a.js", None, None), ("https://h/a.js?v=1", "x", 11 * 1024 * 1024),
        ("https://h/b", "Text/JavaScript; q", 10 * 1024 * 1024), ("https://h/c.css", "text/css", 1)],
        "url string, content_type string, content_length long")
    found = extract.script_assets(df)
    assert found.count() == 3 and extract.within_size(found, max_mb=10).count() == 2
    scripts = spark.createDataFrame([
        ("https://h/js/a.js", "x\n//# sourceMappingURL=a.js.map\n"),
        ("https://h/js/b.js", "//@ sourceMappingURL=data:xx"), ("https://h/js/c.js", "none")],
        "url string, text string")
    assert [r.map_url for r in extract.source_maps(scripts).collect()] == ["https://h/js/a.js.map"]


ESCAPES = [
    # (language, source, shape kind, URL), the URLs as they stand in the source
    ("python", r'urlpatterns = [re_path(r"^api/v1/users/(\d+)/$", view)]', "django_url",
     r"^api/v1/users/(\d+)/$"),
    ("python", r'requests.get("/api/it\"s")', "requests_call", r'/api/it\"s'),
    ("javascript", r'fetch("/api/a\/b");', "fetch", r"/api/a\/b"),
    ("javascript", r"axios.get('/api/c\'d\\');", "axios_method", r"/api/c\'d\\"),
    ("javascript", r"router.get('/api/:id(\d+)', h);", "express_route", r"/api/:id(\d+)"),
]


@pytest.mark.parametrize("language,text,kind,url", ESCAPES)
def test_escapes_are_kept(spark, language, text, kind, url):
    df = spark.createDataFrame([("f", text, language)], "file string, text string, language string")
    found = [r.url for r in extract.shaped_calls(df).collect()]
    assert url in found, found


def test_escapes_in_calls_and_literals(spark):
    text = (r'fetch("/api/a\/b"); axios.post("/api/it\"s"); request("/api/x\"" + TAIL + "/\d");'
            "\nconst TAIL = '/t';\nx = /\\//; y = '/api/after';")
    df = spark.createDataFrame([("f", text, "javascript")],
                               "file string, text string, language string")
    calls = {r.url for r in extract.call_endpoints(df).collect()}
    assert calls == {r"/api/a\/b", r'/api/it\"s'}
    literals = {r.url for r in extract.literal_endpoints(df).collect()}
    assert literals == {r"/api/a\/b", r'/api/it\"s', r'/api/x\"', "/api/after"}
    chain = resolve.resolve_concats(df).first()
    assert chain.url == r'/api/x\"/t/\d' and not chain.too_deep
    plain = spark.createDataFrame([("f", r"a(`/api/\${x}/${TAIL}\``); const TAIL = 't';")],
                                  "file string, text string")
    assert [r.resolved for r in resolve.resolve_templates(plain).collect()] == [r"/api/\${x}/t\`"]


def test_typescript_client(spark):
    rows = [(k, 'httpClient("/api/one");', k) for k in ("typescript", "javascript")]
    df = spark.createDataFrame(rows, "file string, text string, language string")
    assert [r.file for r in extract.call_endpoints(df).collect()] == ["typescript"]


@pytest.mark.parametrize("n", [14, 1000])
def test_long_chains_are_whole(spark, n):
    chain = " + ".join(f'"/api/p{i}"' if i % 2 else f"N{i}" for i in range(n))
    names = "\n".join(f"const N{i} = '/n{i}';" for i in range(0, n, 2))
    df = spark.createDataFrame([("f", f"{names}\nfetch({chain});", "javascript")],
                               "file string, text string, language string")
    row = resolve.resolve_concats(df).first()
    assert row.url == "".join(f"/api/p{i}" if i % 2 else f"/n{i}" for i in range(n))
    deep = resolve.resolve_concats(df, max_depth=10).first()
    assert deep.url is None and deep.too_deep


def test_markup_literals(spark):
    page = """<!-- "/api/no" --><a href="/api/v1/x" title='it "s'>t</a><b data-u='/graphql'></b>"""
    df = spark.createDataFrame([("f", page, "html")], "file string, text string, language string")
    assert {r.url for r in extract.literal_endpoints(df).collect()} == {"/api/v1/x", "/graphql"}


def config_rows(spark, text):
    rows = extract.config_calls(source(spark, text)).collect()
    return sorted((r.kind, r.ord, r.url) for r in rows)


@pytest.mark.parametrize("text,expected", [
    ('axios({ headers: { a: "b" }, method: "post", url: "/api/nested" })', [("axios_config", 0, "/api/nested")]),
    ('$.ajax({ data: { x: 1 }, url: "/api/jq" })', [("jquery_ajax", 0, "/api/jq")]),
    ("jQuery.ajax({url:'/a',x:{url:'/no'}});axios ( {url : '/b'} )",
     [("axios_config", 0, "/b"), ("jquery_ajax", 0, "/a")]),
    ('axios({ a: "}", b: \'{\', c: `}${x}`, // }\n /* { */ url: "/api/q" })', [("axios_config", 0, "/api/q")]),
    ('axios({ data: f({ url: "/no" }), list: [{ url: "/no" }] })', []),
    ('wrap({ url: "/no" }); axios(pick({ url: "/no" }), { url: "/second" })', [("axios_config", 0, "/second")]),
    ('axios({ then: () => { axios({ d: {}, url: "/in" }) }, url: "/out" })',
     [("axios_config", 0, "/in"), ("axios_config", 1, "/out")]),
    ('axios({ re: /["\'{]/, url: "/api/re" }); axios({ x: c ? url : "/no" })', [("axios_config", 0, "/api/re")]),
    ('// axios({ url: "/no" })\nmyaxios({ url: "/no" }); "axios({ url: 1"; axios({ baseurl: "/no" })', []),
    ('axios({ url: "/api/a\\"b" })', [("axios_config", 0, '/api/a\\"b')]), ("axios(", []), ("", []), ("})axios({url:'/x'})", [("axios_config", 0, "/x")]),
])
def test_config_objects(spark, text, expected):
    assert config_rows(spark, text) == expected


def test_config_objects_in_rows_of_one_file(spark):
    """Repeated rows of a file are texts of their own; null texts give nothing."""
    df = spark.createDataFrame([("a.js", 'axios({ x: {}, url: "/a" })')] * 2 + [("a.js", None), (None, "axios({url:'/n'})")],
                               "file string, text string").withColumn("language", F.lit("javascript"))
    assert sorted(((r.file, r.ord, r.url) for r in extract.config_calls(df).collect()), key=repr) == [
        ("a.js", 0, "/a"), ("a.js", 0, "/a"), (None, 0, "/n")]
    assert extract.config_calls(df.limit(0)).count() == 0


def test_minified_config_objects_are_linear(spark):
    """1 MB in one line: many calls, deep nesting, and unclosed brackets."""
    call = 'axios({headers:{a:{b:[1,{url:"/no"}]}},url:"/api/%d"}),'
    text = "".join(call % i for i in range(20_000)) + "[" * 100_000 + "axios(" * 10_000 + "{url:'/last'}" + "/*" * 100_000
    rows = config_rows(spark, text)
    assert len(rows) == 20_001 and rows[0][2] == "/api/0" and rows[-1] == ("axios_config", 20_000, "/last")
