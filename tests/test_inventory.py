import json

from pyspark.sql import functions as F

from apiscope.operators import inventory, report, responses
from apiscope.sources import sinks, specs

SPEC = {"openapi": "3.0.3", "paths": {
    "/api/v1/users": {"get": {"summary": "List"}, "post": {}, "x-note": "n"},
    "/api/v1/products": {"get": {}}, "/note": "text",
    "/api/v0/legacy/auth": {"post": {"deprecated": True, "tags": ["old"]}}}}


def endpoints(spark):
    rows = [(0, "/api/v1/users", "GET"), (1, "/api/v1/users", "POST"),
            (2, "/api/admin/dashboard", "GET"), (3, "/api/v0/legacy/auth/", "POST"),
            (4, "/api/v1/users", "GET")]
    return spark.createDataFrame(rows, "ord long, url string, method string").withColumn(
        "status", F.lit("discovered"))


def spec(spark):
    docs = spark.createDataFrame([("s", "json", json.dumps(SPEC))],
                                 "spec_id string, format string, text string")
    return specs.spec_endpoints(specs.spec_documents(docs))


def test_audit(spark):
    rows = inventory.audit(endpoints(spark), spec(spark)).collect()
    assert {r.ord: r.category for r in rows} == {
        0: "documented", 1: "documented", 2: "shadow", 3: "zombie", 4: "documented"}
    assert [(r.method, r.path) for r in inventory.ghosts(endpoints(spark), spec(spark)).collect()] \
        == [("GET", "/api/v1/products")]
    summary = inventory.audit_summary(inventory.audit_rows(endpoints(spark), spec(spark)))
    assert {r.category: r.n for r in summary.collect()} == {
        "documented": 3, "shadow": 1, "ghost": 1, "zombie": 1}
    empty = inventory.audit_rows(endpoints(spark).limit(0), spec(spark).limit(0))
    assert {r.n for r in inventory.audit_summary(empty).collect()} == {0}


def test_absolute_urls_need_strip_host(spark):
    inv = spark.createDataFrame([(0, "https://h/api/v1/users", "GET")],
                                "ord long, url string, method string")
    assert inventory.audit(inv, spec(spark)).first().category == "shadow"
    assert inventory.audit(inv, spec(spark), strip_host=True).first().category == "documented"


def test_last_spec_row_wins(spark):
    rows = [(0, "/a/{x}", "GET", True), (1, "/a/{y}", "GET", False)]
    s = spark.createDataFrame(rows, "ord long, path string, method string, deprecated boolean")
    inv = spark.createDataFrame([(0, "/a/:id", "GET")], "ord long, url string, method string")
    assert inventory.audit(inv, s).first().category == "documented"


def test_shadow_override(spark):
    inv = endpoints(spark)
    got = inventory.mark_shadow(inv, inventory.audit(inv, spec(spark))).collect()
    assert {r.ord for r in got if r.status == "shadow"} == {2} and len(got) == 5


def test_first_signature_wins(spark):
    rows = inventory.distinct_endpoints(endpoints(spark)).collect()
    assert {(r.signature, r.ord) for r in rows} >= {("GET:/api/v1/users", 0)} and len(rows) == 4


SCAN = "ord long, url string, method string, status string, http_status int, deprecated boolean"


def test_scan_comparison(spark):
    a = spark.createDataFrame([(0, "/a", "GET", "x", 200, None), (1, "/b", None, "x", None, None),
                               (2, "/c", "GET", "x", 200, None), (3, "/c", "GET", "y", 200, None)], SCAN)
    b = spark.createDataFrame([(0, "/a", "GET", "x", 200, None), (1, "/c", "GET", "x", 200, None),
                               (2, "/d", "PUT", "x", 200, None)], SCAN)
    def kinds(x, y):
        return {r.signature: r.change_type for r in inventory.compare_scans(x, y).collect()}

    assert kinds(a, b) == {"GET:/a": "unchanged", "GET:/b": "removed", "GET:/c": "changed",
                           "PUT:/d": "added"}
    assert set(kinds(a, a).values()) == {"unchanged"}
    swapped = {"added": "removed", "removed": "added"}
    assert kinds(b, a) == {k: swapped.get(v, v) for k, v in kinds(a, b).items()}


def test_digest_and_preview(spark):
    a = spark.createDataFrame([], SCAN)
    b = spark.range(25).select(
        F.col("id").alias("ord"), F.concat(F.lit("/"), F.lpad(F.col("id").cast("string"), 3, "0"))
        .alias("url"), F.lit("GET").alias("method"), F.lit("x").alias("status"),
        F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("boolean").alias("deprecated"))
    rows = inventory.diff_digest(inventory.compare_scans(a, b)).orderBy("rank").collect()
    assert [r.signature for r in rows] == [f"GET:/{i:03d}" for i in range(10)]
    assert {r.remaining for r in rows} == {15}
    shown = inventory.preview(b).collect()
    assert len(shown) == 10 and {r.remaining for r in shown} == {15}


def test_secret_delta(spark):
    one, three = spark.range(1), spark.range(3)
    assert tuple(inventory.secret_delta(one, three).first()) == (2, 0)
    assert tuple(inventory.secret_delta(three, one).first()) == (0, 2)
    assert tuple(inventory.secret_delta(one.limit(0), one.limit(0)).first()) == (0, 0)


def test_version_siblings(spark):
    inv = spark.createDataFrame([("/api/v2/a/v2/b",), ("/plain",)], "url string")
    rows = inventory.version_siblings(inv, max_version=3).collect()
    assert sorted(r.url for r in rows) == ["/api/v1/a/v1/b", "/api/v2/a/v2/b", "/api/v3/a/v3/b", "/plain"]
    assert sum(r.is_variant for r in rows) == 2


def test_capture_selection(spark):
    rows = [("20240101000000", "https://www.h/a.js", "m", 200), ("20230601000000", "http://h/a.js", "m", 200),
            ("20240101000000", "https://h/b.js", "m", 404), ("20200101000000", "https://h/c.js", "m", 200)]
    df = spark.createDataFrame(rows, "timestamp string, original_url string, mime_type string, status_code int")
    got = inventory.select_captures(df, F.lit("2024-06-01").cast("date")).collect()
    assert [(r.url_key, r.timestamp) for r in got] == [("h/a.js", "20230601000000")]


def test_all_captures_unless_limited_per_domain(spark):
    rows = [("20240101000000", f"https://d{d}/{i:04}.js", "m", 200, f"d{d}")
            for d in range(3) for i in range(700)]
    df = spark.createDataFrame(rows, "timestamp string, original_url string, mime_type string, "
                                     "status_code int, host string")
    day = F.lit("2024-06-01").cast("date")
    assert inventory.select_captures(df, day).count() == 2100
    few = inventory.select_captures(df, day, per_domain=5).collect()
    assert sorted(r.url_key for r in few) == [f"d{d}/{i:04}.js" for d in range(3) for i in range(5)]


def full(spark):
    rows = [(0, "/api/v1/users/{id}", "GET", "shadow", ("a.js", 3), 7, 200, ["q"], "s1"),
            (1, "/api/v1/users/:uid", "POST", "zombie", ("b'\"\n.js", 4), 1, None, None, "s1"),
            (2, "/api/v1/users/{id}", "GET", "documented", ("c.js", 5), 2, None, [], "s2"),
            (3, "/x", "PUT", "unprotected", None, 0, 0, None, "s2")]
    return spark.createDataFrame(
        rows, "ord long, url string, method string, status string, source struct<file:string,line:int>, "
        "column int, http_status int, query_params array<string>, scan_id string")


def test_openapi_document(spark, tmp_path):
    ops = report.openapi_operations(full(spark))
    items = report.path_items(report.operation_json(ops))
    schemas = report.schema_components(full(spark).withColumn("body_schema", F.lit('{"type":"object"}')))
    lines = report.openapi_lines(items, server_url="https://h", components=schemas)
    out = str(tmp_path / "doc")
    sinks.write_document(lines, out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert doc["openapi"] == "3.0.3" and doc["servers"] == [{"url": "https://h"}]
    assert set(doc["paths"]) == {"/api/v1/users/{id}", "/api/v1/users/{uid}", "/x"}
    get = doc["paths"]["/api/v1/users/{id}"]["get"]
    assert get["x-discovered-in"] == "c.js" and get["security"] == [{}]
    assert [p["name"] for p in get["parameters"]] == ["id"] and "requestBody" not in get
    assert "requestBody" in doc["paths"]["/api/v1/users/{uid}"]["post"]
    assert doc["components"]["schemas"] == {"Users": {"type": "object"}, "X": {"type": "object"}}


def test_sarif_document(spark, tmp_path):
    inv = full(spark).select("*", "source.file", "source.line").drop("ord")
    secret_rows = spark.createDataFrame([("s1", "k", "low", "z.js", 1, 2)] * 2,
                                        "scan_id string, type string, severity string, "
                                        "file string, line int, column int")
    scans = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 0)], "scan_id string, errors int") \
        .withColumn("started_at", F.lit("2024-01-01").cast("timestamp")) \
        .withColumn("completed_at", F.lit("2024-01-01 01:00:00").cast("timestamp"))
    out = str(tmp_path / "sarif")
    sinks.write_document(report.sarif_document(scans, inv, secret_rows), out, scan="scan_id")
    docs = {}
    for scan in ("s1", "s2", "s3"):
        parts = sorted((tmp_path / "sarif" / f"scan_id={scan}").glob("part-*"))
        docs[scan] = json.loads("".join(p.read_text() for p in parts))
    run = docs["s1"]["runs"][0]
    assert docs["s1"]["version"] == "2.1.0" and "$schema" in docs["s1"]
    assert [r["ruleId"] for r in run["results"]] == ["SHADOW-API-001", "SHADOW-API-002", "SHADOW-API-004"]
    assert [r["level"] for r in run["results"]] == ["warning", "error", "note"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {
        "startLine": 3, "startColumn": 7}
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} >= {"SHADOW-API-001", "SHADOW-API-005"}
    assert run["invocations"][0]["executionSuccessful"] is True
    assert docs["s2"]["runs"][0]["invocations"][0]["executionSuccessful"] is False
    assert docs["s2"]["runs"][0]["results"][0]["locations"] == []
    assert docs["s3"]["runs"][0]["results"] == []


def test_report_tables(spark):
    rows = report.endpoint_table(full(spark)).collect()
    assert [r.http_code for r in rows] == ["200", "-", "-", "-"]
    results = spark.createDataFrame([("a", "success", 2, 1, 1.5), ("b", "failed", 0, 0, 0.5)],
                                    "target string, status string, endpoints_found int, "
                                    "secrets_found int, duration_seconds double")
    total = report.target_rollup(results).where("is_total = 1").first()
    assert (total.targets, total.successful, total.failed, total.endpoints, total.duration) == (2, 1, 1, 2, 2.0)


def test_graphql_candidates(spark):
    bases = spark.createDataFrame([("https://h/",)], "base_url string")
    rows = responses.graphql_candidates(bases, ("/graphql", "/gql")).collect()
    assert [r.candidate for r in rows] == ["https://h/graphql", "https://h/gql"]
