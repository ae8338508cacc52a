import json

import pytest

from apiscope.operators import extract
from apiscope.plans import stages
from apiscope.sources import feeds, files, sinks, specs


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "a/app.js": b'fetch("/api/v1/x");', "a/b/page.TSX": b"ignored by name case",
        "a/b/c.py": b'requests.get("/api/v2/y") # \xff bad', "node_modules/m.js": b'"/api/no"',
        "a/readme.md": b"no", "big.ts": b"x" * 3000,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_source_tree(spark, tree):
    rows = files.read_source_tree(spark, str(tree)).collect()
    assert {(r.file.split("/")[-1], r.language) for r in rows} == {
        ("app.js", "javascript"), ("c.py", "python"), ("big.ts", "typescript")}
    assert "�" not in "".join(r.text for r in rows)
    assert files.read_source_tree(spark, str(tree), max_mb=0.001).count() == 2
    assert extract.literal_endpoints(files.read_source_tree(spark, str(tree))).count() == 2


def test_parse_corpus(spark, tree):
    got = stages.parse_corpus(files.read_source_tree(spark, str(tree)))
    assert {(r.url, r.match_kind) for r in got["endpoints"].collect()} == {
        ("/api/v1/x", "literal"), ("/api/v1/x", "call"), ("/api/v2/y", "literal"), ("/api/v2/y", "call")}
    assert got["files"].count() == 2


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("example.com\n\n# no\n  # kept\n https://x.org \n")
    rows = files.read_targets(spark, str(tmp_path / "t.txt")).collect()
    assert [(r.target, r.target_url) for r in rows] == [
        ("example.com", "https://example.com"), ("# kept", "https://# kept"),
        ("https://x.org", "https://x.org")]


def test_specs_yaml_and_json(spark, tmp_path):
    yaml_text = "swagger: '2.0'\nhost: h.org\nbasePath: /v1\npaths:\n  /a/{x}:\n    get:\n      tags: [t]\n"
    (tmp_path / "s.yaml").write_text(yaml_text)
    (tmp_path / "s.json").write_text(json.dumps(
        {"openapi": "3.1.0", "servers": [{"url": "https://s"}], "paths": {"/b": {"put": {"deprecated": True}}}}))
    (tmp_path / "bad.yml").write_text("a: [unclosed")
    (tmp_path / "other.json").write_text('{"x": 1}')
    docs = specs.spec_documents(specs.read_specs(spark, str(tmp_path)))
    rows = specs.spec_endpoints(docs).collect()
    assert {(r.path, r.method, r.deprecated, tuple(r.tags)) for r in rows} == {
        ("/v1/a/{x}", "GET", False, ("t",)), ("/b", "PUT", True, ())}
    urls = {r.spec_id.split("/")[-1]: r.u for r in docs.select(
        "spec_id", specs.base_url(docs.doc).alias("u")).collect()}
    assert urls["s.yaml"] == "https://h.org/v1" and urls["s.json"] == "https://s"
    assert docs.where("problem IS NOT NULL").count() == 2


def test_reports(spark, tmp_path):
    report = {"scan_id": "s", "target": "t", "endpoints": [
        {"url": "/a", "source": {"file": "f", "line": 1, "column": 2, "context": "c"}},
        {"url": "/b", "method": "PUT", "status": "dead"}],
        "secrets": [{"type": "k", "value": "v"}], "errors": ["e"]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    reports = feeds.read_reports(spark, str(tmp_path / "r.json"))
    rows = feeds.report_endpoints(reports).orderBy("ord").collect()
    assert [(r.url, r.method, r.status) for r in rows] == [("/a", "GET", "discovered"), ("/b", "PUT", "dead")]
    assert feeds.report_secrets(reports).first().severity == "high"
    flat = sinks.flat_endpoints(feeds.report_endpoints(reports))
    back = sinks.nested_endpoints(flat).orderBy("ord").collect()
    assert back[0].source.asDict() == report["endpoints"][0]["source"] and back[1].source is None


def test_findings(spark, tmp_path):
    lines = ['{"template-id":"t","info":{"name":"n","severity":"HIGH"},"extracted-results":["a"]}',
             "{broken", "", '{"info":{"severity":"info"}}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    rows = feeds.read_findings(spark, str(tmp_path / "f.jsonl")).collect()
    assert [(r.template_id, r.host, r.extracted_results) for r in rows] == [("t", "", ["a"])]
    assert feeds.read_findings(spark, str(tmp_path / "f.jsonl"), severities=None).count() == 2


def test_feeds(spark):
    index = spark.createDataFrame([('[["h1","h2","h3","h4"],["20240101120000","u","m","200"],["x"]]',)],
                                  "json string")
    rows = feeds.captures(index).collect()
    assert [(r.timestamp, r.original_url, r.status_code) for r in rows] == [("20240101120000", "u", 200)]
    certs = spark.createDataFrame([("d", '[{"name_value":"a\\nb"},{"name_value":"c"}]')],
                                  "domain string, json string")
    assert [r.name_value for r in feeds.certificate_names(certs).collect()] == ["a", "b", "c"]


def test_rerun_replaces_only_its_scans(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_scan_table(spark.createDataFrame([("a", 1), ("b", 2)], "scan_id string, n int"), out)
    sinks.write_scan_table(spark.createDataFrame([("b", 3)], "scan_id string, n int"), out)
    rows = sinks.read_scan_table(spark, out).collect()
    assert {(r.scan_id, r.n) for r in rows} == {("a", 1), ("b", 3)}
    hosts = str(tmp_path / "h")
    sinks.write_host_list(spark.createDataFrame([("b",), ("a",), ("b",)], "host string"), hosts)
    assert [r.value for r in spark.read.text(hosts).collect()] == ["a", "b"]
