import datetime as dt

import pytest
from pyspark.sql import functions as F

from apiscope.functions import responses as r
from apiscope.operators import responses as ops
from apiscope.sources import feeds

SCHEMA = "ord long, status_code int, headers map<string,string>, body string"


def log(spark, *rows):
    raw = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)
    return ops.classify_responses(feeds.response_log(raw)).orderBy("ord").collect()


def test_categories(spark):
    codes = {200: "active", 201: "active", 204: "active", 301: "redirect", 302: "redirect",
             400: "active", 401: "protected", 403: "protected", 404: "dead", 405: "active",
             429: "protected", 500: "error", 503: "error", 418: "unknown", 307: "unknown"}
    rows = log(spark, *[(c, {}, "") for c in codes])
    assert [x.category for x in rows] == list(codes.values())
    assert {x.confidence for x in rows} == {1.0}
    assert rows[6].notes == ["Requires authentication"] and rows[12].notes == ["Server error (503)"]


@pytest.mark.parametrize("body", [
    'x\nTraceback (most recent call last):\n File "app.py", line 42', "at com.Main.run(Main.java:1)",
    'FILE "x.py", LINE 3', "#0 call\n   at x", "goroutine 12 [running]:", "panic: oops",
    "Exception in thread main", "System.NullException: x"])
def test_stack_traces(spark, body):
    row = log(spark, (500, {}, body))[0]
    assert row.category == "vulnerable" and row.has_stack_trace
    assert "Exposes stack trace" in row.notes


def test_body_is_read_whole_unless_limited(spark):
    body = "x" * 20000 + "panic: late"
    df = spark.createDataFrame([(body,)], "b string")
    row = df.select(r.has_stack_trace("b").alias("a"), r.has_stack_trace("b", 10000).alias("c")).first()
    assert (row.a, row.c) == (True, False)


def test_flags(spark):
    rows = log(
        spark,
        (200, {"Content-Type": "Application/JSON", "Access-Control-Allow-Origin": "*"}, "{}"),
        (200, {"content-type": "text/xml"}, "MySQL: some ERROR"),
        (200, {"content-type": "text/xml, application/json"}, "undefined is not a function"))
    assert rows[0].is_json_api and rows[0].has_cors_issue and not rows[0].is_legacy
    assert rows[1].is_legacy and "Contains sensitive error message" in rows[1].notes
    assert not rows[2].is_legacy and "Contains sensitive error message" in rows[2].notes


@pytest.mark.parametrize("headers,want", [
    ({"Deprecation": "2024-01-15"}, True), ({"sunset": "x"}, True), ({"X-Deprecated": "true"}, True),
    ({"Link": '<x>; rel="sunset"'}, True), ({"Link": '<x>; rel="next"'}, False),
    ({"Warning": "299 - Deprecated"}, True), ({"Warning": "199"}, False), ({}, False)])
def test_deprecation(spark, headers, want):
    assert log(spark, (200, headers, ""))[0].is_deprecated is want


@pytest.mark.parametrize("text,want", [
    ("2024-01-15", (2024, 1, 15)), ("2024-01-15T10:00:00Z", (2024, 1, 15, 10)),
    ("2024-01-15T10:00:00+0200", (2024, 1, 15, 8)), ("2024-01-15T10:00:00+02:00", (2024, 1, 15, 8)),
    ("Wed, 21 Oct 2015 07:28:00 GMT", (2015, 10, 21, 7, 28)), ("true", None), ("junk", None),
    ("2024-13-45", None), ("", None)])
def test_header_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(
        F.unix_seconds(r.http_date("x")).alias("y")).first().y
    assert got == (want and int(dt.datetime(*want, tzinfo=dt.timezone.utc).timestamp()))


def test_age_indicators(spark):
    df = spark.createDataFrame([
        ({"server": "Apache/1.3.42"}, "This API is deprecated. Please use v2 instead."),
        ({"server": "x PHP/5.4"}, "Copyright © 2019 X, copyright 2001"),
        ({"server": "nginx/1.2"}, "copyright (c) 2024")], "h map<string,string>, b string")
    rows = [x.y for x in df.select(r.age_indicators("h", "b", 2025).alias("y")).collect()]
    assert rows == [["Body contains: 'deprecated'", "Old server version: Apache 1.x"],
                    ["Old copyright year: 2019", "Old server version: PHP 5.0-5.4"], []]


def test_graphql_response(spark):
    df = spark.createDataFrame([(200, '{"data":null}'), (200, '{"errors":[]}'), (200, "[1]"),
                                (400, '{"data":1}'), (200, "no"), (200, None)], "s int, b string")
    assert [x.y for x in df.select(r.is_graphql_response("s", "b").alias("y")).collect()] \
        == [True, True, False, False, False, False]


def test_graphql_operations(spark):
    doc = ('{"queryType":{"name":"Q"},"types":[{"name":"Q","fields":[{"name":"user","args":'
           '[{"name":"id","type":{"name":"ID"}}],"type":{"name":"User"}}]},{"name":"Mutation",'
           '"fields":[{"name":"save","args":null,"type":{"name":null}}]},{"name":"X","fields":null}]}')
    rows = ops.graphql_operations(spark.createDataFrame([("u", doc)], "url string, schema_json string"))
    assert {(x.type, x.name, len(x.args), x.return_type) for x in rows.collect()} == {
        ("query", "user", 1, "User"), ("mutation", "save", 0, None)}


def test_differences(spark):
    schema = "ord long, endpoint string, status_code int, length long"
    base = spark.createDataFrame([(0, "a", 200, 100), (1, "b", 200, 0), (2, "a", 500, 1)], schema)
    variants = spark.createDataFrame([(0, "a", 403, 100), (1, "a", 200, 104), (2, "a", 200, 110),
                                      (3, "b", 200, 10), (4, "c", 1, 1)], schema)
    rows = ops.response_differences(base, variants).orderBy("ord").collect()
    assert [(x.ord, x.description) for x in rows] == [
        (0, "Status code changed: 200 -> 403"), (2, "Response size changed significantly (10%)")]


def test_reflection(spark):
    df = spark.createDataFrame([(200, '{"Role": "ADMIN", "isAdmin": true}'), (403, "role admin")],
                               "status_code int, body string")
    assert sorted(x.parameter for x in ops.reflected(df).collect()) == ["isAdmin", "role"]


def test_status_transitions(spark):
    inv = spark.createDataFrame([("GET", f"/{i}", "discovered", None) for i in range(7)],
                                "method string, url string, status string, http_status int")
    probes = spark.createDataFrame([
        (0, "GET", "/0", True, 200, False), (1, "GET", "/1", True, 401, False),
        (2, "GET", "/2", True, 404, False), (3, "GET", "/3", True, 500, True),
        (4, "GET", "/4", False, None, False), (5, "GET", "/5", True, 500, False),
        (6, "GET", "/5", True, 204, False)],
        "ord long, method string, url string, success boolean, http_status int, "
        "has_deprecation_header boolean")
    got = {x.url: (x.status, x.http_status) for x in ops.update_status(inv, probes).collect()}
    assert got == {"/0": ("verified", 200), "/1": ("protected", 401), "/2": ("discovered", 404),
                   "/3": ("zombie", 500), "/4": ("dead", None), "/5": ("verified", 204),
                   "/6": ("discovered", None)}
    s = ops.response_summary(probes).first()
    assert (s.probed, s.active, s.protected, s.dead, s.zombies) == (7, 2, 1, 2, 1)
    assert ops.active_urls(probes).count() == 2
