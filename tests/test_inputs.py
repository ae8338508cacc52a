"""Derived tables hold all of the given ones."""

import duckdb
import pytest

from apiscope.queries import catalog, stream_queries


@pytest.mark.parametrize("page_id", [6, 7])
def test_page_bodies_are_searched(spark, tmp_path, page_id):
    """A literal deep in the body of any page, and the lines after it."""
    html = "<html><head></head><body>\n<p>x</p>\n" * 50 + '<a href="/api/v1/deep">d</a></body></html>'
    spark.createDataFrame([(page_id, "https://www.example.com/en/p12.html", html)],
                          "page_id long, url string, html string").coalesce(1).write.parquet(
        str(tmp_path / "pages.parquet"))
    names = ["file", "url", "line", "column", "context"]
    got = catalog.QUERIES["C1_page_literals"](spark, str(tmp_path)).select(names).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} "
                       f"FROM ({catalog.ORACLE['C1_page_literals']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert "/api/v1/deep" in {r.url for r in got}


def test_rows_without_an_order_key_reach_the_stream(spark, tmp_path):
    rows = [(i if i % 5 else None, f"t{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    path, _ = stream_queries.split(spark, str(tmp_path), "documents", "CAST(doc_id AS DOUBLE)")
    got = spark.read.parquet(path).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
