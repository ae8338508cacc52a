"""What the physical plans must and must not contain."""

import re

import pytest

from apiscope.queries import catalog
from apiscope.sources.files import read_source_tree, work_path

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith(("G", "A10", "A11"))))
def test_no_cross_product_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"MapInPandas|MapInArrow|EvalPython|InPandas", text)


def test_scan_reads_only_what_is_used(spark):
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(
        catalog.QUERIES["B1_url_validation"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan(
        catalog.QUERIES["G4_tumbling_counts"](spark, SF))


def test_distinct_is_a_partial_aggregate_not_a_window(spark):
    text = plan(catalog.QUERIES["F1_distinct_signature"](spark, SF))
    assert "Window" not in text and "partial_min_by" in text


def test_digest_cuts_groups_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["F7_diff_digest"](spark, SF))
    assert "WindowGroupLimit" in text


def test_row_wise_queries_do_not_shuffle(spark):
    for name in ("B1_url_validation", "B2_scope_filter", "B7_resolve_reference", "B11_signature",
                 "E15_triage", "F27_active_urls"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF)), name


def test_skipped_folders_are_not_read(spark, tmp_path):
    """Names are tested on file metadata, below the scan's content."""
    for folder in ("app", "app/node_modules/lib"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.js").write_text("fetch('/api/x')")
    df = read_source_tree(spark, str(tmp_path))
    assert [r.file.endswith("/app/a.js") for r in df.collect()] == [True]
    text = plan(df)
    assert re.search(r"PartitionFilters: \[[^\n]*node_modules|metadata[^\n]*file_path", text)


def test_selected_captures_have_no_limit(spark):
    assert "Limit" not in plan(catalog.QUERIES["F10_capture_selection"](spark, SF))


def test_work_folders_need_a_shared_root(spark, monkeypatch):
    class Elsewhere:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        work_path(Elsewhere, "x")
