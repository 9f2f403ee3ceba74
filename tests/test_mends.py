"""Cases that once gave wrong results."""

import json

import pytest
from pyspark.sql import functions as F

from linkatlas.functions.html import size_gated
from linkatlas.functions.sql import register_python_functions
from linkatlas.functions.text import path_name
from linkatlas.operators.ledger import _json_scalar, append_records, latest_state, remove_records
from linkatlas.operators.render import document_paths
from linkatlas.operators.skew import salted_join
from linkatlas.operators.tree import child_key
from linkatlas.plans import catalog


def test_large_ordinals_stay_apart(spark):
    rows = spark.createDataFrame([(1_000_000_000,), (1_000_000_007,), (9_223_372_036_854_775_807,)], "n bigint")
    assert rows.select(child_key(F.lit("R"), F.lit("folder"), F.col("n")).alias("k")).distinct().count() == 3


def test_document_paths_are_unique(spark):
    marks = [("x1", f"R/b{i}", t, ["Root"]) for i, t in enumerate(["A", "A", "A_2", "..", "A", "L" * 300, "L" * 300])]
    found = [r.path for r in document_paths(spark.createDataFrame(marks, "export_id string, node_key string, title string, folder_path array<string>"), "/out").collect()]
    assert len(set(found)) == len(found) and all(len(p) <= 250 and "/../" not in p and p.startswith("/out/x1/Root/") for p in found)


def test_dots_are_no_names(spark):
    named = spark.createDataFrame([("..",), (".",), (" .. ",)], "n string").select(path_name(F.col("n"), F.lit("/out")).alias("p")).collect()
    assert all(r.p.startswith("item_") for r in named)


def test_numbers_are_spelled_as_json(spark):
    values = [0.0, 0.1, 0.5, 1.0, 0.001, 0.0001, 1e-5, 1.25e-7, 123456789.5, 1e7, 1e15, 1e16, 1.5e300, -0.00025, -2e20, 12345678.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", _json_scalar(F.col("v"), "number").alias("s")).collect()
    assert all(r.s == json.dumps(r.v) for r in got), [(r.s, json.dumps(r.v)) for r in got]


def test_page_text_in_sql_has_a_cap(spark):
    register_python_functions(spark)
    pages = spark.createDataFrame([("<p>" + "é" * 3_000_000 + "</p>",), (None,), ("<p> a  b </p>",)], "html string")
    got = [r.t for r in pages.selectExpr("extract_text(html) AS t").collect()]
    assert len(got[0].encode()) == 5 * 1024 * 1024 and got[2] == "a b"


def test_salt_follows_the_count(spark):
    left = spark.range(5000).selectExpr("IF(id % 3 = 0, id, 7) AS k", "id")
    right = spark.createDataFrame([(7, "x"), (9, "y")], "k bigint, v string")
    assert salted_join(left, right, ["k"], "inner", ["id"], hot_rows=100).count() == left.join(right, "k").count()


@pytest.mark.parametrize("name", ["t6_folder_paths", "u5_safe_path", "u6_relative_path", "u7_dry_run", "u7_dry_run_resume", "l3_skip_done", "l4_retry_errors",
                                  "l6_plan_normal", "l6_plan_resume", "l7_resume_cursor", "l11_plan_statistics", "l11_run_statistics"])
def test_markup_is_not_scanned(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "html" not in plan


def test_removed_link_returns(spark):
    shape = "run_id string, url string, ts timestamp_ntz, outcome string, error string"
    def record(run, day, outcome):
        return spark.sql(f"SELECT '{run}' AS run_id, 'u' AS url, timestamp_ntz'2024-01-0{day}' AS ts, '{outcome}' AS outcome, NULL AS error").to(
            spark.createDataFrame([], shape).schema)
    gone = remove_records(record("1", 1, "failed"), record("1", 1, "failed"), F.lit("2024-01-02"))
    assert latest_state(gone).count() == 0
    assert [r["run_id"] for r in latest_state(append_records(gone, record("2", 3, "processed"))).collect()] == ["2"]


def test_large_pages_are_turned_away(spark):
    pages = spark.createDataFrame([("a", "<p>" + "x" * 40 + "</p>"), ("b", "<p>y</p>"), ("c", None)], "url string, html string")
    got = {r["url"]: r["html"] for r in size_gated(pages, limit_mb=20 / 1024 / 1024).collect()}
    assert got == {"a": None, "b": "<p>y</p>", "c": None}
