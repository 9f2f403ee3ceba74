"""Fetch log, redirects, throttle, ledger and documents on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from linkatlas.operators import fetchlog as L
from linkatlas.operators import ledger as G
from linkatlas.operators import render as R
from linkatlas.operators import summary as S


def test_outcome_classes(spark):
    mb = 1024 * 1024
    rows = [(200, None, 5 * mb), (200, None, 5 * mb + 1), (404, None, 0), (410, None, 0), (301, "x", 0), (302, "", 0), (303, "x", 0), (500, None, 0), (None, None, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, location string, bytes long")
    cls = lambda **k: [r[0] for r in df.orderBy("i").select(L.outcome_class(F.col("status"), F.col("location"), F.col("bytes"), **k)).collect()]
    assert cls() == ["ok", "too_large", "gone", "gone", "redirect", "redirect_without_target", "retry", "retry", "retry"]
    assert cls(in_chain=True)[5] == "retry"


def test_redirect_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", None), ("s", "s"), ("u", "gone")], "src string, dst string")
    got = {r["src"]: (r["final"], r["hops"], r["resolved"]) for r in L.resolve_redirects(edges, 2).collect()}
    assert got == {"a": (None, 2, False), "b": ("d", 2, True), "c": ("d", 1, True), "d": ("d", 0, True), "s": (None, 2, False), "u": ("gone", 1, True)}


def test_backoff(spark):
    df = spark.createDataFrame([(0,)], "us long")
    rows = L.backoff_schedule(df).orderBy("retry").collect()
    assert [(r["wait"], r["earliest_us"]) for r in rows] == [(1.5, 1_500_000), (3.0, 4_500_000), (6.0, 10_500_000)]


def waits(times, quota, span):
    out = []
    for t in times:
        out.append(t if len(out) < quota else max(t, out[-quota] + span))
    return out


@pytest.mark.parametrize("quota", [1, 3, 4])
def test_admissions_match_the_rule(spark, quota):
    rng = random.Random(quota)
    rows, want = [], {}
    for key, n in (("hot", 300), ("cold", 12), ("one", 1)):
        times = sorted(rng.randrange(0, 20 * n) * 1_000_000 for _ in range(n))
        rows += [(key, t, f"{key}{i:04d}") for i, t in enumerate(times)]
        want.update({f"{key}{i:04d}": a for i, a in enumerate(waits(times, quota, 60_000_000))})
    df = spark.createDataFrame(rows, "key string, us long, tie string")
    assert {r["tie"]: r["admitted_us"] for r in L.admissions(df, "key", "us", "tie", quota).collect()} == want


def test_admission_examples(spark):
    df = spark.createDataFrame([("k", t * 1_000_000, t) for t in (0, 1, 2, 3, 4, 200, 201)], "key string, us long, tie long")
    got = [r["admitted_us"] // 1_000_000 for r in L.admissions(df, "key", "us", "tie", 3).orderBy("tie").collect()]
    assert got == [0, 1, 2, 60, 61, 200, 201]
    assert [r["admitted_us"] for r in L.admissions(df, "key", "us", "tie", 0).collect()] == [r["us"] for r in df.collect()]


def test_trailing_load_is_strict(spark):
    df = spark.createDataFrame([("k", s * 1_000_000) for s in (0, 0, 59, 60, 61, 119)], "key string, us long")
    got = {r["us"] // 1_000_000: (r["load"], r["over_quota"]) for r in L.trailing_load(df, "key", "us").collect()}
    assert got == {0: (2, False), 59: (3, False), 60: (2, False), 61: (3, False), 119: (3, False)}


def test_bursts(spark):
    df = spark.createDataFrame([("k", s * 1_000_000) for s in (0, 100, 650, 1250, 1849, 5000)], "key string, us long")
    got = sorted((r["start_us"] // 1_000_000, r["end_us"] // 1_000_000, r["requests"]) for r in L.bursts(df, "key", "us").collect())
    assert got == [(0, 650, 3), (1250, 1849, 2), (5000, 5000, 1)]


LEDGER = "run_id string, url string, title string, ts timestamp_ntz, outcome string, error string"


def ledger(spark, *rows):
    return spark.createDataFrame([("r", u, u, None, o, e) for u, o, e in rows], LEDGER).withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,monotonically_increasing_id())"))


def test_done_and_failed_sets(spark):
    rows = ledger(spark, ("s", "processed", None), ("e", "processed", "x"), ("f", "failed", "y"))
    urls = lambda df: sorted(r["url"] for r in df.collect())
    assert urls(G.done_urls(rows)) == ["s"]
    assert urls(G.failed_urls(rows)) == ["e", "f"]
    assert urls(G.failed_urls(rows, with_processed_errors=False)) == ["f"]


MODES = {
    ("normal", False): ("process", "skip_done", "process", "skip_failed"),
    ("resume", False): ("process", "skip_done", "process", "process"),
    ("check_error", False): ("skip_not_error", "skip_not_error", "process", "process"),
    ("normal", True): ("process", "skip_done", "process", "skip_failed"),
    ("resume", True): ("process", "skip_done", "process", "skip_failed"),
    ("check_error", True): ("skip_not_error", "skip_not_error", "process", "process"),
}


@pytest.mark.parametrize("mode,dry", MODES)
def test_mode_table(spark, mode, dry):
    rows = ledger(spark, ("s", "processed", None), ("e", "processed", "x"), ("f", "failed", "y"))
    marks = spark.createDataFrame([("x", u, u, ["Root"], i) for i, u in enumerate(("new", "s", "e", "f"))], "export_id string, node_key string, url string, folder_path array<string>, ordinal int")
    plan = {r["url"]: r["decision"] for r in G.plan_run(marks, rows, mode, dry).collect()}
    assert tuple(plan[u] for u in ("new", "s", "e", "f")) == MODES[mode, dry]


def test_cursor(spark):
    marks = spark.createDataFrame([("x", str(i), "u", p, i) for p in (["Root", "A"], ["Root", "B", "A"]) for i in range(3)], "export_id string, node_key string, url string, folder_path array<string>, ordinal int")
    count = lambda c, **k: marks.filter(G.before_cursor(F.col("folder_path"), F.col("ordinal"), c, **k)).count()
    assert count((["Root", "A"], 2)) == 2
    assert count((["A"], 2)) == 0
    assert count((["A"], 2), suffix=True) == 4


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        G.plan_run(ledger(spark), ledger(spark), "turbo")


def test_repair_and_removal(spark):
    rows = ledger(spark, ("f", "failed", "y"), ("s", "processed", None))
    fixed = ledger(spark, ("f", "processed", None), ("n", "processed", None)).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    now = {r["url"]: (r["outcome"], r["error"]) for r in G.resolve_failures(rows, fixed).collect()}
    assert now == {"f": ("processed", None), "s": ("processed", None), "n": ("processed", None)}
    gone = G.latest_state(G.remove_records(rows, rows.filter("url = 'f'"), F.lit("9999-01-01 00:00:00")))
    assert [r["url"] for r in gone.collect()] == ["s"]


def test_progress_numbers(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 10, 5.0), (2, 10, 4.0)], "done int, total int, elapsed double")
    got = df.select(G.percentage(F.col("done"), F.col("total")), G.remaining_seconds(F.col("done"), F.col("total"), F.col("elapsed"))).collect()
    assert [tuple(r) for r in got] == [(100.0, None), (0.0, None), (20.0, 16.0)]


def test_settings_hash_is_the_sorted_json(spark):
    import hashlib
    import json

    want = {"llm_model": 'мод "x" 😀', "llm_max_tokens": 1000, "llm_temperature": 0.7, "output_dir": "./out", "markdown_include_metadata": True, "generate_mermaid_diagram": False}
    got = spark.range(1).select(G.settings_hash(
        F.lit(want["llm_model"]), F.lit(1000), F.lit(0.7), F.lit("./out"), F.lit(True), F.lit(False)).alias("h")).first()["h"]
    assert got == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()


def test_prompt_keeps_braces(spark):
    df = spark.createDataFrame([("{content}", "x" * 10)], "t string, c string")
    got = df.select(S.prompt("{{a}} {title}: {content}", 2, title=F.col("t"), content=F.col("c"))).first()[0]
    assert got == "{a} {content}: xxxxxx"


def test_replies(spark):
    bodies = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[{"message":{"content":null}}]}', '{"error":{"message":"bad","type":"t","code":"c"}}', "<html>", '{"choices":[]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [(r["summary_status"], r["summary"]) for r in S.parse_replies(df).orderBy("i").collect()]
    assert got == [("ok", "hi"), ("empty", S.EMPTY_SUMMARY), ("error", S.FAILED_SUMMARY + "bad"), ("error", S.FAILED_SUMMARY + "no choices in reply"), ("error", S.FAILED_SUMMARY + "no choices in reply")]


def test_markdown(spark):
    df = spark.sql("SELECT 'http://u' url, 'T: \"q\"' title, '' summary, timestamp_ntz'2024-01-02 03:04:05' ts")
    front = R.front_matter(F.col("url"), F.col("title"), F.col("ts"), F.lit("success"))
    plain, full = df.select(R.markdown(F.col("url"), F.col("title"), F.col("summary")), R.markdown(F.col("url"), F.col("title"), F.lit("S"), front)).first()
    assert plain == '# T: "q"\n\n---\nИсточник: http://u'
    assert full == '---\ndate_processed: "2024-01-02T03:04:05"\nstatus: "success"\ntitle: "T: \\"q\\""\nurl: "http://u"\n---\n\n# T: "q"\n\nS\n\n---\nИсточник: http://u'


def test_colliding_documents(spark):
    marks = spark.createDataFrame([("x", f"k{i}", t, ["Root"]) for i, t in enumerate(["Same", "Same", "Other", "Same"])], "export_id string, node_key string, title string, folder_path array<string>")
    got = {r["node_key"]: r["path"] for r in R.document_paths(marks, "/o").collect()}
    assert got == {"k0": "/o/x/Root/Same.md", "k1": "/o/x/Root/Same_2.md", "k2": "/o/x/Root/Other.md", "k3": "/o/x/Root/Same_3.md"}
