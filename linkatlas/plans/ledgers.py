"""Queries over the run ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.functions.times import iso_text
from linkatlas.functions.urls import extract_domain
from linkatlas.operators import ledger as L
from linkatlas.operators.skew import salted_join
from linkatlas.operators.tree import subtree_sums
from linkatlas.plans.derive import NODES_CTE, PAGES_CTE, bookmarks, ledger, ledger_cte, runs, stored_nodes
from linkatlas.plans.fetches import OUTCOMES_CTE
from linkatlas.plans.registry import query
from linkatlas.session import durable
from linkatlas.sources.ledger_store import load_ledger, save_ledger

LEDGER = ledger_cte(OUTCOMES_CTE)
BOTH = LEDGER + NODES_CTE[len(PAGES_CTE):] + ", bookmarks AS (SELECT * FROM nodes WHERE kind = 'url')"
SHOWN = ["run_id", "url", "title", "us", "outcome", "error"]
SHOWN_SQL = ", ".join(SHOWN)
LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, run_id DESC, outcome DESC) AS rn FROM ledger) WHERE rn = 1)"""


@query("s5_ledger_round_trip", f"WITH {LEDGER} SELECT {SHOWN_SQL} FROM ledger")
def ledger_round_trip(spark, sf_dir):
    """The ledger written partitioned by run and read back."""
    return load_ledger(spark, save_ledger(ledger(spark, sf_dir))).select(*SHOWN)


@query("s5_saved_twice", f"WITH {LEDGER} SELECT {SHOWN_SQL} FROM ledger")
def saved_twice(spark, sf_dir):
    """A run saved a second time takes the place of its first copy."""
    rows = durable(ledger(spark, sf_dir))
    path = save_ledger(rows)
    return load_ledger(spark, save_ledger(rows, path)).select(*SHOWN)


@query("l1_compatible_runs", f"""WITH {LEDGER} SELECT {", ".join("l." + c for c in SHOWN)} FROM ledger l JOIN runs r ON r.run_id = l.run_id
WHERE r.version = '1.0' AND r.source = 'bookmarks.json' AND r.config_hash = 'settings-1'""")
def compatible_runs(spark, sf_dir):
    return L.compatible(ledger(spark, sf_dir), runs(spark, sf_dir), "bookmarks.json", "settings-1").select(*SHOWN)


@query("l2_first_per_url", f"""WITH {NODES_CTE}, plain AS (SELECT export_id, node_key, title, regexp_replace(url, '[?#].*$', '') AS url FROM nodes WHERE kind = 'url')
SELECT url, export_id, node_key, title, copies FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY export_id, node_key) AS rn, count(*) OVER (PARTITION BY url) AS copies FROM plain) WHERE rn = 1""")
def first_per_url(spark, sf_dir):
    """Links are compared without query and fragment: the first one in processing order stays."""
    short = F.regexp_replace("url", "[?#].*$", "")
    plain = bookmarks(spark, sf_dir).select("export_id", "node_key", "title", short.alias("url"))
    return L.first_per_url(plain).select("url", "export_id", "node_key", "title", "copies")


@query("l3_skip_done", f"""WITH {BOTH} SELECT export_id, node_key, url FROM bookmarks b
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.url = b.url AND l.outcome = 'processed' AND l.error IS NULL)""")
def skip_done(spark, sf_dir):
    left = bookmarks(spark, sf_dir, titled=False).select("export_id", "node_key", "url")
    return salted_join(left, L.done_urls(ledger(spark, sf_dir, titled=False)), ["url"], "left_anti", ["export_id", "node_key"])


@query("l4_retry_errors", f"""WITH {BOTH} SELECT export_id, node_key, url FROM bookmarks b
WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.url = b.url AND (l.outcome = 'failed' OR l.error IS NOT NULL))""")
def retry_errors(spark, sf_dir):
    left = bookmarks(spark, sf_dir, titled=False).select("export_id", "node_key", "url")
    return salted_join(left, L.failed_urls(ledger(spark, sf_dir, titled=False)), ["url"], "left_semi", ["export_id", "node_key"])


@query("l5_error_urls", f"""WITH {LEDGER} SELECT url FROM ledger WHERE outcome = 'failed' UNION SELECT url FROM ledger WHERE outcome = 'processed' AND error IS NOT NULL""")
def error_urls(spark, sf_dir):
    return L.failed_urls(ledger(spark, sf_dir, titled=False))


# Bookmarks of folders that end in the language "en" and stand before place 1 are behind the cursor.
CURSOR = (["en"], 1)
STATE_SQL = LATEST_SQL + """, known AS (SELECT b.export_id, b.node_key, b.url, b.path LIKE '%/en' AND b.ordinal < 1 AS passed,
  coalesce(s.outcome = 'processed' AND s.error IS NULL, false) AS done, coalesce(s.outcome = 'failed', false) AS failed,
  coalesce(s.outcome = 'failed' OR s.error IS NOT NULL, false) AS erroneous FROM bookmarks b LEFT JOIN latest s ON s.url = b.url)"""
DECISIONS = {
    "l6_plan_normal": ("normal", False, "CASE WHEN done THEN 'skip_done' WHEN failed THEN 'skip_failed' ELSE 'process' END"),
    "l6_plan_resume": ("resume", False, "CASE WHEN passed THEN 'skip_position' WHEN done THEN 'skip_done' ELSE 'process' END"),
    "l6_plan_check_error": ("check_error", False, "CASE WHEN erroneous THEN 'process' ELSE 'skip_not_error' END"),
    "u7_dry_run": ("normal", True, "CASE WHEN done THEN 'skip_done' WHEN failed THEN 'skip_failed' ELSE 'process' END"),
    "u7_dry_run_resume": ("resume", True, "CASE WHEN done THEN 'skip_done' WHEN failed THEN 'skip_failed' WHEN passed THEN 'skip_position' ELSE 'process' END"),
    "u7_dry_run_check_error": ("check_error", True, "CASE WHEN NOT erroneous THEN 'skip_not_error' WHEN passed THEN 'skip_position' ELSE 'process' END"),
}


def _plan(mode, dry_run, with_cursor):
    def run(spark, sf_dir):
        plan = L.plan_run(bookmarks(spark, sf_dir, titled=False), L.latest_state(ledger(spark, sf_dir, titled=False)), mode, dry_run,
                          CURSOR if with_cursor else None, suffix=True)
        return plan.select("export_id", "node_key", "url", "decision")

    return run


for _name, (_mode, _dry, _case) in DECISIONS.items():
    query(_name, f"WITH {BOTH}, {STATE_SQL} SELECT export_id, node_key, url, {_case} AS decision FROM known")(
        _plan(_mode, _dry, "passed" in _case))


@query("l7_resume_cursor", f"""WITH {NODES_CTE} SELECT export_id, node_key,
  NOT (path = 'Root/Bookmark Bar/blog.tionsh.example.com/en' AND ordinal < 2) AS ahead_exact, NOT (path LIKE '%/en' AND ordinal < 1) AS ahead_suffix FROM nodes WHERE kind = 'url'""")
def resume_cursor(spark, sf_dir):
    path, place = F.col("folder_path"), F.col("ordinal")
    exact = (["Root", "Bookmark Bar", "blog.tionsh.example.com", "en"], 2)
    return bookmarks(spark, sf_dir, titled=False).select(
        "export_id", "node_key", (~L.before_cursor(path, place, exact)).alias("ahead_exact"),
        (~L.before_cursor(path, place, CURSOR, suffix=True)).alias("ahead_suffix"))


@query("l8_latest_state", f"WITH {LEDGER}, {LATEST_SQL} SELECT {SHOWN_SQL} FROM latest")
def latest_state(spark, sf_dir):
    return L.latest_state(ledger(spark, sf_dir)).select(*SHOWN)


@query("l8_repair_failures", f"""WITH {LEDGER}, {LATEST_SQL}
SELECT url, title, CASE WHEN outcome = 'failed' OR error IS NOT NULL THEN 'repair' ELSE run_id END AS run_id, 'processed' AS outcome, NULL::VARCHAR AS error FROM latest""")
def repair_failures(spark, sf_dir):
    """Every erroneous link is repaired an hour after its last record."""
    rows = ledger(spark, sf_dir)
    broken = L.latest_state(rows).filter(L.is_error(F.col("outcome"), F.col("error")))
    repaired = broken.select(
        F.lit("repair").alias("run_id"), "url", "title", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        (F.col("us") + 3_600_000_000).alias("us"), F.lit("processed").alias("outcome"), F.lit(None).cast("string").alias("error"))
    return L.resolve_failures(rows, repaired).select("url", "title", "run_id", "outcome", "error")


@query("l9_remove_failed", f"WITH {LEDGER}, {LATEST_SQL} SELECT {SHOWN_SQL} FROM latest WHERE outcome <> 'failed'")
def remove_failed(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    gone = L.latest_state(rows).filter(F.col("outcome") == "failed")
    cleaned = L.remove_records(rows, gone, F.localtimestamp())
    return L.latest_state(cleaned).select(*SHOWN)


@query("l10_append_records", f"""WITH {BOTH}, {STATE_SQL}, added AS (SELECT url FROM known WHERE NOT done AND NOT failed)
SELECT run_id, url, outcome, count(*) AS n FROM (SELECT run_id, url, outcome FROM ledger UNION ALL SELECT 'next', url, 'processed' FROM added) GROUP BY ALL""")
def append_records(spark, sf_dir):
    rows = ledger(spark, sf_dir, titled=False)
    plan = L.plan_run(bookmarks(spark, sf_dir, titled=False), L.latest_state(rows))
    new = plan.filter(F.col("decision") == "process").select(F.lit("next").alias("run_id"), "url", "title", F.lit("processed").alias("outcome"))
    return L.append_records(rows, new).groupBy("run_id", "url", "outcome").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("l11_run_statistics", f"""WITH {LEDGER} SELECT run_id, count(*) AS records, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (outcome = 'processed' AND error IS NOT NULL) AS processed_with_error, count(DISTINCT url) AS links,
  count(DISTINCT url) FILTER (outcome = 'processed') AS links_processed, count(DISTINCT url) FILTER (outcome = 'failed') AS links_failed,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_ts FROM ledger GROUP BY 1""")
def run_statistics(spark, sf_dir):
    stats = L.run_statistics(ledger(spark, sf_dir, titled=False))
    return stats.withColumn("start_ts", iso_text(F.col("start_ts"))).withColumn("last_ts", iso_text(F.col("last_ts")))


@query("l11_plan_statistics", f"""WITH {BOTH}, {STATE_SQL} SELECT count(*) AS total, count(*) FILTER (NOT done AND NOT failed) AS to_process,
  count(*) FILTER (done OR failed) AS skipped FROM known""")
def plan_statistics(spark, sf_dir):
    """The count of skipped links that a run really has."""
    plan = L.plan_run(bookmarks(spark, sf_dir, titled=False), L.latest_state(ledger(spark, sf_dir, titled=False)))
    return plan.agg(F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(F.col("decision") == "process").cast("bigint").alias("to_process"),
                    F.count_if(F.col("decision") != "process").cast("bigint").alias("skipped"))


@query("l12_progress", f"""WITH {LEDGER}, steps AS (SELECT run_id, url, us, row_number() OVER (PARTITION BY run_id ORDER BY us, url) AS done,
  count(*) OVER (PARTITION BY run_id) AS total, (us - min(us) OVER (PARTITION BY run_id)) / 1e6::DOUBLE AS elapsed FROM ledger)
SELECT run_id, url, us, done, total, done * 100.0::DOUBLE / total AS percent, elapsed,
  CASE WHEN elapsed > 0 THEN (total - done) / (done / elapsed) END AS eta FROM steps""")
def progress(spark, sf_dir):
    return L.progress(ledger(spark, sf_dir, titled=False).select("run_id", "url", "us"))


@query("l13_folder_outcomes", f"""WITH {BOTH}, {LATEST_SQL}, told AS (SELECT b.export_id, b.node_key, coalesce(s.outcome, 'absent') AS outcome FROM bookmarks b LEFT JOIN latest s ON s.url = b.url)
SELECT f.export_id, f.node_key, count(*) FILTER (t.outcome = 'processed') AS processed, count(*) FILTER (t.outcome = 'failed') AS failed
FROM nodes f LEFT JOIN told t ON t.export_id = f.export_id AND starts_with(t.node_key, f.node_key || '/') WHERE f.kind = 'folder' GROUP BY 1, 2""")
def folder_outcomes(spark, sf_dir):
    state = L.latest_state(ledger(spark, sf_dir, titled=False)).select("url", "outcome")
    told = salted_join(stored_nodes(spark, sf_dir, titled=False), state, ["url"], "left", ["export_id", "node_key"])
    return subtree_sums(told, {k: F.when(F.col("outcome") == k, 1).otherwise(0) for k in ("processed", "failed")})


@query("l13_host_outcome_cube", f"""WITH {LEDGER} SELECT split_part(url, '/', 3) AS host, outcome, count(*) AS n FROM ledger GROUP BY CUBE (host, outcome)""")
def host_outcome_cube(spark, sf_dir):
    per_host = ledger(spark, sf_dir, titled=False).groupBy(extract_domain(F.col("url")).alias("host"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    return per_host.cube("host", "outcome").agg(F.sum("n").cast("bigint").alias("n"))
