"""Queries over whole runs: progress documents, stored cursors, and the job that makes a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.functions.times import epoch_micros
from linkatlas.operators import ledger as L
from linkatlas.operators import render as R
from linkatlas.operators import run as J
from linkatlas.operators import summary as S
from linkatlas.operators.skew import salted_join
from linkatlas.plans import sqltext as Q
from linkatlas.plans.derive import bookmarks, ledger, runs
from linkatlas.plans.ledgers import BOTH, LATEST_SQL, LEDGER, SHOWN_SQL
from linkatlas.plans.pages import ERROR_SQL, FORMS, FORMS_SQL, page_forms
from linkatlas.plans.registry import query
from linkatlas.plans.summaries import BODY_SQL, DOC_PATHS_SQL, TEMPLATE, _yaml, first_words, summaries
from linkatlas.session import durable, scratch_path
from linkatlas.sources import progress as P
from linkatlas.sources.ledger_store import clear_ledger, load_ledger, save_ledger
from linkatlas.sources.run_store import RunStore
from linkatlas.sources.tables import table

# Parameter of the derivation: records per progress document, small so that a run takes several.
RECORDS = 50


def _day() -> Column:
    return F.substring("run_id", 5, 8)


def _saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs with the time of their last saving, a second before midnight."""
    return runs(spark, sf_dir).withColumn("saved_at", F.to_timestamp(F.concat(_day(), F.lit(" 235959")), "yyyyMMdd HHmmss").cast("timestamp_ntz"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run was when it ended: the place of its last record's bookmark. On odd days only the last two folders of its path are kept."""
    rows = ledger(spark, sf_dir, titled=False)
    last = rows.groupBy("run_id").agg(F.max_by("url", F.struct("ts", "url")).alias("url"))
    place = L.first_per_url(bookmarks(spark, sf_dir, titled=False).select("export_id", "node_key", "url", "folder_path", "ordinal"))
    path = F.when(_day().cast("int") % 2 == 1, F.slice("folder_path", -2, 2)).otherwise(F.col("folder_path"))
    return last.join(place, "url").select("run_id", path.alias("cursor_path"), F.col("ordinal").cast("bigint").alias("place"), F.lit(25).cast("bigint").alias("total_in_folder"))


def progress_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress documents of the derived ledger, ``run_id, part, raw``; every fourth day's are of the older form."""
    rows = ledger(spark, sf_dir, titled=False).drop("us")
    made = P.progress_documents(rows, _saved_runs(spark, sf_dir), _positions(spark, sf_dir), RECORDS)
    old = F.from_json("raw", "timestamp string, processed_urls array<struct<url: string>>, failed_urls array<struct<url: string>>")
    plain = F.to_json(F.struct(old["timestamp"].alias("timestamp"), old["processed_urls"]["url"].alias("processed_urls"), old["failed_urls"]["url"].alias("failed_urls")))
    return durable(made.withColumn("raw", F.when(_day().cast("int") % 4 == 1, plain).otherwise(F.col("raw"))))


FORM_SQL = "right(run_id, 2)::INTEGER % 4 = 1"
SAVED_SQL = "strptime(right(run_id, 8) || ' 235959', '%Y%m%d %H%M%S')"


@query("s5_progress_documents", f"""WITH {LEDGER}, fit AS (SELECT run_id FROM runs WHERE version = '1.0' AND source = 'bookmarks.json' AND config_hash = 'settings-1'),
sound AS (SELECT * FROM ledger WHERE {FORM_SQL} OR run_id IN (SELECT run_id FROM runs WHERE version = '1.0'))
SELECT run_id, url, CASE WHEN {FORM_SQL} THEN epoch_us({SAVED_SQL}) ELSE us END AS us, outcome, CASE WHEN NOT {FORM_SQL} THEN error END AS error,
  NOT {FORM_SQL} AND run_id IN (SELECT run_id FROM fit) AS usable FROM sound""")
def progress_documents(spark, sf_dir):
    """The records of all sound documents of both forms, and whether a run with the given source and settings may use them."""
    sound = durable(P.sound_progress(P.parse_progress(progress_files(spark, sf_dir).select("run_id", "raw"))))
    rows = P.progress_ledger(sound)
    fits = L.compatible(rows, P.progress_runs(sound), "bookmarks.json", "settings-1").select("run_id").distinct()
    told = salted_join(rows, fits.withColumn("usable", F.lit(True)), ["run_id"], "left", ["url", "ts"])
    return told.select("run_id", "url", epoch_micros(F.col("ts")).alias("us"), "outcome", "error", F.coalesce("usable", F.lit(False)).alias("usable"))


@query("s5_progress_runs", f"""WITH {LEDGER}, sound AS (SELECT * FROM runs WHERE {FORM_SQL} OR version = '1.0'),
counted AS (SELECT run_id, count(*) FILTER (outcome = 'processed') AS p, count(*) FILTER (outcome = 'failed') AS f FROM ledger GROUP BY 1)
SELECT run_id, CASE WHEN {FORM_SQL} THEN 'plain' ELSE 'records' END AS form, CASE WHEN NOT {FORM_SQL} THEN version END AS version, CASE WHEN NOT {FORM_SQL} THEN source END AS source,
  CASE WHEN NOT {FORM_SQL} THEN config_hash END AS config_hash, epoch_us({SAVED_SQL}) AS saved_us,
  CASE WHEN NOT {FORM_SQL} THEN coalesce(p, 0)::BIGINT END AS processed, CASE WHEN NOT {FORM_SQL} THEN coalesce(f, 0)::BIGINT END AS failed
FROM sound LEFT JOIN counted USING (run_id)""")
def progress_runs(spark, sf_dir):
    """What each run's documents say of it: settings, time, and the statistics summed over its parts."""
    told = P.progress_runs(P.sound_progress(P.parse_progress(progress_files(spark, sf_dir).select("run_id", "raw"))))
    return told.groupBy("run_id", "form", "version", "source", "config_hash", epoch_micros(F.col("saved_at")).alias("saved_us")).agg(
        F.sum("processed_count").alias("processed"), F.sum("failed_count").alias("failed"))


# One way to spoil a document for each kind of complaint.
SPOILT = ["", "not valid JSON", "document is not an object", "unsupported version: 2.0", "a record of 'processed_urls' has wrong fields", "field 'failed_urls' is not a list",
          "field 'current_position' has wrong fields"]


@query("s5_progress_quarantine", f"""WITH {LEDGER}, fine AS (SELECT run_id FROM runs WHERE version = '1.0' AND NOT {FORM_SQL}),
lists AS (SELECT run_id, unnest(range(7))::INTEGER AS way FROM fine),
known AS (SELECT l.run_id, way, EXISTS (SELECT 1 FROM ledger d WHERE d.run_id = l.run_id AND d.outcome = 'processed') AS has FROM lists l)
SELECT run_id, way, list_extract([{", ".join(Q.quoted(s) for s in SPOILT)}], way + 1) AS reason FROM known WHERE way > 0 AND (way <> 4 OR has)""")
def progress_quarantine(spark, sf_dir):
    """The whole document of each run, spoilt in every way that a reader must notice; the sound one does not show."""
    rows = ledger(spark, sf_dir, titled=False).drop("us")
    fine = _saved_runs(spark, sf_dir).filter((F.col("version") == "1.0") & (_day().cast("int") % 4 != 1))
    made = P.progress_documents(rows.join(fine.select("run_id"), "run_id", "left_semi"), fine, _positions(spark, sf_dir), 1 << 30).select("run_id", "raw")
    raw, text = F.col("raw"), lambda s: F.lit(s)
    ways = [raw, F.concat(text("{"), raw), F.concat(text("["), raw, text("]")), F.replace(raw, text('"version":"1.0"'), text('"version":"2.0"')),
            F.replace(raw, text('"processed_at":'), text('"done_at":')), F.regexp_replace(raw, r'"failed_urls":\[', '"failed_urls":{},"old_urls":['),
            F.regexp_replace(raw, r'"current_position":(null|\{[^}]*\})', '"current_position":{"folder_path":"Root"}')]
    spoilt = made.select("run_id", F.posexplode(F.array(*ways)).alias("way", "raw"))
    parsed = P.parse_progress(spoilt.withColumn("run_id", F.concat_ws("#", "run_id", "way")).select("run_id", "raw"))
    return P.quarantined_progress(parsed).select(F.split_part("run_id", F.lit("#"), F.lit(1)).alias("run_id"), F.split_part("run_id", F.lit("#"), F.lit(2)).cast("int").alias("way"), "reason")


@query("s5_cleared_runs", f"WITH {LEDGER} SELECT {SHOWN_SQL} FROM ledger WHERE run_id NOT IN (SELECT run_id FROM runs WHERE config_hash = 'settings-2')")
def cleared_runs(spark, sf_dir):
    """The stored ledger without the runs of one fingerprint."""
    path = save_ledger(ledger(spark, sf_dir))
    gone = runs(spark, sf_dir).filter(F.col("config_hash") == "settings-2")
    return load_ledger(spark, clear_ledger(spark, path, gone)).select(*SHOWN_SQL.split(", "))


CURSORS_SQL = """places AS (SELECT url, arg_min(path, (export_id, node_key)) AS path, arg_min(ordinal, (export_id, node_key)) AS ordinal FROM bookmarks GROUP BY url),
ends AS (SELECT run_id, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, url DESC) AS rn FROM ledger) WHERE rn = 1),
cursors AS (SELECT run_id, CASE WHEN right(run_id, 2)::INTEGER % 2 = 1 THEN array_to_string(string_split(path, '/')[-2:], '/') ELSE path END AS cursor_path, ordinal AS place FROM ends JOIN places USING (url))"""


@query("l7_stored_cursor", f"""WITH {BOTH}, {CURSORS_SQL}, kept AS (SELECT c.* FROM cursors c JOIN runs r USING (run_id) WHERE r.version = '1.0' AND NOT {FORM_SQL})
SELECT c.run_id, b.export_id, b.node_key FROM kept c JOIN bookmarks b ON (b.path = c.cursor_path OR ends_with(b.path, '/' || c.cursor_path)) AND b.ordinal < c.place""")
def stored_cursor(spark, sf_dir):
    """What every run has behind it, by the cursors that its progress documents hold."""
    cursors = P.progress_cursors(P.sound_progress(P.parse_progress(progress_files(spark, sf_dir).select("run_id", "raw"))))
    return L.behind_cursors(bookmarks(spark, sf_dir, titled=False), cursors)


@query("l7_resumed_plan", f"""WITH {BOTH}, {LATEST_SQL}, {CURSORS_SQL}, mine AS (SELECT * FROM cursors WHERE run_id = (SELECT max(run_id) FROM cursors)),
known AS (SELECT b.export_id, b.node_key, b.url, EXISTS (SELECT 1 FROM mine c WHERE (b.path = c.cursor_path OR ends_with(b.path, '/' || c.cursor_path)) AND b.ordinal < c.place) AS passed,
  coalesce(s.outcome = 'processed' AND s.error IS NULL, false) AS done FROM bookmarks b LEFT JOIN latest s ON s.url = b.url)
SELECT export_id, node_key, CASE WHEN passed THEN 'skip_position' WHEN done THEN 'skip_done' ELSE 'process' END AS decision FROM known""")
def resumed_plan(spark, sf_dir):
    """The plan of a run that goes on where the last one stood."""
    positions = durable(_positions(spark, sf_dir))
    last = positions.agg(F.max("run_id")).first()[0]
    plan = L.plan_run(bookmarks(spark, sf_dir, titled=False), L.latest_state(ledger(spark, sf_dir, titled=False)), "resume", cursor=positions.filter(F.col("run_id") == last))
    return plan.select("export_id", "node_key", "decision")


# ---------------------------------------------------------------- the job

RUN, PARTS, STARTED = "run-next", 4, datetime(2024, 6, 1)


def _marks(spark, sf_dir):
    """Bookmarks of which every third export is held twice, so that links repeat within the run."""
    own = bookmarks(spark, sf_dir)
    third = F.substring("export_id", 2, 19).cast("bigint") % 3 == 0
    return durable(own.unionByName(own.filter(third).withColumn("export_id", F.concat(F.lit("y"), F.substring("export_id", 2, 19)))))


def _fetched(spark, sf_dir):
    """One fetch of each page, sound or broken by the page's number; of every sixth page nothing came at all."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    picked = page_forms(spark, sf_dir).filter(F.col("form") == F.col("page_id") % (FORMS + 1))
    return picked.select("url", "html", F.timestamp_add("MICROSECOND", F.col("page_id") * 61_000_003, start).alias("fetched"))


def _broken_run(spark, sf_dir, mode):
    """A run that lost its driver: one part is done, one was done twice over, and the rows of a third are staged and not committed. Then the job is started again."""
    store = RunStore(spark, scratch_path(spark, "runs"))
    given = dict(bookmarks=_marks(spark, sf_dir), pages=_fetched(spark, sf_dir), ledger=L.latest_state(ledger(spark, sf_dir)), mode=mode, max_tokens=500, parts=PARTS, started=STARTED)
    J.prepare_run(store, RUN, **given)
    J.run_part(store, RUN, 0, first_words, TEMPLATE, 500)
    again = J.run_part(store, RUN, 1, first_words, TEMPLATE, 500)
    store.commit("outcomes", RUN, "part-00001", store.stage("outcomes", RUN, "part-00001", again))
    store.stage("outcomes", RUN, "part-00002", again)
    J.run_job(store, RUN, provider=first_words, template=TEMPLATE, **given)
    return store


MARKS_SQL = """marks AS (SELECT * FROM bookmarks UNION ALL SELECT * REPLACE ('y' || substr(export_id, 2) AS export_id) FROM bookmarks WHERE substr(export_id, 2)::BIGINT % 3 = 0)"""


def _run_sql(decision: str, again: bool) -> str:
    text = Q.page_text_ctes("picked")
    paths = DOC_PATHS_SQL.replace(" FROM nodes)", " FROM marks)")
    failed = "coalesce(t.html, '') = '' OR t.text = ''"
    prompt = "'Title: ' || m.title || chr(10) || 'Text: ' || left(t.text, 1500) || chr(10) || '--'"
    return f"""WITH {BOTH}, {LATEST_SQL}, {MARKS_SQL}, {paths}, {FORMS_SQL}, picked AS (SELECT page_id, url, html FROM page_forms WHERE form = page_id % {FORMS + 1}), {text},
known AS (SELECT m.export_id, m.node_key, m.title, m.url, m.path AS folder, coalesce(s.outcome = 'processed' AND s.error IS NULL, false) AS done, coalesce(s.outcome = 'failed', false) AS failed,
  coalesce(s.outcome = 'failed' OR s.error IS NOT NULL, false) AS erroneous FROM marks m LEFT JOIN latest s ON s.url = m.url),
todo AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY export_id, node_key) AS nth FROM known WHERE {decision}),
made AS (SELECT m.export_id, m.node_key, m.url, m.title, m.folder, m.nth, {failed} AS lost, {ERROR_SQL.format(t="t.", u="m.")} AS why,
  CASE WHEN contains({prompt}, 'z') THEN length({prompt})::VARCHAR ELSE '{S.FAILED_SUMMARY}no z' END AS summary, CASE WHEN contains({prompt}, 'z') THEN 'ok' ELSE 'error' END AS summary_status,
  make_timestamp(1704067200000000 + t.page_id * 61000003) AS fetched_ts,
  CASE WHEN t.page_id % 1000000 = 0 THEN strftime(make_timestamp(1704067200000000 + t.page_id * 61000003), '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(make_timestamp(1704067200000000 + t.page_id * 61000003), '%Y-%m-%dT%H:%M:%S.%f') END AS fetched FROM todo m LEFT JOIN page_text t ON t.url = m.url),
fronted AS (SELECT *, 'date_processed: ' || {_yaml('fetched')} || chr(10) || 'status: "success"' || chr(10) || 'title: ' || {_yaml('title')} || chr(10) || 'url: ' || {_yaml('url')} AS front FROM made),
records AS (SELECT *, {BODY_SQL} AS body FROM fronted JOIN (SELECT export_id, node_key, path AS doc FROM copies) USING (export_id, node_key) WHERE nth = 1{' OR lost' if again else ''})"""


RUN_SQL = """SELECT export_id, node_key, url, title, epoch_us(coalesce(fetched_ts, TIMESTAMP '2024-06-01')) AS us, CASE WHEN lost THEN 'failed' ELSE 'processed' END AS outcome,
  CASE WHEN NOT lost THEN doc END AS file_path, folder, CASE WHEN lost THEN why END AS error, CASE WHEN NOT lost THEN summary_status END AS summary_status, CASE WHEN NOT lost THEN md5(body) END AS body_md5 FROM records"""


def _shown(store):
    return J.run_outcomes(store).select(
        "export_id", "node_key", "url", "title", epoch_micros(F.col("ts")).alias("us"), "outcome", "file_path", F.array_join("folder_path", "/").alias("folder"), "error",
        "summary_status", F.md5("body").alias("body_md5"))


@query("run_outcomes", f"{_run_sql('NOT done AND NOT failed', False)} {RUN_SQL}")
def run_outcomes(spark, sf_dir):
    """The records and documents of a run that was broken off and taken up again: each exactly once."""
    return _shown(_broken_run(spark, sf_dir, "normal"))


@query("run_repairs", f"{_run_sql('erroneous', True)} {RUN_SQL}")
def run_repairs(spark, sf_dir):
    """The same of a run that takes up failed links only; a link that fails again is recorded again for each of its bookmarks."""
    return _shown(_broken_run(spark, sf_dir, "check_error"))


@query("run_ledger_state", f"""{_run_sql('erroneous', True)}, after AS (SELECT url, ts, run_id, outcome, error FROM ledger
  UNION ALL SELECT url, coalesce(fetched_ts, TIMESTAMP '2024-06-01') + INTERVAL 2 YEAR, '{RUN}', CASE WHEN lost THEN 'failed' ELSE 'processed' END, CASE WHEN lost THEN why END FROM records)
SELECT url, run_id, outcome, error FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, run_id DESC, outcome DESC) AS rn FROM after) WHERE rn = 1""")
def run_ledger_state(spark, sf_dir):
    """What holds after a repairing run: repaired links are clean, others fail as before. The run is put after the records it repairs."""
    late = F.timestamp_add("YEAR", F.lit(2), F.col("ts"))
    records = J.run_records(_broken_run(spark, sf_dir, "check_error")).withColumn("ts", late)
    return L.resolve_failures(ledger(spark, sf_dir).drop("us"), records).select("url", "run_id", "outcome", "error")


@query("run_report", f"""{_run_sql('NOT done AND NOT failed', False)} SELECT (SELECT count(*) FROM marks) AS total, count(*) FILTER (NOT lost) AS processed, count(*) FILTER (lost) AS failed,
  (SELECT count(*) FROM marks) - count(*) AS skipped, {PARTS} AS parts_done, {PARTS} AS parts FROM records""")
def run_report(spark, sf_dir):
    return J.run_report(_broken_run(spark, sf_dir, "normal"), RUN)


# ---------------------------------------------------------------- templates and bodies

@query("p5_without_front", "WITH " + Q.page_text_ctes() + """, titled AS (SELECT page_id, url, text AS summary, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS title FROM page_text)
SELECT page_id, '# ' || title || chr(10) || chr(10) || CASE WHEN summary = '' THEN '' ELSE summary || chr(10) || chr(10) END || '---' || chr(10) || 'Источник: ' || url AS body FROM titled""")
def without_front(spark, sf_dir):
    """Documents of a run that leaves the metadata out."""
    return summaries(spark, sf_dir).select("page_id", R.markdown(F.col("url"), F.col("title"), F.col("summary")).alias("body"))


@query("p1_prompt_file", "SELECT doc_id, 'Seite: ' || source || chr(10) || left(text, 300) || chr(10) || 'Seite: ' || source AS prompt FROM documents")
def prompt_file(spark, sf_dir):
    """A template kept as a file in the shared folder."""
    path = scratch_path(spark, "template")
    spark.createDataFrame([("Seite: {title}\n{content}\nSeite: {title}",)], "value string").coalesce(1).write.option("lineSep", "\0").text(path)
    template = S.load_template(spark, path).rstrip("\0")
    return table(spark, sf_dir, "documents").select("doc_id", S.prompt(template, 100, title=F.col("source"), content=F.col("text")).alias("prompt"))
