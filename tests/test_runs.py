"""Whole runs: broken off and taken up again, progress documents in both forms, stored cursors, template files."""

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from linkatlas.operators import ledger as L
from linkatlas.operators import run as J
from linkatlas.operators import summary as S
from linkatlas.sources import progress as P
from linkatlas.sources.run_store import RunStore

# The providers below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "export_id string, node_key string, url string, title string, folder_path array<string>, ordinal int"
LEDGER = "run_id string, url string, title string, ts timestamp_ntz, outcome string, file_path string, folder_path array<string>, error string"
AT = datetime(2024, 5, 1, 12)


def marks_of(spark, n=12):
    rows = [(f"x{i % 2}", f"R/b{i:019d}", f"https://h/{i % 9}", f"Page {i % 4}", ["Root", "Other"], i) for i in range(n)]
    return spark.createDataFrame(rows, MARK)


def pages_of(spark):
    html = lambda i: None if i == 1 else "" if i == 2 else "<main></main>" if i == 3 else f"<p>text {i}</p>"
    return spark.createDataFrame([(f"https://h/{i}", html(i)) for i in range(8)], "url string, html string")


def upper(batches):
    for batch in batches:
        assert not batch["prompt"].str.contains("poison").any(), "the provider is gone"
        yield batch.assign(content=batch["prompt"].str.upper(), error=None)[["url", "content", "error"]]


def ledger_of(spark, rows=()):
    return spark.createDataFrame([("old", u, "t", AT, o, None, None, e) for u, o, e in rows], LEDGER)


def told(df):
    return sorted(((r.url, r.export_id, r.outcome, r.error, r.body) for r in df.collect()), key=str)


def test_a_run_that_is_lost_goes_on(spark, tmp_path):
    args = dict(pages=pages_of(spark), ledger=ledger_of(spark), base="/out", parts=3, started=AT)
    whole = RunStore(spark, str(tmp_path / "whole"))
    J.run_job(whole, "r/1", marks_of(spark), provider=upper, **args)
    want = told(J.run_outcomes(whole))

    broken = RunStore(spark, str(tmp_path / "broken"))
    J.prepare_run(broken, "r/1", marks_of(spark), **args)
    first = J.run_part(broken, "r/1", 0, upper)
    assert J.open_parts(broken, "r/1") == [1, 2]
    broken.stage("outcomes", "r/1", "part-00001", first)

    def poisoned(batches):
        yield from upper(b.assign(prompt="poison") for b in batches)

    with pytest.raises(Exception, match="the provider is gone"):
        for part in J.open_parts(broken, "r/1"):
            J.run_part(broken, "r/1", part, poisoned)
    assert set(told(J.run_outcomes(broken))) < set(want)
    # Started again, even with other bookmarks at hand, the run goes by its own plan.
    ledger = J.run_job(broken, "r/1", marks_of(spark, 2), provider=upper, **args)
    assert told(J.run_outcomes(broken)) == want and ledger.count() == len(want)
    assert J.open_parts(broken, "r/1") == []
    J.run_job(broken, "r/1", marks_of(spark), provider=upper, **args)
    assert told(J.run_outcomes(broken)) == want
    J.run_job(broken, "r2", marks_of(spark), provider=upper, **args)
    assert J.run_records(broken).groupBy("run_id").count().count() == 2


def test_outcomes_of_a_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert J.run_outcomes(store).count() == 0
    ledger = J.run_job(store, "a", marks_of(spark), pages_of(spark), ledger_of(spark, [("https://h/4", "processed", None), ("https://h/5", "failed", "x")]), upper, parts=2, started=AT)
    rows = {r.url: r for r in J.run_outcomes(store).collect()}
    assert len(rows) == J.run_outcomes(store).count() == 7 and ledger.count() == 9
    assert {u[-1] for u, r in rows.items() if r.outcome == "failed"} == set("1238")
    assert rows["https://h/8"].error.endswith("https://h/8") and rows["https://h/3"].error != rows["https://h/2"].error
    one = rows["https://h/0"]
    assert one.export_id == "x0" and "TEXT 0" in one.body and one.body.startswith("---\n") and one.file_path.endswith("/Page 0.md") and one.ts == AT
    report = J.run_report(store, "a").first()
    assert (report.total, report.processed, report.failed, report.skipped, report.parts_done) == (12, 3, 4, 5, 2)
    assert J.run_documents(store, "a").count() == 3


def test_failures_are_tried_again(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    old = ledger_of(spark, [("https://h/0", "failed", "x"), ("https://h/1", "failed", "x"), ("https://h/4", "processed", "late"), ("https://h/5", "processed", None)])
    J.run_job(store, "again", marks_of(spark), pages_of(spark), old, upper, mode="check_error", parts=2, started=AT, metadata=False)
    rows = sorted((r.url[-1], r.outcome) for r in J.run_outcomes(store).collect())
    assert rows == [("0", "processed"), ("1", "failed"), ("1", "failed"), ("4", "processed")]
    state = {r.url[-1]: r.outcome for r in L.resolve_failures(old, J.run_records(store).withColumn("ts", F.lit(datetime(2025, 1, 1)))).collect()}
    assert state == {"0": "processed", "1": "failed", "4": "processed", "5": "processed"}


def test_failed_summaries_are_errors_on_request(spark, tmp_path):
    def failing(batches):
        for batch in batches:
            yield batch.assign(content=None, error="busy")[["url", "content", "error"]]

    for flag in (False, True):
        store = RunStore(spark, str(tmp_path / str(flag)))
        J.run_job(store, "a", marks_of(spark, 1), pages_of(spark), ledger_of(spark), failing, parts=1, started=AT, flag_errors=flag)
        row = J.run_outcomes(store).first()
        assert row.outcome == "processed" and row.summary_status == "error" and (row.error is not None) == flag and S.FAILED_SUMMARY in row.body


def test_a_run_over_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert J.run_job(store, "none", marks_of(spark).limit(0), pages_of(spark).limit(0), ledger_of(spark), upper).count() == 0
    report = J.run_report(store, "none").first()
    assert (report.total, report.processed, report.skipped) == (0, 0, 0)
    with pytest.raises(ValueError):
        J.run_part(store, "never", 0, upper)


RECORD = {"url": "u1", "title": "t", "processed_at": "2024-01-02T03:04:05.000006", "file_path": "/o/t.md", "folder_path": ["Root", "A"], "error": None}
LOST = {"url": "u2", "title": "t", "failed_at": "2024-01-02T03:04:06", "error": "gone"}
SOUND = {"version": "1.0", "timestamp": "2024-01-02T04:00:00", "bookmarks_file": "b.json", "config_hash": "h", "processed_urls": [RECORD], "failed_urls": [LOST],
         "current_position": {"folder_path": ["A"], "bookmark_index": 3, "total_in_folder": 9}, "statistics": {"total_bookmarks": 2, "processed_count": 1, "failed_count": 1, "skipped_count": 0}}


def test_progress_files(spark, tmp_path):
    old = {"timestamp": "2023-01-01T00:00:00", "processed_urls": ["u3", "u4"], "failed_urls": ["u5"]}
    files = {"new": SOUND, "old": old, "bare": {"version": "1.0"}, "version": {**SOUND, "version": "2.0"}, "list": [1], "extra": {**SOUND, "processed_urls": [{**RECORD, "more": 1}]},
             "short": {**SOUND, "failed_urls": [{"url": "u"}]}, "odd": {**SOUND, "failed_urls": 7}, "mixed": {**old, "failed_urls": [RECORD]}, "place": {**SOUND, "current_position": {"folder_path": []}}}
    for name, doc in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    parsed = P.parse_progress(P.read_progress(spark, str(tmp_path)).withColumn("run_id", F.regexp_extract("run_id", r"(\w+)\.json$", 1)))
    wrong = {r.run_id: r.reason for r in P.quarantined_progress(parsed).collect()}
    assert set(wrong) == {"version", "list", "extra", "short", "odd", "mixed", "place", "broken"}
    assert wrong["version"] == "unsupported version: 2.0" and wrong["odd"] == "field 'failed_urls' is not a list" and "entry of 'failed_urls'" in wrong["mixed"]
    sound = P.sound_progress(parsed)
    rows = {r.url: r for r in P.progress_ledger(sound).collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4", "u5"}
    assert rows["u1"].ts == datetime(2024, 1, 2, 3, 4, 5, 6) and rows["u1"].folder_path == ["Root", "A"] and rows["u2"].error == "gone"
    assert rows["u3"].ts == datetime(2023, 1, 1) and rows["u5"].outcome == "failed" and rows["u5"].title is None
    assert {r.run_id: r.form for r in P.progress_runs(sound).collect()} == {"new": "records", "old": "plain", "bare": "records"}
    assert [tuple(r) for r in P.progress_cursors(sound).collect()] == [("new", ["A"], 3, 9)]


def test_documents_are_split_and_read_back(spark):
    rows = spark.createDataFrame([("r", f"u{i}", f'T"{i}', AT, "failed" if i % 3 else "processed", None, ["Root", "Ä"], "e" if i % 3 else None) for i in range(50)] + [
        ("s", "u1", "t", AT, "processed", "/f.md", None, "late")], LEDGER)
    runs = spark.createDataFrame([(r, "1.0", "b.json", "h", AT) for r in "rsz"], "run_id string, version string, source string, config_hash string, saved_at timestamp_ntz")
    made = P.progress_documents(rows, runs, records=20)
    assert {(r.run_id, r.part) for r in made.collect()} == {("r", 0), ("r", 1), ("r", 2), ("s", 0), ("z", 0)}
    back = P.progress_ledger(P.sound_progress(P.parse_progress(made.select("run_id", "raw"))))
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_stored_cursors_equal_the_rule(spark):
    paths = [["Root", "A", "B"], ["Root", "B"], ["B"], ["A", "B"], ["Root"], ["Root", "A", "B", "B"]]
    marks = spark.createDataFrame([("x", f"{p}-{i}", "u", "t", path, i) for p, path in enumerate(paths) for i in range(4)], MARK)
    cursors = [("r1", ["B"], 2), ("r2", ["A", "B"], 3), ("r3", ["Root", "A", "B"], 1), ("r4", [], 4), ("r5", None, 4), ("r6", ["C"], 4), ("r7", ["B"], None), ("r8", ["Root", "A", "B", "B"], 9)]
    given = spark.createDataFrame(cursors, "run_id string, cursor_path array<string>, place bigint")
    for suffix in (True, False):
        want = {(run, f"{p}-{i}") for run, at, place in cursors for p, path in enumerate(paths) for i in range(4)
                if at and place is not None and i < place and (path == at or (suffix and path[-len(at):] == at))}
        assert {(r.run_id, r.node_key) for r in L.behind_cursors(marks, given, suffix).collect()} == want
    assert L.behind_cursors(marks, given.limit(0)).count() == 0
    plan = L.plan_run(marks, ledger_of(spark), "resume", cursor=given.filter("run_id = 'r2'"))
    assert {r.node_key for r in plan.filter("decision = 'skip_position'").collect()} == {f"{p}-{i}" for p in (0, 3) for i in range(3)}


def test_template_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Zu {title}:\n{content}\n")
    template = S.load_template(spark, str(tmp_path / "t.txt"))
    assert spark.range(1).select(S.prompt(template, 1, title=F.lit("{content}"), content=F.lit("abcdef"))).first()[0] == "Zu {content}:\nabc\n"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.load_template(spark, str(tmp_path / "missing.txt"))
    (tmp_path / "bad.txt").write_text("{title} {name}")
    with pytest.raises(ValueError, match="name"):
        S.load_template(spark, str(tmp_path / "bad.txt"))
