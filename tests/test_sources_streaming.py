"""File sources, sinks and the streaming jobs over several micro-batches."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from linkatlas.operators import fetchlog as L
from linkatlas.plans.derive import shape_attempts
from linkatlas.sources import documents as D
from linkatlas.sources import exports as S
from linkatlas.sources.ledger_store import clear_ledger, load_ledger, save_ledger
from linkatlas.streaming import jobs as J
from linkatlas.streaming.runtime import drain, read_sink, stream_table


def test_export_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"roots": {}}), encoding="utf-8")
    (tmp_path / "b.json").write_text("{\n broken", encoding="utf-8")
    parsed = S.parse_exports(S.read_exports(spark, str(tmp_path)))
    assert sorted((r["export_id"][-6:], r["reason"]) for r in parsed.collect()) == [("a.json", ""), ("b.json", S.NOT_JSON)]


def test_file_hashes(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"x" * 10000)
    for name in ("md5", "sha1", "sha256"):
        assert D.file_hashes(spark, str(tmp_path), name).first()["hash"] == hashlib.new(name, b"x" * 10000).hexdigest()
    with pytest.raises(ValueError):
        D.file_hashes(spark, str(tmp_path), "crc")


def test_document_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/a/x.md", "one"), ("/b/y.md", "два")], "path string, body string")
    D.write_documents(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    D.write_document_files(df, str(tmp_path / "files"))
    assert (tmp_path / "files" / "b" / "y.md").read_text(encoding="utf-8") == "два"
    assert [p.name for p in (tmp_path / "files" / "a").iterdir()] == ["x.md"]


def test_a_broken_job_leaves_no_document(spark, tmp_path):
    rows = [(f"/a/{i}.md", "text") for i in range(40)]
    bad = spark.createDataFrame([*rows, ("/../../out.md", "text")], "path string, body string").repartition(4)
    with pytest.raises(Exception, match="path outside the folder"):
        D.write_document_files(bad, str(tmp_path / "files"))
    assert list(tmp_path.iterdir()) == []
    good = spark.createDataFrame(rows, "path string, body string").repartition(4)
    D.write_document_files(good, str(tmp_path / "files"))
    with pytest.raises(Exception, match="is there already"):
        D.write_document_files(good, str(tmp_path / "files"))
    assert len(list((tmp_path / "files" / "a").iterdir())) == 40 and len(list(tmp_path.iterdir())) == 1
    D.write_document_files(good.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_outline_sink(spark, tmp_path):
    D.write_outline(spark.createDataFrame([("e1", "```mermaid\ngraph TD\n```")], "export_id string, document string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 3


def test_ledger_store_appends_runs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run in ("1", "2"):
        save_ledger(spark.createDataFrame([(run, "u", "processed")], "run_id string, url string, outcome string"), path)
    assert sorted(r["run_id"] for r in load_ledger(spark, path).collect()) == ["1", "2"]


def test_ledger_store_replaces_and_clears_runs(spark, tmp_path):
    path, shape = str(tmp_path / "ledger"), "run_id string, url string, outcome string"
    save_ledger(spark.createDataFrame([("1", "u", "failed"), ("1", "v", "failed"), ("2", "u", "processed")], shape), path)
    save_ledger(spark.createDataFrame([("1", "u", "processed")], shape), path)
    assert rows(load_ledger(spark, path), "run_id", "url", "outcome") == [("1", "u", "processed"), ("2", "u", "processed")]
    left = clear_ledger(spark, path, spark.createDataFrame([("1",), ("9",)], "run_id string"))
    assert rows(load_ledger(spark, left), "run_id", "url") == [("2", "u")]


@pytest.fixture
def split_events(spark, small, tmp_path):
    """The events in four files by time, so that a stream takes four micro-batches."""
    path = str(tmp_path / "events.parquet")
    events = spark.read.parquet(f"{small}/events.parquet")
    for i in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def attempts(spark, path):
    return shape_attempts(stream_table(spark, path, files_per_trigger=1))


def test_throttle_state_crosses_batches(spark, split_events):
    batch = L.admissions(shape_attempts(spark.read.parquet(split_events)).select("event_id", "host", "us"), "host", "us", "event_id", 2, 86400)
    live = J.streamed_admissions(attempts(spark, split_events), "host", "us", "event_id", 2, 86400, delay=40 * 86400)
    assert rows(live, "event_id", "admitted_us") == rows(batch, "event_id", "admitted_us")


def test_retry_state_crosses_batches(spark, split_events):
    batch = L.final_outcomes(shape_attempts(spark.read.parquet(split_events)), ["url_id", "episode"])
    live = J.streamed_outcomes(attempts(spark, split_events), "1 day")
    cols = ["url_id", "episode", "final_class", "tries", "outcome", "error"]
    assert rows(live, *cols) == rows(batch, *cols)


def test_silent_fetch_expires(spark, tmp_path):
    path = str(tmp_path / "attempts.parquet")
    shape = "url_id long, episode long, attempt int, us long, ts timestamp_ntz, status int, location string, bytes long, error string"
    def put(*data):
        spark.createDataFrame(data, shape).coalesce(1).write.mode("append").parquet(path)
    import datetime as dt

    def at(hours):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
        return int(hours * 3_600_000_000) + 1_704_067_200_000_000, t
    put((1, 0, 0, *at(0), 503, None, 0, None))
    put((2, 0, 0, *at(500), 200, None, 0, None))
    got = J.streamed_outcomes(stream_table(spark, path, 1), "1 hour", expiry_hours=10)
    assert rows(got, "url_id", "final_class", "tries", "error") == [(1, "retries_exhausted", 1, "HTTP 503"), (2, "ok", 1, None)]


def test_open_fetches_are_told(spark, split_events, tmp_path):
    """The log ends inside its episodes: each has had two of four attempts."""
    path = str(tmp_path / "cut.parquet")
    events = spark.read.parquet(split_events)
    for i in range(2):
        part = events.filter(f"event_id % 200 < 100 and floor(event_id / 50) % 2 = {i}")
        part.coalesce(1).write.mode("append").parquet(path)
    batch = L.final_outcomes(shape_attempts(spark.read.parquet(path)), ["url_id", "episode"])
    live = J.streamed_outcomes(attempts(spark, path), "60 days")
    cols = ["url_id", "episode", "final_class", "tries", "outcome", "error"]
    assert rows(live, *cols) == rows(batch, *cols)
    assert live.filter("final_class = 'retries_exhausted'").count() > 0


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    # Lateness is judged by the watermark of the batch before, hence two batches in between.
    for hour in (0, 10, 11, 0):
        spark.sql(f"SELECT 1L AS host, timestamp_ntz'2024-01-01 00:00:30' + make_interval(0,0,0,0,{hour}) AS ts").coalesce(1).write.mode("append").parquet(path)
        # Distinct modification times keep the order of the files.
        import time
        time.sleep(1.1)
    got = J.windowed_load(stream_table(spark, path, 1), "host", "ts", "1 hour", "1 minute")
    assert sorted(r["requests"] for r in got.collect()) == [1, 1, 1]


def test_keys_come_once_over_batches(spark, split_events):
    stream = stream_table(spark, split_events, 1).withColumn("key", F.col("user_id").cast("string"))
    got = J.first_keys(stream, "key", "ts", "60 days")
    assert got.count() == spark.read.parquet(split_events).select("user_id").distinct().count()


def test_windows_over_batches(spark, split_events):
    live = J.windowed_load(attempts(spark, split_events), "host", "ts", "60 days", "1 hour")
    batch = shape_attempts(spark.read.parquet(split_events)).groupBy("host", (F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).alias("start_us")).count()
    assert rows(live, "host", "start_us", "requests") == rows(batch, "host", "start_us", "count")


def test_resume_after_new_files(spark, small, tmp_path):
    path, base = str(tmp_path / "pages.parquet"), str(tmp_path)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    seen = []
    for i in range(2):
        pages.filter(F.col("page_id") % 2 == i).coalesce(1).write.mode("append").parquet(path)
        stream = J.ingested_pages(stream_table(spark, path))
        drain(stream, f"{base}/rows", f"{base}/checkpoint")
        seen.append(read_sink(spark, f"{base}/rows", stream.schema).count())
    assert seen[1] == pages.count() and 0 < seen[0] < seen[1]
