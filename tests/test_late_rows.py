"""Streams over files that come out of order, late, or after a restart."""

import time

import pytest
from pyspark.sql import functions as F

from linkatlas.operators import fetchlog as L
from linkatlas.streaming import jobs as J
from linkatlas.streaming.runtime import stream_table

SHAPE = "host bigint, us bigint, event_id bigint"
SECOND = 1_000_000


def put(spark, path, rows):
    spark.createDataFrame([(h, s * SECOND, i) for h, s, i in rows], SHAPE).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def told(df):
    return {r.event_id: r.admitted_us and r.admitted_us // SECOND for r in df.collect()}


def rule(spark, rows, quota=2, window=60):
    batch = spark.createDataFrame([(h, s * SECOND, i) for h, s, i in rows], SHAPE)
    return told(L.admissions(batch, "host", "us", "event_id", quota, window))


FILES = [[(1, 100, 1), (1, 130, 2), (2, 90, 3)], [(1, 95, 4), (1, 131, 5), (2, 200, 6)], [(1, 132, 7), (1, 400, 8), (2, 199, 9)], [(1, 401, 10), (1, 402, 11), (1, 390, 12)]]


@pytest.mark.parametrize("quota", [0, 1, 2, 3])
def test_throttle_does_not_depend_on_the_cuts(spark, tmp_path, quota):
    path = str(tmp_path / "log.parquet")
    for rows in FILES:
        put(spark, path, rows)
    got = J.streamed_admissions(stream_table(spark, path, 1), "host", "us", "event_id", quota, 60, delay=100)
    assert told(got) == rule(spark, sum(FILES, []), quota) and got.filter("late").count() == 0


def test_throttle_goes_on_after_a_restart(spark, tmp_path):
    path, base = str(tmp_path / "log.parquet"), str(tmp_path / "state")
    for rows in FILES[:2]:
        put(spark, path, rows)
    first = told(J.streamed_admissions(stream_table(spark, path, 1), "host", "us", "event_id", 2, 60, 100, base, ended=False))
    want = rule(spark, sum(FILES, []))
    assert first.items() <= want.items() and len(first) < 6
    for rows in FILES[2:]:
        put(spark, path, rows)
    assert told(J.streamed_admissions(stream_table(spark, path, 1), "host", "us", "event_id", 2, 60, 100, base)) == want


def test_rows_after_their_turn_are_told(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    for rows in ([(1, 0, 1)], [(1, 1000, 2)], [(1, 10, 3), (1, 1001, 4)]):
        put(spark, path, rows)
    got = J.streamed_admissions(stream_table(spark, path, 1), "host", "us", "event_id", 1, 60, delay=100)
    assert {r.event_id: r.late for r in got.collect()} == {1: False, 2: False, 3: True, 4: False}
    assert told(got) == {1: 0, 2: 1000, 3: None, 4: 1060}


def test_no_row_is_lost_however_late(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    for rows in ([(1, 0, 1), (1, 59, 2)], [(1, 100_000, 3)], [(1, 30, 4), (2, 100_000, 5)], [(1, 61, 6)]):
        put(spark, path, rows)
    got = J.merged_load(stream_table(spark, path, 1), "host", "us", 60, delay=3600)
    assert {(r.host, r.start_us // SECOND): (r.requests, r.late) for r in got.collect()} == {(1, 0): (3, 1), (1, 60): (1, 1), (1, 99960): (1, 0), (2, 99960): (1, 0)}
    slid = J.merged_load(stream_table(spark, path, 1), "host", "us", 60, 30, delay=3600)
    assert slid.agg(F.sum("requests")).first()[0] == 12
    keys = J.merged_keys(stream_table(spark, path, 1), "host", "us", 3600)
    assert {(r.host, r.first_us, r.on_time) for r in keys.collect()} == {(1, 0, True), (2, 100_000 * SECOND, True)}
    with pytest.raises(ValueError):
        J.merged_load(stream_table(spark, path, 1), "host", "us", 60, 7)


def test_streams_without_rows(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame([], SHAPE).write.parquet(path)
    stream = lambda: stream_table(spark, path, 1)
    assert J.streamed_admissions(stream(), "host", "us", "event_id").count() == 0
    assert J.merged_load(stream(), "host", "us", 60).count() == 0
    assert J.merged_keys(stream(), "host", "us").count() == 0
