"""Outcomes of fetches carried over micro-batches, without a Python call for each fetch."""

import datetime as dt
import time

from linkatlas.streaming import jobs as J
from linkatlas.streaming.runtime import stream_table

SHAPE = "url_id long, episode long, attempt int, us long, ts timestamp_ntz, status int, location string, bytes long, error string"


def put(spark, path, *rows):
    """One file: (url_id, attempt, hours, status) each."""
    start = dt.datetime(2024, 1, 1)
    data = [(u, 0, a, int(h * 3_600_000_000) + 1_704_067_200_000_000, start + dt.timedelta(hours=h), s, None, 0, None) for u, a, h, s in rows]
    spark.createDataFrame(data, SHAPE).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def outcomes(spark, path, **more):
    return J.streamed_outcomes(stream_table(spark, path, 1), "1 hour", expiry_hours=10, **more)


def test_state_goes_on_ends_and_is_forgotten(spark, tmp_path):
    path = str(tmp_path / "attempts.parquet")
    put(spark, path, (1, 0, 0, 503), (2, 0, 0, 404), (3, 0, 0, 503), (4, 1, 0, 503), (4, 0, 0, 503), (5, 4, 0, 200))
    # 1 ends at its second try, 2 stays ended, 4 goes back to an earlier try; 9 moves the mark far on.
    put(spark, path, (1, 1, 1, 200), (1, 2, 1.5, 404), (2, 1, 1, 200), (4, 0, 2, 503), (9, 0, 500, 200))
    put(spark, path, (9, 1, 501, 503))
    # 3 comes back after its silence as a new fetch; 1 is too late.
    put(spark, path, (3, 2, 520, 503), (1, 3, 2, 503))
    got = {(r.url_id, r.final_class, r.tries, r.outcome, r.error) for r in outcomes(spark, path).collect()}
    assert got == {(1, "ok", 2, "processed", None), (2, "gone", 1, "failed", "gone"), (3, "retries_exhausted", 3, "failed", "HTTP 503"),
                   (4, "retries_exhausted", 1, "failed", "HTTP 503"), (9, "ok", 1, "processed", None)}


def test_no_python_for_each_fetch(spark, tmp_path):
    """20,000 fetches: some seconds, and minutes when each of them is a call of its own."""
    path = str(tmp_path / "attempts.parquet")
    spark.range(40_000).selectExpr("id % 20000 AS url_id", "0L AS episode", "cast(id div 20000 AS int) AS attempt", "1704067200000000 + id AS us", "timestamp_ntz'2024-01-01' AS ts",
                                   "503 AS status", "cast(null AS string) AS location", "0L AS bytes", "cast(null AS string) AS error").coalesce(1).write.parquet(path)
    warm = str(tmp_path / "warm.parquet")
    put(spark, warm, (1, 0, 0, 503))
    assert outcomes(spark, warm).count() == 1
    began = time.time()
    got = outcomes(spark, path)
    assert got.filter("tries = 2 AND error = 'HTTP 503'").count() == got.count() == 20_000
    assert time.time() - began < 20
