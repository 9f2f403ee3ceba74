"""Streaming jobs: ingest, first-wins dedup, windowed load, throttle, retry state, bursts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.functions.html import size_gated, with_text
from linkatlas.functions.times import epoch_micros
from linkatlas.operators.fetchlog import OK, QUOTA, RETRIES, TERMINAL, WINDOW_SECONDS, admissions, outcome_class
from linkatlas.operators.skew import top_per_group
from linkatlas.session import durable, scratch_path
from linkatlas.streaming.runtime import Carried, drained, latest_update, settings


def event_time(ts: str = "ts") -> Column:
    """Watermarks want an instant; times without zone are taken as UTC, whatever the session zone."""
    return F.timestamp_micros(epoch_micros(F.col(ts)))


def ingested_pages(pages: DataFrame) -> DataFrame:
    """Text of newly arrived pages, one row per page. A page over the size limit has failed."""
    text = with_text(size_gated(pages))
    return text.select("url", F.octet_length("text").cast("bigint").alias("n_bytes"),
                       F.when(F.col("text") == "", "failed").otherwise("processed").alias("outcome"))


def first_keys(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once, within the lateness bound. Only the key comes out, so arrival order cannot show;
    only key and time go into the shuffle."""
    marked = stream.select(key, event_time(ts).alias("_ts")).withWatermark("_ts", delay)
    return drained(marked.dropDuplicatesWithinWatermark([key]).select(key)).select(key)


def windowed_load(stream: DataFrame, key: str, ts: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Requests per key and window, tumbling or sliding. Updates are kept per batch; the last one counts."""
    window = F.window("_ts", length, slide) if slide else F.window("_ts", length)
    counted = (
        stream.withColumn("_ts", event_time(ts)).withWatermark("_ts", delay).groupBy(key, window.alias("_w"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
        .select(key, F.unix_micros(F.col("_w.start")).alias("start_us"), "requests")
    )
    return latest_update(drained(counted, "update"), [key, "start_us"], ["requests"])


def session_bursts(stream: DataFrame, key: str, ts: str, delay: str, gap: str) -> DataFrame:
    """Closed activity sessions per key. Sessions are merged before the shuffle, so a busy key arrives reduced."""
    marked = stream.withColumn("_ts", event_time(ts)).withWatermark("_ts", delay)
    sessions = (
        marked.groupBy(key, F.session_window("_ts", gap).alias("_s"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("requests"), F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
        .select(key, F.unix_micros(F.col("_lo")).alias("start_us"), F.unix_micros(F.col("_hi")).alias("end_us"), "requests")
    )
    with settings(stream.sparkSession, **{"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}):
        return drained(sessions).drop("batch")


def _late(us: Column, mark: int | None) -> Column:
    return F.lit(False) if mark is None else us <= mark


def merged_load(stream: DataFrame, key: str, us: str, length: int, slide: int | None = None, delay: int = 3600, base: str | None = None) -> DataFrame:
    """Requests per key and window (``length`` and ``slide`` in seconds), late ones included: ``key``, ``start_us``, ``requests``, ``late``.

    Each micro-batch writes its own partial counts, and the reader sums them, so no state is held and no row is lost, however late. ``late`` counts the requests whose
    window was closed when they came: its end lay ``delay`` seconds or more behind the latest time of the batches before.
    """
    span, step = length * 1_000_000, (slide or length) * 1_000_000
    if span % step:
        raise ValueError("the length must be a multiple of the slide")
    spark = stream.sparkSession
    carried = Carried(spark, base or scratch_path(spark, "load"), delay * 1_000_000)
    kind = f"{key} {dict(stream.dtypes)[key]}"

    def count(batch: DataFrame, batch_id: int) -> None:
        mark = carried.mark(batch_id - 1)
        last = F.col(us) - F.pmod(F.col(us), F.lit(step))
        start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(span // step - 1)), lambda i: last - i * step))
        counted = batch.select(key, us, start.alias("start_us")).withColumn("_late", _late(F.col("start_us") + span, mark)).groupBy(key, "start_us").agg(
            F.count(F.lit(1)).alias("requests"), F.count_if("_late").alias("late"))
        carried.write("counts", batch_id, counted)
        carried.advance(batch_id, batch, us)

    if carried.run(stream, count) < 0:
        return spark.createDataFrame([], f"{kind}, start_us bigint, requests bigint, late bigint")
    parts = carried.all("counts", f"{kind}, start_us bigint, requests bigint, late bigint")
    return parts.groupBy(key, "start_us").agg(F.sum("requests").alias("requests"), F.sum("late").alias("late"))


def merged_keys(stream: DataFrame, key: str, us: str, delay: int = 3600, base: str | None = None) -> DataFrame:
    """Each key once, however late it comes or comes again: ``key``, ``first_us``, ``on_time``.

    Micro-batches write their distinct keys, and the reader merges them. ``on_time`` tells whether any row of the key came before the mark had passed it.
    """
    spark = stream.sparkSession
    carried = Carried(spark, base or scratch_path(spark, "keys"), delay * 1_000_000)
    shape = f"{key} {dict(stream.dtypes)[key]}, first_us bigint, on_time boolean"

    def distinct(batch: DataFrame, batch_id: int) -> None:
        timely = ~_late(F.col(us), carried.mark(batch_id - 1))
        carried.write("keys", batch_id, batch.groupBy(key).agg(F.min(us).alias("first_us"), F.bool_or(timely).alias("on_time")))
        carried.advance(batch_id, batch, us)

    if carried.run(stream, distinct) < 0:
        return spark.createDataFrame([], shape)
    return carried.all("keys", shape).groupBy(key).agg(F.min("first_us").alias("first_us"), F.bool_or("on_time").alias("on_time"))


def streamed_admissions(stream: DataFrame, key: str, us: str, tie: str, quota: int = QUOTA, window: int = WINDOW_SECONDS, delay: int = 86_400,
                        base: str | None = None, ended: bool = True) -> DataFrame:
    """Admission times of a live stream, in order of arrival time whatever the cut of the micro-batches: ``key``, ``tie``, ``admitted_us``, ``late``.

    Rows are held back until the latest time seen is ``delay`` seconds past them. Those that are ready are admitted by ``fetchlog.admissions``, over the whole cluster,
    after the last ``quota`` admissions of their key, which stand as rows before them; admissions that left the window are forgotten. A row that comes
    after its turn cannot be put in order any more: it comes out with a null admission and ``late`` true. With ``ended`` the rows still held are admitted
    too, as those of a log that is over; the tables kept for a later start do not take that step.
    """
    spark, span = stream.sparkSession, window * 1_000_000
    carried = Carried(spark, base or scratch_path(spark, "throttle"), delay * 1_000_000)
    kind = dict(stream.dtypes)
    held_shape, recent_shape = f"key {kind[key]}, us bigint, tie {kind[tie]}", f"key {kind[key]}, admitted_us bigint"
    out_shape = f"key {kind[key]}, tie {kind[tie]}, admitted_us bigint, late boolean"

    def admit(ready: DataFrame, batch_id: int) -> DataFrame:
        seeds = carried.read("recent", batch_id - 1, recent_shape).select("key", F.col("admitted_us").alias("us"), F.lit(None).cast(kind[tie]).alias("tie"), F.lit(0).alias("turn"))
        return admissions(seeds.unionByName(ready.withColumn("turn", F.lit(1))), "key", "us", "tie", quota, window, first="turn")

    def step(batch: DataFrame, batch_id: int) -> None:
        before = carried.mark(batch_id - 1)
        rows = batch.select(F.col(key).alias("key"), F.col(us).cast("bigint").alias("us"), F.col(tie).alias("tie"))
        mark = carried.advance(batch_id, rows, "us")
        late = _late(F.col("us"), before)
        pool = carried.read("held", batch_id - 1, held_shape).unionByName(rows.filter(~late))
        ready = _late(F.col("us"), mark)
        told = durable(admit(pool.filter(ready), batch_id))
        done = told.filter("turn = 1").select("key", "tie", "admitted_us", F.lit(False).alias("late"))
        lost = rows.filter(late).select("key", "tie", F.lit(None).cast("bigint").alias("admitted_us"), F.lit(True).alias("late"))
        carried.write("admitted", batch_id, done.unionByName(lost))
        carried.write("held", batch_id, pool.filter(~ready))
        # A later row arrives after the mark, so an admission that leaves the window before it delays none.
        kept = told if mark is None else told.filter(F.col("admitted_us") + span > mark)
        newest = top_per_group(kept.select("key", "admitted_us", "turn", "us", "tie"), ["key"], [F.col(c).desc() for c in ("admitted_us", "turn", "us", "tie")], max(quota, 1), ["tie", "us"])
        carried.write("recent", batch_id, newest.select("key", "admitted_us"))

    last = carried.run(stream, step)
    if last < 0:
        return spark.createDataFrame([], out_shape.replace("key", key, 1).replace("tie", tie, 1))
    out = carried.all("admitted", out_shape).drop("batch")
    if ended:
        rest = admit(carried.read("held", last, held_shape), last + 1).filter("turn = 1").select("key", "tie", "admitted_us", F.lit(False).alias("late"))
        out = out.unionByName(rest)
    return out.select(F.col("key").alias(key), F.col("tie").alias(tie), "admitted_us", "late")


# Fixed value: the outcome of a fetch without a terminal answer.
OPEN = "retries_exhausted"


def _micros(spark: SparkSession, interval: str) -> int:
    """The length of an interval such as ``1 day``."""
    start = datetime(1970, 1, 1)
    return (spark.range(1).select(F.lit(start).cast("timestamp_ntz") + F.expr(f"interval {interval}")).first()[0] - start) // timedelta(microseconds=1)


def streamed_outcomes(stream: DataFrame, delay: str, retries: int = RETRIES, expiry_hours: int = 168, base: str | None = None) -> DataFrame:
    """Outcome per fetch ``(url_id, episode)`` from a live attempt log: its last update, so open fetches show what they came to so far.

    What a fetch has come to is a row that goes from one micro-batch to the next. A batch groups these rows and its attempts by fetch in one pass: the first terminal answer ends a
    fetch, otherwise its last attempt counts. A fetch is forgotten when the log falls silent about it for ``expiry_hours``. Lateness is judged by the mark of
    the batch before, silence by that of this batch, both in whole milliseconds and from 1970 on.
    """
    spark, fetch = stream.sparkSession, ["url_id", "episode"]
    carried = Carried(spark, base or scratch_path(spark, "outcomes"), _micros(spark, delay))
    shape = "url_id bigint, episode bigint, tries int, done boolean, error string, final string, expires_ms bigint, told boolean"
    state = ["tries", "done", "error", "final", "expires_ms"]
    shaped = stream.select(
        F.col("url_id").cast("bigint").alias("url_id"), F.col("episode").cast("bigint").alias("episode"), "attempt", "us", epoch_micros(F.col("ts")).alias("_us"),
        outcome_class(F.col("status"), F.col("location"), F.col("bytes")).alias("outcome_class"),
        F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("detail"))

    def passed(batch_id: int) -> int:
        return max(0, (carried.mark(batch_id) or 0) // 1000)

    def step(batch: DataFrame, batch_id: int) -> None:
        before = passed(batch_id - 2)
        rows = batch.filter(~F.coalesce(_late(F.col("_us"), before * 1000), F.lit(False)))
        known = carried.read("state", batch_id - 1, shape).filter(F.coalesce(F.col("expires_ms") >= before, F.lit(True)))
        counts = F.col("attempt") <= retries
        place = F.struct("attempt", F.col("us").isNull(), "us", "outcome_class", "detail")
        grouped = known.select(*fetch, F.struct(*state).alias("known")).unionByName(
            rows.select(*fetch, "us", F.lit(True).alias("came"), F.when(counts, place).alias("last"), F.when(counts & F.col("outcome_class").isin(TERMINAL), place).alias("end")),
            allowMissingColumns=True,
        ).groupBy(*fetch).agg(F.max("known").alias("known"), F.min("end").alias("end"), F.max("last").alias("last"), F.max("us").alias("us"),
                              F.coalesce(F.max("came"), F.lit(False)).alias("told"))
        ended = F.coalesce(F.col("known.done"), F.lit(False))
        now = F.when(ended, F.col("known")).when(F.col("last").isNull(), F.coalesce("known", F.struct(
            F.lit(0).alias("tries"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"), F.lit(OPEN).alias("final"), F.lit(None).cast("bigint").alias("expires_ms"))))
        row = F.coalesce("end", "last")
        now = now.otherwise(F.struct(
            (row["attempt"] + 1).cast("int").alias("tries"), F.col("end").isNotNull().alias("done"), row["detail"].alias("error"),
            F.coalesce("end.outcome_class", F.lit(OPEN)).alias("final"), F.lit(None).cast("bigint").alias("expires_ms")))
        expires = F.when(F.col("told"), F.floor(F.col("us") / 1000) + expiry_hours * 3_600_000).otherwise(F.col("known.expires_ms"))
        carried.write("state", batch_id, grouped.withColumn("now", now).select(*fetch, *[f"now.{c}" for c in state[:-1]], expires.alias("expires_ms"), "told"))
        carried.advance(batch_id, batch, "_us")

    if carried.run(shaped, step) < 0:
        return spark.createDataFrame([], "url_id bigint, episode bigint, final_class string, tries int, outcome string, error string")
    told = carried.all("state", shape).filter(F.col("told") & (F.col("tries") != 0))
    shown = F.when(F.col("final") == OK, None).when(F.col("final") == OPEN, F.col("error")).otherwise(F.col("final"))
    updates = told.select(*fetch, "batch", F.col("final").alias("final_class"), "tries", F.when(F.col("final") == OK, "processed").otherwise("failed").alias("outcome"), shown.alias("error"))
    return latest_update(updates, fetch, ["final_class", "tries", "outcome", "error"])
