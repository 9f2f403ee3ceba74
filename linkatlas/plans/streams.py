"""Streaming queries; each one drains its input and is checked against the batch rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.functions.times import epoch_micros
from linkatlas.plans.derive import ATTEMPTS_CTE, shape_attempts
from linkatlas.plans.fetches import OUTCOMES_CTE
from linkatlas.plans.pages import TEXT
from linkatlas.plans.registry import query
from linkatlas.session import scratch_path
from linkatlas.sources.tables import table
from linkatlas.streaming import jobs as J
from linkatlas.streaming.runtime import drain, drained, read_sink, stream_table


def attempt_stream(spark, sf_dir):
    return shape_attempts(stream_table(spark, f"{sf_dir}/events.parquet"))


@query("r1_ingest_pages", f"WITH {TEXT} SELECT url, strlen(text)::BIGINT AS n_bytes, CASE WHEN text = '' THEN 'failed' ELSE 'processed' END AS outcome FROM page_text")
def ingest_pages(spark, sf_dir):
    return drained(J.ingested_pages(stream_table(spark, f"{sf_dir}/pages.parquet"))).select("url", "n_bytes", "outcome")


@query("r2_first_keys", "SELECT DISTINCT user_id || '-' || event_type AS key FROM events")
def first_keys(spark, sf_dir):
    keyed = stream_table(spark, f"{sf_dir}/events.parquet").withColumn("key", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    return J.first_keys(keyed, "key", "ts", "60 days")


@query("r3_tumbling_load", f"WITH {ATTEMPTS_CTE} SELECT host, us - us % 21600000000 AS start_us, count(*) AS requests FROM attempts GROUP BY 1, 2")
def tumbling_load(spark, sf_dir):
    return J.windowed_load(attempt_stream(spark, sf_dir), "host", "ts", "60 days", "6 hours")


@query("r3_sliding_load", f"""WITH {ATTEMPTS_CTE}, slid AS (SELECT host, us, us - us % 3600000000 - unnest(range(6)) * 3600000000 AS start_us FROM attempts)
SELECT host, start_us, count(*) AS requests FROM slid GROUP BY 1, 2""")
def sliding_load(spark, sf_dir):
    return J.windowed_load(attempt_stream(spark, sf_dir), "host", "ts", "60 days", "6 hours", "1 hour")


# The log is cut by time into six slices, which arrive as files of their own in this order.
ORDER = [1, 0, 3, 2, 5, 4]
SLICE_SQL = f"least(5, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 6 // greatest(1, (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)))"


def mixed_files(spark, sf_dir, apart: int = 0) -> str:
    """The events as files that come out of order; each slice may be moved ``apart`` days further away from the first."""
    events = table(spark, sf_dir, "events")
    us = epoch_micros(F.col("ts"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    nth = F.least(F.lit(5), F.floor((us - low) * 6 / max(1, high - low)))
    path = scratch_path(spark, "mixed") + ".parquet"
    moved = events.withColumn("_slice", nth).withColumn("ts", F.timestamp_add("DAY", F.col("_slice").cast("int") * apart, F.col("ts")))
    for k in ORDER:
        moved.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(path)
    return path


def mixed_stream(spark, sf_dir, apart: int = 0):
    path = mixed_files(spark, sf_dir, apart)
    # Six micro-batches at least, whatever the number of files.
    each = max(1, len(spark.read.parquet(path).inputFiles()) // len(ORDER))
    return shape_attempts(stream_table(spark, path, each))


@query("r4_streamed_admissions", f"""WITH {ATTEMPTS_CTE}, placed AS (
  SELECT event_id, host, us, row_number() OVER (PARTITION BY host ORDER BY us, event_id) - 1 AS i FROM attempts)
SELECT event_id, host, max(us - 21600000000 * (i // 3)) OVER (PARTITION BY host, i % 3 ORDER BY i) + 21600000000 * (i // 3) AS admitted_us, false AS late FROM placed""")
def streamed_admissions(spark, sf_dir):
    """Files in mixed order, none later than the hold-back: the same times as the batch rule gives."""
    return J.streamed_admissions(mixed_stream(spark, sf_dir), "host", "us", "event_id", 3, 21600, delay=15 * 86_400)


MOVED_SQL = f"""sliced AS (SELECT *, ({SLICE_SQL})::INTEGER AS slice FROM events),
moved AS (SELECT user_id AS host, event_type, slice, list_position([{", ".join(map(str, ORDER))}], slice) AS came, epoch_us(ts) + slice * 25 * 86400000000 AS us FROM sliced),
marks AS (SELECT came, max(us) AS top FROM moved GROUP BY 1),
passed AS (SELECT m.came, (SELECT max(top) FROM marks e WHERE e.came < m.came) - 60 * 86400000000 AS mark FROM marks m)"""


@query("r3_late_load", f"""WITH {MOVED_SQL}, windows AS (SELECT host, came, us - us % 21600000000 AS start_us FROM moved)
SELECT host, start_us, count(*) AS requests, count(*) FILTER (start_us + 21600000000 <= mark) AS late FROM windows JOIN passed USING (came) GROUP BY 1, 2""")
def late_load(spark, sf_dir):
    """A log of over 140 days in files of mixed order: late rows are counted, and told apart, and none is lost."""
    return J.merged_load(mixed_stream(spark, sf_dir, 25), "host", "us", 21_600, delay=60 * 86_400)


@query("r2_late_keys", f"""WITH {MOVED_SQL} SELECT host || '-' || event_type || '-' || (us // 604800000000) AS key, min(us) AS first_us, bool_or(mark IS NULL OR us > mark) AS on_time
FROM moved JOIN passed USING (came) GROUP BY 1""")
def late_keys(spark, sf_dir):
    """The keys of that log, each once."""
    path = mixed_files(spark, sf_dir, 25)
    each = max(1, len(spark.read.parquet(path).inputFiles()) // len(ORDER))
    events = stream_table(spark, path, each).withColumn("us", epoch_micros(F.col("ts")))
    keyed = events.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.floor(F.col("us") / 604_800_000_000).cast("string")).alias("key"), "us")
    return J.merged_keys(keyed, "key", "us", 60 * 86_400)


@query("r5_streamed_outcomes", f"WITH {OUTCOMES_CTE} SELECT url_id, episode, final_class, tries, outcome, error FROM outcomes")
def streamed_outcomes(spark, sf_dir):
    return J.streamed_outcomes(attempt_stream(spark, sf_dir), "1 day")


@query("r6_bursts_stream", f"""WITH {ATTEMPTS_CTE}, gaps AS (
  SELECT host, us, CASE WHEN us - lag(us) OVER (PARTITION BY host ORDER BY us) <= 7200000000 THEN 0 ELSE 1 END AS new FROM attempts),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
sessions AS (SELECT host, min(us) AS start_us, max(us) AS end_us, count(*) AS requests FROM numbered GROUP BY host, session)
SELECT * FROM sessions WHERE end_us + 7200000000 <= (SELECT max(us) - max(us) % 1000 FROM attempts) - 86400000000""")
def bursts_stream(spark, sf_dir):
    """Sessions that the watermark, a day behind the last event, has closed."""
    return J.session_bursts(attempt_stream(spark, sf_dir), "host", "ts", "1 day", "2 hours")


@query("r7_resumed_ingest", "SELECT count(*) AS records, count(DISTINCT url) AS links FROM pages")
def resumed_ingest(spark, sf_dir):
    """The ingest started twice over one checkpoint: the second start finds nothing left and adds nothing."""
    base = scratch_path(spark, "ingest")
    for _ in range(2):
        stream = J.ingested_pages(stream_table(spark, f"{sf_dir}/pages.parquet"))
        drain(stream, f"{base}/rows", f"{base}/checkpoint")
    rows = read_sink(spark, f"{base}/rows", stream.schema)
    per_url = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.agg(F.sum("n").cast("bigint").alias("records"), F.count(F.lit(1)).cast("bigint").alias("links"))
