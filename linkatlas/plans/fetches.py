"""Queries over the fetch log."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.functions.times import epoch_micros
from linkatlas.operators import fetchlog as L
from linkatlas.operators.skew import exact_quantiles
from linkatlas.plans.derive import ATTEMPTS_CTE, REDIRECTS_CTE, attempts, redirects
from linkatlas.plans.registry import query
from linkatlas.session import durable
from linkatlas.sources.tables import table

CLASS_SQL = """CASE WHEN status = 200 AND bytes / 1048576.0 > 5.0 THEN 'too_large' WHEN status = 200 THEN 'ok' WHEN status IN (404, 410) THEN 'gone'
  WHEN status IN (301, 302) AND location IS NOT NULL THEN 'redirect' WHEN status IN (301, 302) THEN 'redirect_without_target' ELSE 'retry' END"""

OUTCOMES_CTE = ATTEMPTS_CTE + f""",
classed AS (SELECT *, {CLASS_SQL} AS outcome_class FROM attempts),
placed AS (SELECT *, row_number() OVER (PARTITION BY url_id, episode ORDER BY attempt) AS rn,
  min(CASE WHEN outcome_class IN ('ok', 'too_large', 'gone', 'redirect_without_target') THEN attempt END) OVER (PARTITION BY url_id, episode) AS first_end,
  max(attempt) OVER (PARTITION BY url_id, episode) AS last_attempt, max(ts) OVER (PARTITION BY url_id, episode) AS last_ts FROM classed WHERE attempt <= 3),
outcomes AS (SELECT url_id, episode, CASE WHEN first_end IS NULL THEN 'retries_exhausted' ELSE outcome_class END AS final_class,
    (attempt + 1)::INTEGER AS tries, CASE WHEN first_end IS NOT NULL AND outcome_class = 'ok' THEN 'processed' ELSE 'failed' END AS outcome,
    CASE WHEN first_end IS NULL THEN coalesce(error, 'HTTP ' || status) WHEN outcome_class <> 'ok' THEN outcome_class END AS error, last_ts AS ts
  FROM placed WHERE attempt = coalesce(first_end, last_attempt))"""


@query("s4_attempt_source", f"""WITH {ATTEMPTS_CTE}
SELECT url_id, host, episode, attempt, us, status::INTEGER AS status, location, bytes, error FROM attempts""")
def attempt_source(spark, sf_dir):
    return attempts(spark, sf_dir).select("url_id", "host", "episode", "attempt", "us", "status", "location", "bytes", "error")


@query("f1_outcome_class", f"WITH {ATTEMPTS_CTE} SELECT event_id, {CLASS_SQL} AS outcome_class FROM attempts")
def outcome_class(spark, sf_dir):
    return L.classified(attempts(spark, sf_dir)).select("event_id", "outcome_class")


@query("f2_final_outcomes", f"WITH {OUTCOMES_CTE} SELECT url_id, episode, final_class, tries, outcome, error FROM outcomes")
def final_outcomes(spark, sf_dir):
    return L.final_outcomes(attempts(spark, sf_dir), ["url_id", "episode"]).select(
        "url_id", "episode", "final_class", "tries", "outcome", "error")


@query("f3_backoff_schedule", f"""WITH {ATTEMPTS_CTE}, steps AS (SELECT unnest([1, 2, 3])::INTEGER AS retry, unnest([1.5, 3.0, 6.0])::DOUBLE AS wait, unnest([1500000, 4500000, 10500000])::BIGINT AS plus)
SELECT url_id, episode, retry, wait, us + plus AS earliest_us FROM attempts, steps WHERE attempt = 0""")
def backoff_schedule(spark, sf_dir):
    starts = attempts(spark, sf_dir).filter(F.col("attempt") == 0).select("url_id", "episode", "us")
    return L.backoff_schedule(starts).select("url_id", "episode", "retry", "wait", "earliest_us")


@query("f3_backoff_gaps", f"""WITH {ATTEMPTS_CTE}, gaps AS (SELECT url_id, episode, attempt,
    (us - lag(us) OVER (PARTITION BY url_id, episode ORDER BY attempt)) / 1e6::DOUBLE AS gap,
    CASE attempt WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 3.0::DOUBLE WHEN 3 THEN 6.0::DOUBLE END AS due FROM attempts)
SELECT url_id, episode, attempt, gap, due, gap >= due AS kept FROM gaps""")
def backoff_gaps(spark, sf_dir):
    return L.backoff_gaps(attempts(spark, sf_dir), ["url_id", "episode"])


@query("f4_redirects", f"""WITH RECURSIVE {REDIRECTS_CTE}, walk AS (
  SELECT src, src AS cur, dst AS nxt, 0 AS hops FROM redirects
  UNION ALL SELECT w.src, r.src, r.dst, w.hops + 1 FROM walk w JOIN redirects r ON r.src = w.nxt WHERE w.hops < 5),
ends AS (SELECT src, cur, nxt, hops, row_number() OVER (PARTITION BY src ORDER BY hops DESC) AS rn FROM walk)
SELECT src, CASE WHEN nxt IS NULL THEN cur END AS final, hops::INTEGER AS hops, nxt IS NULL AS resolved FROM ends WHERE rn = 1""")
def resolved_redirects(spark, sf_dir):
    return L.resolve_redirects(redirects(spark, sf_dir))


@query("f5_admissions", f"""WITH {ATTEMPTS_CTE}, placed AS (
  SELECT event_id, host, us, row_number() OVER (PARTITION BY host ORDER BY us, event_id) - 1 AS i FROM attempts),
lead AS (SELECT *, max(us - 21600000000 * (i // 3)) OVER (PARTITION BY host, i % 3 ORDER BY i) AS m FROM placed)
SELECT event_id, host, us, m + 21600000000 * (i // 3) AS admitted_us FROM lead""")
def admissions(spark, sf_dir):
    """A quota of three per host and six hours, so that it bites at the pace of these events."""
    requests = attempts(spark, sf_dir).select("event_id", "host", "us")
    return L.admissions(requests, "host", "us", "event_id", quota=3, window=21600)


@query("f6_trailing_load", f"""WITH {ATTEMPTS_CTE}
SELECT DISTINCT host, us, count(*) OVER w AS load,
  count(*) OVER w > 3 AS over_quota, count(*) OVER s AS requests
FROM attempts WINDOW w AS (PARTITION BY host ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), s AS (PARTITION BY host, us)""")
def trailing_load(spark, sf_dir):
    loads = L.trailing_load(attempts(spark, sf_dir).select("host", "us"), "host", "us", window=21600)
    return loads.withColumn("requests", F.col("requests").cast("bigint"))


@query("f7_durations", """
SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (value < 50) AS succeeded FROM events GROUP BY 1""")
def durations(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), "value")
    cuts = exact_quantiles(events, "operation", "value", [0.5, 0.95]).groupBy("operation").agg(
        F.round(F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))), 6).alias("p50"),
        F.round(F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))), 6).alias("p95"))
    plain = events.groupBy("operation").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("longest"),
        F.count_if(F.col("value") < 50).cast("bigint").alias("succeeded"))
    return plain.join(cuts, "operation")


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("f7_sketched_durations", f"""SELECT operation, prob, n, true AS close FROM (
  SELECT event_type AS operation, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT '', count(*) FROM events), (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PROBS)}]) AS prob)""")
def sketched_durations(spark, sf_dir):
    """Quantiles of two roll-ups of hourly sketches, per operation and over all, each held against the rows: the shares of values below the estimate, and up to it, must
    enclose the wanted share to within one in a hundred."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), "value", epoch_micros(F.col("ts")).alias("us"))
    sketches = durable(L.duration_sketches(events, ["operation"], "us", "value"))
    found = L.sketched_quantiles(sketches, ["operation"], PROBS).unionByName(
        L.sketched_quantiles(sketches.withColumn("operation", F.lit("")), ["operation"], PROBS))
    twice = events.select("operation", "value").unionByName(events.select(F.lit("").alias("operation"), "value"))
    # Ten estimates an operation, so the join repeats a row ten times and is summed at once.
    held = twice.join(F.broadcast(found), "operation").groupBy("operation", "prob", "n").agg(
        F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("upto"))
    return held.select("operation", "prob", "n", ((F.col("below") <= F.col("prob") + 0.01) & (F.col("upto") >= F.col("prob") - 0.01)).alias("close"))


@query("f8_errors", f"""WITH {ATTEMPTS_CTE}, classed AS (SELECT *, {CLASS_SQL} AS outcome_class FROM attempts)
SELECT host, outcome_class, count(*) AS errors, min(us) AS first_us, max(us) AS last_us FROM classed WHERE outcome_class NOT IN ('ok', 'redirect') GROUP BY 1, 2""")
def errors(spark, sf_dir):
    return L.error_report(attempts(spark, sf_dir), "host")


@query("f8_top_errors", f"""WITH {ATTEMPTS_CTE}, classed AS (SELECT *, {CLASS_SQL} AS outcome_class FROM attempts)
SELECT host, outcome_class, count(*) AS errors FROM classed WHERE outcome_class NOT IN ('ok', 'redirect') GROUP BY 1, 2 ORDER BY errors DESC, host, outcome_class LIMIT 20""")
def top_errors(spark, sf_dir):
    report = L.error_report(attempts(spark, sf_dir), "host").select("host", "outcome_class", "errors")
    return report.orderBy(F.col("errors").desc(), "host", "outcome_class").limit(20)


@query("r6_bursts_batch", f"""WITH {ATTEMPTS_CTE}, gaps AS (
  SELECT host, us, CASE WHEN us - lag(us) OVER (PARTITION BY host ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS new FROM attempts),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT host, min(us) AS start_us, max(us) AS end_us, count(*) AS requests FROM numbered GROUP BY host, session""")
def bursts_batch(spark, sf_dir):
    """Runs of requests less than two hours apart."""
    return L.bursts(attempts(spark, sf_dir).select("host", "us"), "host", "us", gap=7200, grain=600)
