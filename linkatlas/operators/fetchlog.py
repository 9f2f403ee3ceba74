"""Analytics over the log of fetch attempts ``(url keys, attempt, ts, us, status, location, bytes, error)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkatlas.functions.urls import MEGABYTE
from linkatlas.operators.skew import OrderedChunks, salted_join
from linkatlas.session import durable

# Limits of the fetcher.
SIZE_LIMIT_MB = 5.0
RETRIES = 3
RETRY_DELAY = 1.5
MAX_REDIRECTS = 5
QUOTA = 3
WINDOW_SECONDS = 60

OK, TOO_LARGE, GONE, REDIRECT, LOST_REDIRECT, RETRY = "ok", "too_large", "gone", "redirect", "redirect_without_target", "retry"
TERMINAL = [OK, TOO_LARGE, GONE, LOST_REDIRECT]


def outcome_class(status: Column, location: Column, n_bytes: Column, limit_mb: float = SIZE_LIMIT_MB,
                  in_chain: bool = False) -> Column:
    """What one response means. NULL status is a transport error.

    A redirect without a target ends the fetch as a first response, but is tried again inside a chain.
    """
    big = n_bytes / F.lit(float(MEGABYTE)) > F.lit(float(limit_mb))
    return (
        F.when((status == 200) & big, TOO_LARGE)
        .when(status == 200, OK)
        .when(status.isin(404, 410), GONE)
        .when(status.isin(301, 302) & (F.coalesce(location, F.lit("")) != ""), REDIRECT)
        .when(status.isin(301, 302), RETRY if in_chain else LOST_REDIRECT)
        .otherwise(RETRY)
    )


def classified(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("outcome_class", outcome_class(F.col("status"), F.col("location"), F.col("bytes")))


def final_outcomes(attempts: DataFrame, keys: list[str], retries: int = RETRIES) -> DataFrame:
    """Final outcome per fetch: the first terminal class within ``retries + 1`` attempts, else the last error.

    One grouping with partial aggregation. Attempts are numbered in the log, so no rank is needed and
    a fetch that was logged very often is reduced before the shuffle.
    """
    seen = classified(attempts).filter(F.col("attempt") <= retries)
    place = F.struct("attempt", "us")
    ends = F.col("outcome_class").isin(TERMINAL)
    found = F.min_by(F.when(ends, F.col("outcome_class")), F.when(ends, place))
    last = F.max_by(F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status").cast("string"))), place)
    first_end = F.min(F.when(ends, F.col("attempt")))
    return seen.groupBy(*keys).agg(
        found.alias("_found"), first_end.alias("_end"), F.max("attempt").alias("_last"), last.alias("_error"),
        F.max("us").alias("us"), F.max("ts").alias("ts"),
    ).select(
        *keys,
        F.coalesce("_found", F.lit("retries_exhausted")).alias("final_class"),
        (F.coalesce("_end", "_last") + 1).cast("int").alias("tries"),
        F.when(F.col("_found") == OK, "processed").otherwise("failed").alias("outcome"),
        F.when(F.col("_found").isNull(), F.col("_error")).when(F.col("_found") != OK, F.col("_found")).alias("error"),
        "ts", "us",
    )


def backoff_seconds(attempt: Column, delay: float = RETRY_DELAY, factor: float = 2.0) -> Column:
    """Wait after attempt number ``attempt`` (0-based)."""
    return F.lit(float(delay)) * F.pow(F.lit(float(factor)), attempt)


def backoff_schedule(starts: DataFrame, us: str = "us", retries: int = RETRIES, delay: float = RETRY_DELAY,
                     factor: float = 2.0) -> DataFrame:
    """For every first attempt, the earliest times of the retries. The waits sum up in closed form."""
    k = F.col("retry")
    total = reduce(lambda a, b: a + b, [F.when(k > i, float(delay) * float(factor) ** i).otherwise(0.0) for i in range(retries)])
    return (
        starts.withColumn("retry", F.explode(F.sequence(F.lit(1), F.lit(retries))))
        .withColumn("wait", backoff_seconds(k - 1, delay, factor))
        .withColumn("earliest_us", F.col(us) + F.round(total * 1e6).cast("bigint"))
    )


def backoff_gaps(attempts: DataFrame, keys: list[str], delay: float = RETRY_DELAY, factor: float = 2.0) -> DataFrame:
    """Observed gap before each attempt against the wait that was due.

    Every attempt also tells its time to the number after it; one grouping by attempt then brings the two
    times together, without ordering the attempts of a fetch.
    """
    narrow = attempts.select(*keys, "attempt", "us")
    pair = narrow.withColumn("_prev_us", F.lit(None).cast("bigint")).unionByName(
        narrow.select(*keys, (F.col("attempt") + 1).alias("attempt"), F.lit(None).cast("bigint").alias("us"), F.col("us").alias("_prev_us"))
    )
    joined = pair.groupBy(*keys, "attempt").agg(F.max("us").alias("us"), F.max("_prev_us").alias("_prev_us")).filter(
        F.col("us").isNotNull()
    )
    gap = (F.col("us") - F.col("_prev_us")) / F.lit(1e6)
    due = F.when(F.col("attempt") > 0, backoff_seconds(F.col("attempt") - 1, delay, factor))
    return joined.select(*keys, "attempt", gap.alias("gap"), due.alias("due"), (gap >= due).alias("kept"))


def resolve_redirects(redirects: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """Follow ``(src, dst)`` edges, ``dst`` NULL for a page that answers itself.

    Result ``(src, final, hops, resolved)``; unknown targets end a chain as they have no edge on. The first
    redirect is free, then at most ``max_redirects`` responses are read, as a fetcher does; a chain, or a
    loop, that still redirects then is unresolved. Each hop is one join; a target that many chains
    share is salted, and only unfinished chains go on.
    """
    edges = redirects.filter(F.col("dst").isNotNull()).select(F.col("src").alias("at"), F.col("dst").alias("next"))
    own = redirects.filter(F.col("dst").isNull()).select(
        "src", F.col("src").alias("final"), F.lit(0).alias("hops"), F.lit(True).alias("resolved"))
    results, open_chains = [own], redirects.filter(F.col("dst").isNotNull()).select("src", F.col("dst").alias("at"))
    for hop in range(1, max_redirects + 1):
        step = durable(salted_join(open_chains, edges, ["at"], "left", ["src"]))
        results.append(step.filter(F.col("next").isNull()).select(
            "src", F.col("at").alias("final"), F.lit(hop).alias("hops"), F.lit(True).alias("resolved")))
        open_chains = step.filter(F.col("next").isNotNull()).select("src", F.col("next").alias("at"))
    results.append(open_chains.select(
        "src", F.lit(None).cast("string").alias("final"), F.lit(max_redirects).alias("hops"), F.lit(False).alias("resolved")))
    return reduce(DataFrame.unionByName, results)


def admissions(requests: DataFrame, key: str, us: str, tie: str, quota: int = QUOTA,
               window: int = WINDOW_SECONDS, first: str | None = None) -> DataFrame:
    """Admission time of every request under ``quota`` per sliding ``window`` seconds and key, in order of arrival.

    The rule a_i = max(t_i, a_(i-quota) + window) solves to a running maximum: with i the 0-based place,
    b = i div quota, a_i = window*b + max(t_j - window*b_j) over earlier j with the same i mod quota.
    Place and maximum come from ``OrderedChunks``, so a single busy key still uses the whole cluster. ``first`` names a column that comes
    before the time in the order, for rows that stand for earlier admissions.
    """
    if quota <= 0:
        return requests.withColumn("admitted_us", F.col(us))
    span = window * 1_000_000
    chunks = OrderedChunks(requests, [key], [*([first] if first else []), us, tie]).row_number("_n")
    chunks.df = chunks.df.withColumn("_slot", (F.col("_n") - 1) % quota).withColumn(
        "_block", F.floor((F.col("_n") - 1) / quota).cast("bigint"))
    chunks.running(F.col(us) - F.col("_block") * span, "max", "_lead", ["_slot"])
    return chunks.result().withColumn("admitted_us", F.col("_lead") + F.col("_block") * span).drop("_n", "_slot", "_block", "_lead")


def trailing_load(requests: DataFrame, key: str, us: str, window: int = WINDOW_SECONDS, quota: int = QUOTA) -> DataFrame:
    """Requests of the key in the ``window`` seconds up to each arrival time, and whether that is over the quota.

    Arrivals are counted per time first. A frame never reaches back more than one window, so time is cut into
    buckets of that length; every bucket also gets the rows of the one before, and a bucket of one key is all
    that a task must hold. One row per key and arrival time.
    """
    span = window * 1_000_000
    counts = requests.groupBy(key, us).agg(F.count(F.lit(1)).alias("requests")).withColumn("_bucket", F.floor(F.col(us) / span))
    again = F.explode(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("own")),
                              F.struct((F.col("_bucket") + 1).alias("b"), F.lit(False).alias("own"))))
    spread = counts.withColumn("_copy", again).select(key, us, "requests", F.col("_copy.b").alias("_bucket"), F.col("_copy.own").alias("_own"))
    frame = Window.partitionBy(key, "_bucket").orderBy(us).rangeBetween(-(span - 1), 0)
    return (
        spread.withColumn("load", F.sum("requests").over(frame)).filter("_own").drop("_bucket", "_own")
        .withColumn("over_quota", F.col("load") > quota)
    )


def duration_sketches(requests: DataFrame, keys: list[str], us: str, value: str, size: int = 400) -> DataFrame:
    """A quantile sketch for each key and hour: ``hour`` (from 1970), ``sketch``, ``n``. Sketches are a few kilobytes each and partially aggregated, so the table
    is kept in place of the requests, and any roll-up is a merge of its rows. Null values count nowhere."""
    hour = F.floor(F.col(us) / 3_600_000_000).alias("hour")
    return requests.filter(F.col(value).isNotNull()).groupBy(*keys, hour).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def sketched_quantiles(sketches: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Estimated quantiles of a roll-up of ``duration_sketches``: ``prob``, ``quantile``, ``n``. The share of values up to an estimate differs from ``prob`` by about one over
    the sketch size, whatever the number of rows; with the size 400, by less than one in a hundred."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    each = [F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs]
    return merged.select(*by, F.inline(F.array(*each)), "n").select(*by, "prob", "quantile", "n")


def error_report(attempts: DataFrame, key: str) -> DataFrame:
    """Failed attempts by key and class, with the first and last time."""
    bad = classified(attempts).filter(~F.col("outcome_class").isin(OK, REDIRECT))
    return bad.groupBy(key, "outcome_class").agg(
        F.count(F.lit(1)).cast("bigint").alias("errors"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def bursts(requests: DataFrame, key: str, us: str, gap: int = 600, grain: int = 60) -> DataFrame:
    """Activity sessions per key: runs of requests less than ``gap`` seconds apart.

    Requests of one grain always share a session, so they are reduced to one row per key and grain
    before any ordering; the order over those rows comes from ``OrderedChunks``.
    """
    if grain >= gap:
        raise ValueError("the grain must be shorter than the gap")
    grains = requests.groupBy(key, F.floor(F.col(us) / (grain * 1_000_000)).alias("grain")).agg(
        F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n"))
    chunks = OrderedChunks(grains, [key], ["grain"])
    # The end of the activity before a row is the running maximum of `hi`, taken one row back.
    chunks.running(F.col("hi"), "max", "_reach")
    place = chunks.row_number("_i").result()
    before = place.select(F.col(key).alias("_k"), (F.col("_i") + 1).alias("_j"), F.col("_reach").alias("_prev"))
    linked = place.join(before, (F.col(key) == F.col("_k")) & (F.col("_i") == F.col("_j")), "left").drop("_k", "_j")
    starts = F.when(F.col("_prev").isNull() | (F.col("lo") - F.col("_prev") >= gap * 1_000_000), 1).otherwise(0)
    numbered = OrderedChunks(linked.withColumn("_new", starts), [key], ["grain"]).running(F.col("_new"), "sum", "session").result()
    return numbered.groupBy(key, "session").agg(
        F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").cast("bigint").alias("requests")).drop("session")
