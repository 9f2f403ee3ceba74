"""Joins, ranks and running values that hold when one key owns a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkatlas.session import durable

KEYLESS_BUCKETS = 4096


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    hot_rows: int = 1_000_000,
    hash_build: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may be skewed and whose right side is unique, or nearly so, per key.

    Left keys of over ``hot_rows`` rows are spread over as many buckets as their own count asks for, by a hash of the
    ``spread`` columns, and only their right rows are repeated per bucket. So no bucket holds much more than ``hot_rows`` rows, and
    there are fewer such keys than one for each ``hot_rows`` rows of the left side. Keys without a value are spread too. The rows that come out are those of the plain join. ``hash_build``
    is for narrow, unique right sides: their share per task is small, so a hash table saves both sorts.
    ``sizes``, the left rows per key as ``count``, saves the pass over the keys where it is known.
    """
    counted = (left.groupBy(*on).count() if sizes is None else sizes).filter(F.col("count") > hot_rows)
    hot = counted.select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_hot"))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    fan = F.coalesce("_hot", F.when(no_key, KEYLESS_BUCKETS).otherwise(1))
    spread_left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), fan).cast("int")).drop("_hot")
    buckets = F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1)
    repeated = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(buckets)).drop("_hot")
    if hash_build:
        repeated = repeated.hint("shuffle_hash")
    return spread_left.join(repeated, [*on, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str],
                  name: str = "rn", fanout: int = 32) -> DataFrame:
    """The first ``n`` rows per group with their rank; a hot group is cut in buckets first, so that
    no task ranks more than ``fanout * n`` rows of it in the last step."""
    bucket = F.pmod(F.xxhash64(*spread), F.lit(fanout)).cast("int")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n)
    return kept.drop("_rank", "_bucket").withColumn(name, F.row_number().over(outer)).filter(F.col(name) <= n)


class OrderedChunks:
    """Rows range-partitioned by key and order, so that a key's run may span any number of tasks.

    The chunk number is fixed by a durable checkpoint. A rank or running value is first taken inside
    each chunk; what earlier chunks of the same key add is at most one carried value per chunk
    (and per extra key), which is therefore safe to broadcast.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None):
        spark = df.sparkSession
        count = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = keys, order
        ranged = df.repartitionByRange(count, *keys, *order)
        self.df = durable(ranged.withColumn("_chunk", F.spark_partition_id()))

    def _carried(self, df: DataFrame, groups: list[str], value: Column, combine) -> DataFrame:
        """Per chunk and group: the combination over all earlier chunks of the group, where there is any."""
        earlier = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        part = df.groupBy(*groups, "_chunk").agg(value.alias("_part"))
        carried = part.withColumn("_carry", combine(F.col("_part")).over(earlier)).filter(F.col("_carry").isNotNull())
        return carried.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_chunk").alias("_c"), "_carry")

    def _with_carry(self, df: DataFrame, groups: list[str], carry: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups],
                      F.col("_chunk") == F.col("_c"))
        return df.join(F.broadcast(carry), same, "left").drop("_c", *[f"_{g}" for g in groups])

    def row_number(self, name: str = "rn") -> "OrderedChunks":
        """Adds the 1-based position within the key."""
        carry = self._carried(self.df, self.keys, F.count(F.lit(1)), F.sum)
        local = Window.partitionBy("_chunk", *self.keys).orderBy(*self.order)
        numbered = self.df.withColumn("_local", F.row_number().over(local))
        total = (F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))).cast("bigint")
        self.df = self._with_carry(numbered, self.keys, carry).withColumn(name, total).drop("_local", "_carry")
        return self

    def running(self, value: Column, kind: str, name: str, extra: list[str] | None = None) -> "OrderedChunks":
        """Adds the running sum or maximum of ``value`` up to and including the row, per key and extra key.

        The extra key must have few values, since each chunk carries one value for each of them.
        """
        groups = [*self.keys, *(extra or [])]
        combine = {"sum": F.sum, "max": F.max}[kind]
        valued = self.df.withColumn("_v", value)
        carry = self._carried(valued, groups, combine("_v"), combine)
        local = (Window.partitionBy("_chunk", *groups).orderBy(*self.order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        inside = valued.withColumn("_local", combine("_v").over(local))
        joined = self._with_carry(inside, groups, carry)
        if kind == "sum":
            whole = F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))
        else:
            whole = F.greatest("_local", "_carry")
        self.df = joined.withColumn(name, whole).drop("_v", "_local", "_carry")
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_chunk")


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles per key: one row per key and probability.

    Equal values are counted first; the cumulative counts come from ``OrderedChunks``, so neither
    a hot key nor many distinct values gather in one task.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = OrderedChunks(counts, [key], [value]).running(F.col("_n"), "sum", "_upto").result()
    totals = upto.groupBy(key).agg(F.max("_upto").alias("_total"))
    wanted = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    place = F.col("prob") * (F.col("_total") - 1)
    wanted = wanted.withColumn("_lo", F.floor(place)).withColumn("_hi", F.ceil(place)).withColumn("_frac", place - F.floor(place))
    lists = wanted.groupBy(key).agg(F.collect_list(F.struct("prob", "_lo", "_hi", "_frac")).alias("_want"))
    spans = salted_join(upto.withColumn("_from", F.col("_upto") - F.col("_n")), lists, [key], "inner", [value])
    hits = spans.select(key, value, "_from", "_upto", F.explode("_want").alias("_w")).select(
        key, F.col("_w.prob").alias("prob"), F.col("_w._frac").alias("_frac"), value,
        ((F.col("_w._lo") >= F.col("_from")) & (F.col("_w._lo") < F.col("_upto"))).alias("_is_lo"),
        ((F.col("_w._hi") >= F.col("_from")) & (F.col("_w._hi") < F.col("_upto"))).alias("_is_hi"),
    ).filter(F.col("_is_lo") | F.col("_is_hi"))
    low = F.max(F.when(F.col("_is_lo"), F.col(value)))
    high = F.max(F.when(F.col("_is_hi"), F.col(value)))
    return hits.groupBy(key, "prob").agg((low + (high - low) * F.max("_frac")).alias("quantile"))
