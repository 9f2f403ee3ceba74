"""Skew-safe operators give what the plain ones give, also when one key owns most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkatlas.operators.skew import OrderedChunks, exact_quantiles, salted_join, top_per_group


def skewed(spark, n=4000):
    """Two of three rows share one key; values repeat."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).cast("bigint").alias("k"),
        F.pmod(F.hash("id"), F.lit(1000)).cast("bigint").alias("v"))


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_salted_joins(spark):
    left = skewed(spark).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("k")))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], how, ["id"], hot_rows=100)
        want = left.join(right, ["k"], how)
        assert same(got.select(*want.columns), want), how


def test_ranks_over_chunks(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    got = OrderedChunks(df, ["k"], ["v", "id"], chunks=7).row_number("rn").result()
    assert same(got.select("id", "rn"), df.select("id", F.row_number().over(w).cast("bigint").alias("rn")))


def test_running_values_over_chunks(spark):
    df = skewed(spark).withColumn("e", F.col("id") % 3)
    w = Window.partitionBy("k", "e").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = F.pmod(F.hash("v", "id"), F.lit(97)).cast("bigint")
    got = OrderedChunks(df, ["k"], ["v", "id"], chunks=7).running(x, "max", "m", ["e"]).running(x, "sum", "s", ["e"]).result()
    assert same(got.select("id", "m", "s"), df.select("id", F.max(x).over(w), F.sum(x).over(w)))


def test_top_per_group(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    got = top_per_group(df, ["k"], [F.col("v"), F.col("id")], 5, ["id"])
    assert same(got.select("id", "rn"), df.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("id", "rn"))


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = exact_quantiles(df, "k", "v", [0.0, 0.5, 0.9, 1.0])
    want = df.groupBy("k").agg(F.expr("percentile(v, array(0.0, 0.5, 0.9, 1.0))").alias("q")).select("k", F.posexplode("q"))
    a = {(r["k"], r["prob"]): round(r["quantile"], 9) for r in got.collect()}
    probs = [0.0, 0.5, 0.9, 1.0]
    assert a == {(r["k"], probs[r["pos"]]): round(r["col"], 9) for r in want.collect()}
