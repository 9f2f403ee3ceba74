"""Ledger tables: Parquet partitioned by run. A run is written as a whole; saving it again replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.operators.skew import salted_join
from linkatlas.session import scratch_path


def save_ledger(rows: DataFrame, path: str | None = None) -> str:
    """Write the records to the table at ``path`` (a fresh one in the shared folder when not given).

    Rows go to the files of their run; a big run is spread over many files by its URLs. A run that the table already holds
    is replaced, so a job that runs again leaves no second copy; other runs stay.
    """
    target = path or scratch_path(rows.sparkSession, "ledger")
    rows.repartition("run_id", "url").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(target)
    return target


def clear_ledger(spark: SparkSession, path: str, run_ids: DataFrame) -> str:
    """A copy of the table at ``path`` without the runs in ``run_ids(run_id)``; the table itself stays as it is. Returns the copy's path."""
    gone = run_ids.select(F.col("run_id").cast("string").alias("run_id")).distinct()
    return save_ledger(salted_join(load_ledger(spark, path), gone, ["run_id"], "left_anti", ["url"]))


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All records; run ids are text even when they look like numbers."""
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
