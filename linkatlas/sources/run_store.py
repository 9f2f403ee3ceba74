"""A store of runs in a shared folder: each step of a run counts exactly once, whatever was lost on the way.

A step writes its rows below a folder of its own attempt and then one manifest row that names the attempt. Readers go by the manifest, so
rows of an attempt that never came to its end, or that was overtaken by another one, are never seen. Only Spark reads and writes are used, so
any file system that Spark reaches will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, step string, attempt string, records bigint"


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # An empty table, where there is none yet, so that the first reader finds a folder.
        spark.createDataFrame([], MANIFEST).write.mode("ignore").partitionBy("run_id", "step").parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        """``run_id``, ``step``, ``attempt``, ``records``: the attempts that count."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").select("run_id", "step", "attempt", "records")

    def steps(self, run_id: str) -> dict[str, str]:
        """The attempt of each step that is done. A run has as many steps as its caller gave it parts."""
        return {r.step: r.attempt for r in self.manifest().filter(F.col("run_id") == run_id).select("step", "attempt").collect()}

    def path(self, table: str, run_id: str, step: str, attempt: str) -> str:
        return f"{self.root}/{table}/run_id={quote(run_id, safe='')}/step={step}/attempt={attempt}"

    def stage(self, table: str, run_id: str, step: str, rows: DataFrame) -> str:
        """Writes the rows of an attempt, which does not count yet; returns its name."""
        attempt = uuid.uuid4().hex
        rows.write.parquet(self.path(table, run_id, step, attempt))
        return attempt

    def commit(self, table: str, run_id: str, step: str, attempt: str) -> None:
        """From now on this attempt is the step's only one."""
        records = self.spark.read.parquet(self.path(table, run_id, step, attempt)).count()
        row = self.spark.createDataFrame([(attempt, records)], "attempt string, records bigint").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.root}/manifest/run_id={quote(run_id, safe='')}/step={step}")

    def once(self, table: str, run_id: str, step: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a step: made, written and committed if that was not done before, and read from where they stand."""
        attempt = self.steps(run_id).get(step)
        if attempt is None:
            attempt = self.stage(table, run_id, step, rows())
            self.commit(table, run_id, step, attempt)
        return self.spark.read.parquet(self.path(table, run_id, step, attempt))

    def rows(self, table: str, schema: str) -> DataFrame:
        """All rows of committed attempts of a table, with ``run_id`` and ``step``."""
        names = self.manifest().select("run_id", "step", "attempt")
        if names.isEmpty():
            return self.spark.createDataFrame([], f"{schema}, run_id string, step string")
        try:
            found = self.spark.read.schema(f"{schema}, run_id string, step string, attempt string").option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], f"{schema}, run_id string, step string")
        return found.join(names, ["run_id", "step", "attempt"], "left_semi").drop("attempt")
