"""Reading tables as streams and draining them into tables of the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from linkatlas.session import scratch_path


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files; the cap bounds a micro-batch, not the data.

    The last letter is written as a pattern, since a stream takes a plain path for a folder while a
    pattern may name a single file too.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings for the start of one query, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call with the same checkpoint goes on where this one ended.

    Each micro-batch overwrites its own folder, so a repeated batch leaves no second copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into a fresh table and read it, with the batch number of every row."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    drain(stream, f"{base}/rows", f"{base}/checkpoint", mode)
    return read_sink(spark, f"{base}/rows", stream.schema)


def read_sink(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """Rows of a drained stream; nothing when no batch ever ran."""
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(whole).parquet(sink)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def latest_update(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last state of every key in a table of updates."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


class Carried:
    """Tables that go from one micro-batch to the next, one folder for each batch, below ``base``.

    A batch reads what the one before it left and overwrites its own folders, so a batch that runs again after a loss comes to the same tables. The ``mark`` is the
    greatest event time seen so far less the ``delay``, in microseconds: rows at or before it come late.
    """

    def __init__(self, spark: SparkSession, base: str, delay_us: int):
        self.spark, self.base, self.delay = spark, base, delay_us

    def read(self, name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/batch={batch_id}")

    def write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch_id}")

    def mark(self, batch_id: int) -> int | None:
        row = self.read("mark", batch_id, "us bigint").first()
        return None if row is None else row[0]

    def advance(self, batch_id: int, rows: DataFrame, us: str) -> int | None:
        """The mark after a batch, written and returned."""
        before, top = self.mark(batch_id - 1), rows.agg(F.max(us)).first()[0]
        known = [x for x in (before, None if top is None else top - self.delay) if x is not None]
        after = max(known, default=None)
        self.write("mark", batch_id, self.spark.createDataFrame([(after,)], "us bigint").coalesce(1))
        return after

    def all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.base}/{name}")

    def run(self, stream: DataFrame, step) -> int:
        """Drains the stream through ``step(batch, batch_id)``; returns the number of the last batch, -1 if none ever ran."""
        (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
        try:
            return self.spark.read.schema("us bigint, batch bigint").parquet(f"{self.base}/mark").agg(F.max("batch")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
