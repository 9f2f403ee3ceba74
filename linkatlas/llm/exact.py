"""Exact de-duplication by a content sort, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is used where it can touch nothing else: on texts of one-byte characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sorted_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                  partitions: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the decision about each row in the struct ``_copy``:
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are range-partitioned by the bytes of their normalised text: Spark samples the splitters and sorts
    each range externally. Splitters are taken from the first 32 bytes and a 64-bit digest, so that the sample on the driver stays
    small and texts of one long common beginning still spread; the sort goes over the whole text. Equal texts lie next
    to each other, and the window compares whole neighbouring texts. A text with more copies than a partition's
    mean share is counted first (fewer such texts than partitions can exist, which bounds the broadcast),
    and its rows spread over as many chunks as that count asks for.

    ``keep`` names the row that stays: the ``smallest`` or the ``largest`` id. A null text counts as empty. A null id
    loses to any other id; if all ids are null, ``keep_id`` is null. Of rows that repeat the winning id exactly one stays.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = {"smallest": F.min, "largest": F.max}[keep]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    norm = ascii_lower(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(own).select("_row", F.col(f"_row.`{id_col}`").alias("_id"), F.unhex(F.sha2(norm, 256)).alias("_sha"),
                                   F.substring(F.encode(norm, "UTF-8"), 1, 32).alias("_head"))
    # Counting needs no text once it is hashed, and a count over Parquet none of its columns.
    share = F.lit(max(1, docs.count() // n))
    hot = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_best")).filter(F.col("_n") > share)
    spread = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / share))
    dealt = rows.join(F.broadcast(hot), "_sha", "left").withColumn("_chunk", F.coalesce(spread, F.lit(0)).cast("int"))
    keys = ["_head", "_digest", "_chunk", "_norm"]
    ranged = dealt.withColumn("_digest", F.xxhash64("_sha")).repartitionByRange(n, *keys[:3]).withColumn("_norm", norm)
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    ordered = Window.partitionBy(*keys).orderBy(order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = (ranged.withColumn("_at", F.row_number().over(ordered)).withColumn("_first", F.first("_id").over(whole))
            .withColumn("_local", F.count(F.lit(1)).over(whole)))
    keep_id = F.when(F.col("_n").isNull(), F.col("_first")).otherwise(F.col("_best"))
    wins = (F.col("_at") == 1) & F.col("_id").eqNullSafe(keep_id)
    copy = F.struct(keep_id.alias("keep_id"), F.coalesce("_n", "_local").cast("bigint").alias("group_size"),
                    wins.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    return seen.select("_row.*", copy.alias("_copy"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; see ``sorted_copies``."""
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return sorted_copies(small, "doc_id", "text", keep).select("doc_id", "_copy.*")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the copies, with its own columns."""
    return sorted_copies(docs, id_col, text_col, keep).filter("_copy.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
