"""Bookmark exports: one JSON document per row, split in readable and quarantined ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is wrong with a quarantined export.
NOT_JSON = "not valid JSON"
NOT_OBJECT = "document is not an object"
NO_ROOTS = "required field 'roots' is missing"
ROOTS_NOT_OBJECT = "field 'roots' is not an object"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Export files as rows ``(export_id, raw)``; the id is the file path."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("export_id"), F.col("value").alias("raw")
    )


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def structure_errors(doc: Column) -> Column:
    """All structural complaints about a parsed document, joined by '; '; '' when it is fine.

    A missing ``roots`` is told from a null one by asking for the field as a variant.
    """
    roots = field(doc, "roots")
    checks = F.array(
        F.when(doc.isNull(), NOT_JSON),
        F.when(doc.isNotNull() & ~is_object(doc), NOT_OBJECT),
        F.when(is_object(doc) & roots.isNull(), NO_ROOTS),
        F.when(is_object(doc) & roots.isNotNull() & ~is_object(roots), ROOTS_NOT_OBJECT),
    )
    return F.array_join(F.array_compact(checks), "; ")


def has_keys(doc: Column, keys: list[str]) -> Column:
    """The document is an object that holds every required key."""
    found = is_object(doc)
    for key in keys:
        found = found & field(doc, key).isNotNull()
    return found


def parse_exports(raw: DataFrame) -> DataFrame:
    """Adds ``doc`` (NULL for unreadable JSON) and ``reason`` ('' for a sound document)."""
    return raw.withColumn("doc", F.try_parse_json("raw")).withColumn("reason", structure_errors(F.col("doc")))


def sound(parsed: DataFrame) -> DataFrame:
    """Documents without complaint: exactly those with an object under ``roots``, which is the cheaper test."""
    return parsed.filter(is_object(field(F.col("doc"), "roots"))).select("export_id", "doc")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason") != "").select("export_id", "reason", "raw")
