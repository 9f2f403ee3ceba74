"""Progress documents: the JSON files in which earlier runs kept what they had done.

Two forms exist. Version 1.0 holds records, settings, a position and statistics; the form before it, without a version, holds two
plain lists of URLs. A document is parsed once, as a VARIANT, and goes by its form into three tables or into quarantine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.functions.times import iso_text
from linkatlas.operators.ledger import VERSION
from linkatlas.sources.exports import NOT_JSON, NOT_OBJECT, field, is_list, is_object

# The fields of the records, the needed ones first, and how many of them are needed.
PROCESSED = (["url", "title", "processed_at", "file_path", "folder_path", "error"], 3)
FAILED = (["url", "title", "failed_at", "error", "folder_path"], 4)
POSITION = ["folder_path", "bookmark_index", "total_in_folder"]
LISTS = {"processed_urls": ("processed", "processed_at", PROCESSED), "failed_urls": ("failed", "failed_at", FAILED)}
PLAIN, RECORDS = "plain", "records"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress files as rows ``(run_id, raw)``; the id is the file path. A file without a byte gives no row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), F.col("value").alias("raw"))


def _items(doc: Column, name: str) -> Column:
    """The entries of a list; a missing or null list is empty."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _is_record(names: list[str], needed: int) -> Callable[[Column], Column]:
    """Whether an entry is an object that has every needed field, as text, and no unknown one."""
    def test(item: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(item, "$", "map<string, variant>"))
        fits = is_object(item) & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0)
        for name in names[:needed]:
            fits = fits & field(item, name, "string").isNotNull()
        return F.coalesce(fits, F.lit(False))

    return test


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda item: F.struct(F.lit(kind).alias("outcome"), item.alias("item"))


def _complaints(doc: Column, version: Column) -> Column:
    known = is_object(doc) & (version == VERSION)
    plain = is_object(doc) & version.isNull()
    checks = [
        F.when(doc.isNull(), NOT_JSON), F.when(doc.isNotNull() & ~is_object(doc), NOT_OBJECT),
        F.when(is_object(doc) & version.isNotNull() & (version != VERSION), F.concat(F.lit("unsupported version: "), version)),
    ]
    for name, (_, _, fields) in LISTS.items():
        value = field(doc, name)
        given = value.isNotNull() & (F.schema_of_variant(value) != "VOID")
        checks.append(F.when((known | plain) & given & ~is_list(value), F.lit(f"field '{name}' is not a list")))
        checks.append(F.when(known & ~F.forall(_items(doc, name), _is_record(*fields)), F.lit(f"a record of '{name}' has wrong fields")))
        checks.append(F.when(plain & F.exists(_items(doc, name), lambda x: x.isNull() | (F.schema_of_variant(x) != "STRING")), F.lit(f"an entry of '{name}' is not text")))
    at = field(doc, "current_position")
    placed = F.lit(True)
    for name, kind in zip(POSITION, ("array<string>", "bigint", "bigint")):
        placed = placed & field(at, name, kind).isNotNull()
    checks.append(F.when(known & is_object(at) & ~placed, "field 'current_position' has wrong fields"))
    return F.array_join(F.array_compact(F.array(*checks)), "; ")


def parse_progress(raw: DataFrame) -> DataFrame:
    """``raw(run_id, raw)`` with ``doc``, ``form`` (records, plain) and ``reason``: all complaints joined by '; ', '' for a sound document.

    A document with one bad record is turned away whole, as a ledger that lacks records would have links done again. An empty
    text or table is no error: it gives quarantine rows or none.
    """
    parsed = raw.withColumn("doc", F.try_parse_json("raw"))
    version = field(F.col("doc"), "version", "string")
    return parsed.withColumn("form", F.when(version.isNull(), PLAIN).otherwise(RECORDS)).withColumn("reason", _complaints(F.col("doc"), version))


def sound_progress(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason") == "").select("run_id", "form", "doc")


def quarantined_progress(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason") != "").select("run_id", "reason", "raw")


def progress_runs(sound: DataFrame) -> DataFrame:
    """One row per document: version, source, settings, time of saving and the statistics it held. The older form has none but the time."""
    doc = F.col("doc")
    stats = field(doc, "statistics")
    return sound.select(
        "run_id", "form", field(doc, "version", "string").alias("version"), field(doc, "bookmarks_file", "string").alias("source"),
        field(doc, "config_hash", "string").alias("config_hash"), field(doc, "timestamp", "string").cast("timestamp_ntz").alias("saved_at"),
        *[field(stats, n, "bigint").alias(n) for n in ("total_bookmarks", "processed_count", "failed_count", "skipped_count")])


def progress_ledger(sound: DataFrame) -> DataFrame:
    """The ledger rows of sound documents. In the older form a record is a URL alone: its time is that of the document, title and error are null.

    Both lists are exploded in one go, so the document is read once.
    """
    doc, saved = F.col("doc"), field(F.col("doc"), "timestamp", "string")
    empty = F.lit(None).cast("variant")
    tagged = F.concat(*[F.transform(_items(doc, name), _tagged(kind)) for name, (kind, _, _) in LISTS.items()])
    rows = sound.select("run_id", "form", saved.alias("saved"), F.explode(tagged).alias("r")).select("run_id", "form", "saved", "r.outcome", "r.item")
    item = F.when(F.col("form") == RECORDS, F.col("item")).otherwise(empty)
    at = F.coalesce(field(item, "processed_at", "string"), field(item, "failed_at", "string"), F.col("saved"))
    url = F.when(F.col("form") == RECORDS, field(item, "url", "string")).otherwise(F.try_variant_get("item", "$", "string"))
    return rows.select(
        "run_id", url.alias("url"), field(item, "title", "string").alias("title"), at.cast("timestamp_ntz").alias("ts"), "outcome",
        field(item, "file_path", "string").alias("file_path"), field(item, "folder_path", "array<string>").alias("folder_path"),
        field(item, "error", "string").alias("error"))


def progress_cursors(sound: DataFrame) -> DataFrame:
    """``run_id``, ``cursor_path``, ``place``, ``total_in_folder``: where each run was when its document was saved; see ``operators.ledger.behind_cursors``."""
    at = field(F.col("doc"), "current_position")
    return sound.filter(is_object(at)).select(
        "run_id", field(at, "folder_path", "array<string>").alias("cursor_path"), field(at, "bookmark_index", "bigint").alias("place"),
        field(at, "total_in_folder", "bigint").alias("total_in_folder"))


def progress_documents(ledger: DataFrame, runs: DataFrame, cursors: DataFrame | None = None, records: int = 100_000) -> DataFrame:
    """Documents of version 1.0 for the runs of a ledger: ``run_id``, ``part`` (from 0), ``raw``.

    A run with over ``records`` records is dealt by URL over several documents, so that no document outgrows a row; each bears the run's settings. The
    position goes into part 0. ``runs(run_id, version, source, config_hash, saved_at)`` is unique by run.
    """
    counted = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    told = runs.join(counted, "run_id", "left").withColumn("_parts", F.greatest(F.ceil(F.coalesce("_n", F.lit(0)) / records), F.lit(1)).cast("int"))
    names = {f.name for f in ledger.schema}
    column = lambda n, t: F.col(n) if n in names else F.lit(None).cast(t)
    when = iso_text(F.col("ts"))
    done = F.struct(F.col("url"), F.col("title"), when.alias("processed_at"), column("file_path", "string").alias("file_path"),
                    column("folder_path", "array<string>").alias("folder_path"), F.col("error"))
    lost = F.struct(F.col("url"), F.col("title"), when.alias("failed_at"), F.coalesce("error", F.lit("")).alias("error"), column("folder_path", "array<string>").alias("folder_path"))
    # The parts of a run are few and known, so the records are dealt without a join: every one has its own part number from the run's count.
    dealt = ledger.join(told.select("run_id", "_parts"), "run_id").withColumn("part", F.pmod(F.xxhash64("url"), F.col("_parts")).cast("int"))
    lists = dealt.groupBy("run_id", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "processed", done))).alias("processed_urls"),
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", lost))).alias("failed_urls"))
    every = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    if cursors is not None:
        place = F.struct(F.col("cursor_path").alias("folder_path"), F.col("place").alias("bookmark_index"), F.col("total_in_folder"))
        every = every.join(cursors.select("run_id", F.lit(0).alias("part"), place.alias("current_position")), ["run_id", "part"], "left")
    both = every.join(lists, ["run_id", "part"], "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    stats = F.struct((size("processed_urls") + size("failed_urls")).alias("total_bookmarks"), size("processed_urls").alias("processed_count"),
                     size("failed_urls").alias("failed_count"), F.lit(0).alias("skipped_count"))
    fields = [F.col("version"), iso_text(F.col("saved_at")).alias("timestamp"), F.col("source").alias("bookmarks_file"), F.col("config_hash"),
              F.coalesce("processed_urls", F.array()).alias("processed_urls"), F.coalesce("failed_urls", F.array()).alias("failed_urls"), stats.alias("statistics")]
    if cursors is not None:
        fields.append(F.col("current_position"))
    return both.select("run_id", "part", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("raw"))
