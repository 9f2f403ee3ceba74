"""Run ledger: which links are done, which failed, what a run must do.

Ledger rows ``(run_id, url, title, ts, outcome, file_path, folder_path, error)`` are only ever appended;
``latest_state`` says what holds now.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkatlas.operators.skew import OrderedChunks, salted_join

# The ledger version and the name of a removed record.
VERSION = "1.0"
REMOVED = "removed"


def _json_scalar(c: Column, kind: str) -> Column:
    """JSON text of a scalar, in the spelling with ASCII escapes the stored fingerprints were made with."""
    if kind == "text":
        plain = F.to_json(F.struct(c.alias("v")))
        body = F.substring(plain, F.lit(6), F.char_length(plain) - 6)
        return _ascii_escaped(body)
    return _plain_number(c.cast("string")) if kind == "number" else c.cast("string")


def _plain_number(text: Column) -> Column:
    """A number in the spelling of the stored fingerprints: digits between 1e-4 and 1e16, else a bare exponent of two digits at least.
    Spark's own text of a double has a point and an ``E`` below 1e-3 and from 1e7 on; its digits are the same."""
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), "^-", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    power = F.when(F.contains(text, F.lit("E")), F.split_part(text, F.lit("E"), F.lit(2)).cast("int"))
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    rest = F.substr(whole, power + 2)
    large = F.concat(F.substr(whole, F.lit(1), power + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    bare = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return F.when(power.isNull(), text).otherwise(F.concat(sign, F.when((power >= -4) & (power < 0), small).when((power >= 0) & (power < 16), large).otherwise(bare)))


def _ascii_escaped(body: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX, one such unit per UTF-16 unit."""
    def escape(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when(F.octet_length(ch) == 1, ch).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    spelled = F.array_join(F.transform(F.split(body, ""), escape), "")
    return F.when(F.octet_length(body) == F.char_length(body), body).otherwise(spelled)


def settings_hash(model: Column, max_tokens: Column, temperature: Column, output_dir: Column,
                  metadata: Column, diagram: Column) -> Column:
    """Fingerprint of the six settings a ledger depends on: SHA-256 of their JSON with sorted keys."""
    fields = {
        "generate_mermaid_diagram": (diagram, "flag"), "llm_max_tokens": (max_tokens, "number"),
        "llm_model": (model, "text"), "llm_temperature": (temperature, "number"),
        "markdown_include_metadata": (metadata, "flag"), "output_dir": (output_dir, "text"),
    }
    parts = [F.concat(F.lit(f"{json.dumps(name)}: "), _json_scalar(c, kind)) for name, (c, kind) in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}")), 256)


def compatible(ledger: DataFrame, runs: DataFrame, source: str, config_hash: str) -> DataFrame:
    """Rows of runs with the right version, source and settings; a ledger of other runs counts as empty.

    The wanted runs are unique by id; the ledger may hold most of its rows in one run.
    """
    wanted = runs.filter(
        (F.col("version") == VERSION) & (F.col("source") == source) & (F.col("config_hash") == config_hash)
    ).select("run_id").distinct()
    return salted_join(ledger, wanted, ["run_id"], "left_semi", ["url", "ts"])


def is_done(outcome: Column, error: Column) -> Column:
    return (outcome == "processed") & error.isNull()


def is_error(outcome: Column, error: Column) -> Column:
    return (outcome == "failed") | ((outcome == "processed") & error.isNotNull())


def done_urls(ledger: DataFrame) -> DataFrame:
    """URLs processed without an error."""
    return ledger.filter(is_done(F.col("outcome"), F.col("error"))).select("url").distinct()


def failed_urls(ledger: DataFrame, with_processed_errors: bool = True) -> DataFrame:
    """URLs that failed, with those processed but carrying an error when asked."""
    failed = ledger.filter(F.col("outcome") == "failed").select("url")
    if with_processed_errors:
        failed = failed.union(ledger.filter((F.col("outcome") == "processed") & F.col("error").isNotNull()).select("url"))
    return failed.distinct()


def first_per_url(bookmarks: DataFrame) -> DataFrame:
    """The first bookmark of each URL in processing order, over all exports.

    An aggregate, not a window: copies of a hot URL are reduced before the shuffle.
    """
    order = F.struct("export_id", "node_key")
    rest = [c for c in bookmarks.columns if c != "url"]
    best = bookmarks.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("first"), F.count(F.lit(1)).cast("bigint").alias("copies"))
    return best.select("url", "first.*", "copies")


def latest_state(ledger: DataFrame) -> DataFrame:
    """The record that holds now for each URL: the one with the latest time. Removed ones are left out."""
    rest = [c for c in ledger.columns if c != "url"]
    order = F.struct("ts", "run_id", "outcome")
    state = ledger.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("last"))
    return state.select("url", "last.*").filter(F.col("outcome") != REMOVED)


def resolve_failures(ledger: DataFrame, repaired: DataFrame) -> DataFrame:
    """Upsert of repaired links: whatever held before, they are processed clean from now on."""
    return latest_state(append_records(ledger, repaired))


def remove_records(ledger: DataFrame, urls: DataFrame, ts: Column) -> DataFrame:
    """Forget links, by tombstones appended at the time ``ts`` of the removal; a link that is recorded later is there again."""
    names = {f.name: f.dataType for f in ledger.schema}
    tombs = urls.select("url").distinct().select(*[
        F.col("url") if n == "url" else F.lit(REMOVED).alias(n) if n == "outcome" else ts.cast(t).alias(n) if n == "ts"
        else F.lit("~").alias(n) if n == "run_id" else F.lit(None).cast(t).alias(n)
        for n, t in names.items()
    ])
    return append_records(ledger, tombs)


def append_records(ledger: DataFrame, records: DataFrame) -> DataFrame:
    return ledger.unionByName(records, allowMissingColumns=True)


def before_cursor(folder_path: Column, ordinal: Column, cursor: tuple[list[str], int], suffix: bool = False) -> Column:
    """Bookmarks that a resumed run has behind it: earlier places in the cursor's own folder.

    The place at the cursor is redone. With ``suffix`` every folder whose path ends like the cursor's counts.
    """
    path, index = cursor
    want = F.array(*[F.lit(p) for p in path])
    same = folder_path == want
    if suffix:
        same = same | ((F.size(folder_path) >= len(path)) & (F.slice(folder_path, F.greatest(F.size(folder_path) - len(path) + 1, F.lit(1)), F.lit(len(path))) == want))
    return same & (ordinal < index)


def behind_cursors(bookmarks: DataFrame, cursors: DataFrame, suffix: bool = True) -> DataFrame:
    """``run_id``, ``export_id``, ``node_key``: the bookmarks that each run with a stored cursor has behind it.

    ``cursors(run_id, cursor_path, place)`` may hold any number of runs. A bookmark stands behind a cursor in a folder whose path is the cursor's, or with
    ``suffix`` ends like it, at an ordinal below the place; the place itself is redone. Folder endings are only made in lengths that some cursor
    has; they are met by hash and compared whole. A cursor with an empty or null path, or no place, has nothing behind it.
    """
    known = cursors.filter((F.size("cursor_path") > 0) & F.col("place").isNotNull()).select("run_id", "cursor_path", "place")
    # Lengths of paths: as many numbers as folders are deep.
    lengths = sorted(r[0] for r in known.select(F.size("cursor_path")).distinct().collect())
    path = F.col("folder_path")
    if suffix:
        tails = [F.when(F.size(path) >= n, F.slice(path, F.greatest(F.size(path) - n + 1, F.lit(1)), n)) for n in lengths]
        ends = F.array_compact(F.array(*tails)) if tails else F.array().cast("array<array<string>>")
    else:
        ends = F.array(path)
    met = bookmarks.select("export_id", "node_key", "ordinal", F.explode(ends).alias("_tail")).withColumn("_end", F.xxhash64("_tail"))
    right = known.withColumn("_end", F.xxhash64("cursor_path"))
    found = salted_join(met, right, ["_end"], "inner", ["export_id", "node_key"])
    return found.filter((F.col("_tail") == F.col("cursor_path")) & (F.col("ordinal") < F.col("place"))).select("run_id", "export_id", "node_key").distinct()


def url_states(ledger: DataFrame) -> DataFrame:
    """One row per URL with the three facts the decision needs."""
    def ever(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    outcome, error = F.col("outcome"), F.col("error")
    return ledger.groupBy("url").agg(
        ever(is_done(outcome, error)).alias("done"), ever(outcome == "failed").alias("failed"),
        ever(is_error(outcome, error)).alias("erroneous"))


MODES = ("normal", "resume", "check_error")


def plan_run(bookmarks: DataFrame, ledger: DataFrame, mode: str = "normal", dry_run: bool = False,
             cursor: tuple[list[str], int] | DataFrame | None = None, suffix: bool = True) -> DataFrame:
    """Adds ``decision`` to every bookmark; a plan only, nothing is fetched or written.

    process, skip_done, skip_failed, skip_position or skip_not_error. One join with the per-URL states. The cursor is a place, or a table
    of stored cursors as ``behind_cursors`` takes it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if isinstance(cursor, DataFrame):
        keys = ["export_id", "node_key"]
        behind = behind_cursors(bookmarks, cursor, suffix).select(*keys).distinct().withColumn("_passed", F.lit(True))
        bookmarks = bookmarks.join(behind, keys, "left")
    known = salted_join(bookmarks, url_states(ledger), ["url"], "left", ["export_id", "node_key"], hash_build=True)

    def is_true(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    if isinstance(cursor, DataFrame):
        passed = is_true("_passed")
    else:
        passed = before_cursor(F.col("folder_path"), F.col("ordinal"), cursor, suffix) if cursor else F.lit(False)
    if mode == "check_error":
        decision = F.when(~is_true("erroneous"), "skip_not_error")
        decision = decision.when(passed, "skip_position") if dry_run else decision
    else:
        retry = mode == "resume" and not dry_run
        done = F.when(is_true("done"), "skip_done") if dry_run else F.when(passed, "skip_position").when(is_true("done"), "skip_done")
        decision = done if retry else done.when(is_true("failed"), "skip_failed")
        decision = decision.when(passed, "skip_position") if dry_run else decision
    return known.withColumn("decision", decision.otherwise("process")).drop("done", "failed", "erroneous", "_passed")


def run_statistics(ledger: DataFrame) -> DataFrame:
    """Per run: rows and distinct links by outcome, first and last time.

    Distinct links come from a first grouping by run and URL, so that no set is gathered per run.
    """
    def flag(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")

    outcome, error = F.col("outcome"), F.col("error")
    per_url = ledger.groupBy("run_id", "url").agg(
        F.count(F.lit(1)).alias("n"), flag(outcome == "processed").alias("p"), flag(outcome == "failed").alias("f"),
        flag((outcome == "processed") & error.isNotNull()).alias("e"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    total = lambda c: F.sum(c).cast("bigint")
    return per_url.groupBy("run_id").agg(
        total("n").alias("records"), total("p").alias("processed"), total("f").alias("failed"),
        total("e").alias("processed_with_error"), F.count(F.lit(1)).cast("bigint").alias("links"),
        flag(F.col("p") > 0).alias("links_processed"), flag(F.col("f") > 0).alias("links_failed"),
        F.min("lo").alias("start_ts"), F.max("hi").alias("last_ts"))


def percentage(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(done * F.lit(100.0) / F.nullif(total, F.lit(0)))


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the pace so far, NULL before anything is done or while no time has passed."""
    rate = F.when((done > 0) & (elapsed > 0), done / elapsed)
    return (total - done) / rate


def progress(ledger: DataFrame, by: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """How far each run was at each record: share done, elapsed seconds and the estimate for the rest."""
    chunks = OrderedChunks(ledger, [by], order or ["us", "url"]).row_number("done").result()
    totals = ledger.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.min("us").alias("start_us"))
    told = salted_join(chunks, totals, [by], "inner", ["us", "url"], sizes=totals.select(by, F.col("total").alias("count")))
    elapsed = (F.col("us") - F.col("start_us")) / F.lit(1e6)
    return (
        told.withColumn("percent", percentage(F.col("done"), F.col("total")))
        .withColumn("elapsed", elapsed)
        .withColumn("eta", remaining_seconds(F.col("done"), F.col("total"), F.col("elapsed")))
        .drop("start_us")
    )
