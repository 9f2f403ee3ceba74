"""Documents: front matter, body, output folders and collision-free paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.functions.text import document_file, output_folder, path_name
from linkatlas.operators.skew import OrderedChunks

# Fixed value: the label of the source line.
SOURCE_LABEL = "Источник"


def yaml_scalar(c: Column) -> Column:
    """Double-quoted YAML scalar; other characters are kept as they are."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def iso_short(ts: Column) -> Column:
    """ISO time with the fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def front_matter(url: Column, title: Column, fetched: Column, status: Column) -> Column:
    """Four keys in alphabetical order, one per line."""
    fields = {"date_processed": iso_short(fetched), "status": status, "title": title, "url": url}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), yaml_scalar(v)) for k, v in sorted(fields.items())])


def markdown(url: Column, title: Column, summary: Column, front: Column | None = None, label: str = SOURCE_LABEL) -> Column:
    """Body of a document; an empty summary takes no lines."""
    head = [] if front is None else [F.lit("---\n"), front, F.lit("\n---\n\n")]
    middle = F.when(F.coalesce(summary, F.lit("")) == "", "").otherwise(F.concat(summary, F.lit("\n\n")))
    return F.concat(*head, F.lit("# "), title, F.lit("\n\n"), middle, F.lit(f"---\n{label}: "), url)


def output_folders(nodes: DataFrame, base: str) -> DataFrame:
    """Sanitised path of every folder. A path is a fold over the names above, so no join is needed."""
    return nodes.filter(F.col("kind") == "folder").select(
        "export_id", "node_key", "depth", output_folder(F.col("folder_path"), base).alias("path"))


def document_paths(bookmarks: DataFrame, base: str) -> DataFrame:
    """Path of every bookmark's document, no two alike. Equal paths in one export get ``_2``, ``_3`` and on in processing order. Where such a
    name is taken by another bookmark's own title, or goes over the byte budget, a hash of the bookmark's key names the document.

    The numbering runs over ``OrderedChunks``, as many bookmarks may share one title and folder.
    """
    folder = F.concat(F.lit(base), F.lit("/"), "export_id")
    located = bookmarks.withColumn("_folder", F.aggregate(
        "folder_path", folder, lambda path, name: _step(path, name))).withColumn(
        "_path", document_file(F.col("title"), F.col("_folder")))
    numbered = OrderedChunks(located, ["_path"], ["node_key"]).row_number("_copy").result()
    stem = F.regexp_replace("_path", r"\.md\z", "")
    path = F.when(F.col("_copy") == 1, F.col("_path")).otherwise(F.concat(stem, F.lit("_"), F.col("_copy").cast("string"), F.lit(".md")))
    told = OrderedChunks(numbered.withColumn("_named", path), ["_named"], ["_copy", "node_key"]).row_number("_again").result()
    hashed = F.concat("_folder", F.lit("/item_"), F.left(F.md5(F.concat_ws("/", "export_id", "node_key")), F.lit(16)), F.lit(".md"))
    over = (F.col("_copy") > 1) & (F.octet_length("_named") > 250)
    return told.withColumn("path", F.when((F.col("_again") > 1) | over, hashed).otherwise(F.col("_named"))).drop(
        "_folder", "_path", "_copy", "_named", "_again")


def _step(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("/"), path_name(name, path, 255, True))
