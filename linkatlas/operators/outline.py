"""Capped outlines of folder trees: visible rows, ids, edges and the text.

Needs ``nodes`` whose ordinals are dense per parent and kind, as the flatten makes them. A folder's rank
among its siblings is then its ordinal, and a bookmark's is its ordinal after the number of sub-folders,
so that who is over the cap is read off the key and no large folder is ever ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.functions.text import sanitize_label
from linkatlas.operators.skew import top_per_group
from linkatlas.operators.tree import child_counts, outline_key

# Caps and the texts of the synthetic rows.
MAX_CHILDREN = 50
MAX_NODES = 1000
LABEL_LIMIT = 60
OVERFLOW_TEXT = "... и {omitted} еще"
LIMIT_TEXT = "Диаграмма обрезана: достигнут предел {max_nodes} узлов"
HEADER = "graph TD"
LIMIT_ID = "limit_reached"


def _within(node_key: Column, n: int) -> Column:
    """Every step of the key is below the cap; necessary for any visible row, sufficient for folders."""
    steps = F.slice(F.split(node_key, "/"), F.lit(2), F.size(F.split(node_key, "/")))
    return F.forall(steps, lambda s: F.substring(s, F.lit(2), F.length(s)).cast("bigint") < n)


def _fill(template: str, name: str, value: Column) -> Column:
    head, tail = template.split("{" + name + "}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def top_children(nodes: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """Rows that the per-folder cap leaves, sub-folders before bookmarks; what lies below a dropped folder goes too."""
    near = nodes.filter(_within(F.col("node_key"), max_children))
    # At most `max_children` folder rows per parent are left, so this count is cheap and exact below the cap.
    folders = near.filter((F.col("kind") == "folder") & F.col("parent_key").isNotNull()).groupBy("export_id", "parent_key").agg(
        F.count(F.lit(1)).alias("_folders"))
    ranked = near.join(folders, ["export_id", "parent_key"], "left")
    rank = F.col("ordinal") + F.when(F.col("kind") == "url", F.coalesce("_folders", F.lit(0))).otherwise(0)
    return ranked.filter(rank < max_children).drop("_folders")


def overflow_rows(nodes: DataFrame, max_children: int = MAX_CHILDREN, template: str = OVERFLOW_TEXT) -> DataFrame:
    """One row per visible folder that lost direct children, placed after the folder's whole subtree."""
    counts = child_counts(nodes).withColumn("omitted", F.col("folders") + F.col("bookmarks") - max_children)
    lost = counts.filter((F.col("omitted") > 0) & _within(F.col("node_key"), max_children))
    return lost.select(
        "export_id", F.concat("node_key", F.lit("/z")).alias("node_key"), F.col("node_key").alias("parent_key"),
        F.lit("collapsed").alias("kind"), _fill(template, "omitted", F.col("omitted")).alias("title"), "omitted")


def outline_rows(nodes: DataFrame, max_children: int = MAX_CHILDREN, max_nodes: int = MAX_NODES,
                 label_limit: int = LABEL_LIMIT, limit_text: str = LIMIT_TEXT, overflow_text: str = OVERFLOW_TEXT) -> DataFrame:
    """Visible rows of each export with their position, id, label and parent.

    The first row beyond ``max_nodes`` turns into the limit row under its own parent; nothing follows it.
    """
    cols = ["export_id", "node_key", "parent_key", "kind", "title"]
    rows = top_children(nodes, max_children).select(*cols).unionByName(
        overflow_rows(nodes, max_children, overflow_text).select(*cols))
    placed = top_per_group(
        rows.withColumn("_key", outline_key(F.col("node_key"))), ["export_id"], [F.col("_key")], max_nodes + 1,
        ["node_key"], "_rn")
    over = F.col("_rn") > max_nodes
    prefix = F.when(F.col("kind") == "url", "bookmark_").when(F.col("kind") == "folder", "folder_").otherwise("collapsed_")
    label = F.when(over, _fill(limit_text, "max_nodes", F.lit(max_nodes))).when(
        F.col("kind") == "collapsed", F.col("title")).otherwise(sanitize_label(F.col("title"), label_limit))
    shaped = placed.select(
        "export_id", "node_key", "parent_key", (F.col("_rn") - 1).cast("int").alias("pos"),
        F.when(over, "limit").otherwise(F.col("kind")).alias("kind"),
        F.when(over, LIMIT_ID).otherwise(F.concat(prefix, (F.col("_rn") - 1).cast("string"))).alias("node_id"),
        label.alias("label"))
    # Both sides hold at most max_nodes + 1 rows per export.
    ids = shaped.select("export_id", F.col("node_key").alias("parent_key"), F.col("node_id").alias("parent_id"))
    return shaped.join(ids, ["export_id", "parent_key"], "left").select(
        "export_id", "pos", "kind", "node_id", "label", "parent_id")


def outline_lines(rows: DataFrame) -> DataFrame:
    """Two lines per row: the node, round-cornered for bookmarks, and the edge from its parent right after it."""
    shape = F.when(F.col("kind") == "url", F.concat(F.lit("  "), "node_id", F.lit('("'), "label", F.lit('")'))).otherwise(
        F.concat(F.lit("  "), "node_id", F.lit("["), "label", F.lit("]")))
    edge = F.concat(F.lit("  "), "parent_id", F.lit(" --> "), "node_id")
    both = F.posexplode(F.array_compact(F.array(shape, edge)))
    return rows.select("export_id", "pos", "node_id", both.alias("part", "line"))


def outline_text(rows: DataFrame) -> DataFrame:
    """The outline of each export as one text. The node cap bounds it to about twice the cap in lines."""
    lines = outline_lines(rows).groupBy("export_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.select("export_id", F.concat(F.lit(HEADER + "\n"), text).alias("outline"))


def fenced(outlines: DataFrame) -> DataFrame:
    """Outline text as a fenced block, ready to be written."""
    return outlines.select("export_id", F.concat(F.lit("```mermaid\n"), "outline", F.lit("\n```")).alias("document"))
