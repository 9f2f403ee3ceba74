"""Folder trees as tables.

``nodes`` has one row per folder and bookmark:
``export_id, node_key, parent_key, kind, title, url, date_added, ordinal, depth, folder_path``.

``node_key`` spells the way from the top: ``R``, then ``/f`` or ``/b`` with the zero-padded place among
the siblings of the same kind. Byte order of the keys is the processing order (a folder's bookmarks,
then its sub-folders, depth first), because ``b`` < ``f`` and a prefix comes first. Swapping the two
letters gives the outline order (sub-folders first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.functions.times import from_1601
from linkatlas.operators.skew import OrderedChunks
from linkatlas.session import durable
from linkatlas.sources.exports import field, is_list, is_object

# Root sections in their order, the top folder, the title of the nameless.
SECTIONS = [("bookmark_bar", "Bookmark Bar"), ("other", "Other"), ("synced", "Mobile")]
TOP = "Root"
UNTITLED = "Untitled"
TOO_DEEP = "rejected: nested too deep"
# Digits of an ordinal in a key: as many as the largest long has, so that none is cut.
PAD = 19
TOP_KEY = "R"
# Levels of a tree that come out of a document in one pass.
PASS = 6
ROWS = ("array<struct<node_key: string, parent_key: string, kind: string, title: string, url: string, added: string, ordinal: int, depth: int, "
        "folder_path: array<string>, position: int, children: array<variant>>>")
NODE_COLUMNS = ["export_id", "node_key", "parent_key", "kind", "title", "url", "date_added", "ordinal", "depth",
                "folder_path"]


def child_key(parent: Column, kind: Column, ordinal: Column) -> Column:
    letter = F.when(kind == "folder", "/f").otherwise("/b")
    return F.concat(parent, letter, F.lpad(ordinal.cast("string"), PAD, "0"))


def outline_key(node_key: Column) -> Column:
    """Key whose byte order is the outline order."""
    return F.translate(node_key, "bf", "fb")


def node_kind(node: Column) -> Column:
    """'folder', 'url', or the reason why the node is dropped."""
    named = F.lower(F.coalesce(field(node, "type", "string"), F.lit("")))
    children = field(node, "children")
    kind = F.when((named == "") & is_list(children), "folder").otherwise(named)
    url = F.coalesce(field(node, "url", "string"), F.lit(""))
    return (
        F.when(~is_object(node), "rejected: not an object")
        .when(kind == "folder", "folder")
        .when((kind == "url") & (url == ""), "rejected: bookmark without URL")
        .when(kind == "url", "url")
        .otherwise(F.concat(F.lit("rejected: unknown type '"), kind, F.lit("'")))
    )


def node_title(node: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(field(node, "name", "string"), F.lit("")), default)


def _describe(node: Column, default: Column, position: Column) -> Column:
    return F.struct(
        node_kind(node).alias("kind"),
        node_title(node, default).alias("title"),
        field(node, "url", "string").alias("url"),
        field(node, "date_added", "string").alias("added"),
        F.coalesce(field(node, "children").try_cast("array<variant>"), F.array().cast("array<variant>")).alias("children"),
        position.alias("position"),
    )


def ranked_children(described: Column) -> Column:
    """Number the folders, the bookmarks and the rejects of one child list, each kind from 0."""
    def kind_of(test):
        return F.transform(
            F.filter(described, test),
            lambda x, i: F.struct(
                x["kind"].alias("kind"), x["title"].alias("title"), x["url"].alias("url"), x["added"].alias("added"),
                x["children"].alias("children"), x["position"].alias("position"), i.alias("ordinal"),
            ),
        )

    return F.concat(
        kind_of(lambda x: x["kind"] == "folder"),
        kind_of(lambda x: x["kind"] == "url"),
        kind_of(lambda x: F.startswith(x["kind"], F.lit("rejected"))),
    )


def section_children(docs: DataFrame) -> DataFrame:
    """Child list of the synthetic top folder: the known root sections that hold anything."""
    roots = field(F.col("doc"), "roots")
    listed = F.array(*[
        F.struct(field(roots, key).alias("node"), F.lit(label).alias("label")) for key, label in SECTIONS
    ])
    # An empty object, empty list or JSON null in place of a section counts as no section.
    present = F.filter(
        listed,
        lambda s: s["node"].isNotNull() & ~F.is_variant_null(s["node"])
        & ~F.to_json(s["node"]).isin("{}", "[]", '""', "0", "false"),
    )
    described = F.transform(present, lambda s, i: _describe(s["node"], s["label"], i))
    return docs.select(
        "export_id",
        F.lit(TOP_KEY).alias("parent_key"),
        F.array(F.lit(TOP)).alias("parent_path"),
        described.alias("children"),
    )


def _child(node: Column, position: Column) -> Column:
    return _describe(node, F.lit(UNTITLED), position)


def _levels(children: Column, key: Column, path: Column, depth: int, count: int) -> Column:
    """The rows of ``count`` levels below a folder, each node before what lies below it. Only those of the last level keep their children."""
    def rows(x: Column) -> Column:
        is_folder = x["kind"] == "folder"
        own_key = child_key(key, x["kind"], x["ordinal"])
        own_path = F.when(is_folder, F.concat(path, F.array(x["title"]))).otherwise(path)
        rest = x["children"] if count == 1 else F.array().cast("array<variant>")
        own = F.array(F.struct(
            own_key.alias("node_key"), key.alias("parent_key"), x["kind"].alias("kind"), x["title"].alias("title"), x["url"].alias("url"), x["added"].alias("added"),
            x["ordinal"].alias("ordinal"), F.lit(depth).alias("depth"), own_path.alias("folder_path"), x["position"].alias("position"), rest.alias("children")))
        if count == 1:
            return own
        return F.concat(own, F.when(is_folder, _levels(F.transform(x["children"], _child), own_key, own_path, depth + 1, count - 1)).otherwise(F.array().cast(ROWS)))

    return F.flatten(F.transform(ranked_children(children), rows))


def flatten_exports(docs: DataFrame, max_depth: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Recursive flatten of ``(export_id, doc)`` into ``(nodes, rejected)``.

    One round for every ``PASS`` levels: a document is opened once, and the rows of these levels come out of it in one narrow pass; child lists are numbered inside
    their own row, nothing is shuffled. Only what lies deeper goes to the next round, which starts from a checkpoint. An export deeper than ``max_depth`` is turned
    away whole, never cut: it has no nodes and one rejected row per folder that goes too deep.
    """
    top = docs.select(
        "export_id",
        F.lit(TOP_KEY).alias("node_key"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit("folder").alias("kind"),
        F.lit(TOP).alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("timestamp").alias("date_added"),
        F.lit(0).alias("ordinal"),
        F.lit(0).alias("depth"),
        F.array(F.lit(TOP)).alias("folder_path"),
    )
    nodes, rejected = top, None
    frontier, depth = section_children(docs), 1
    while depth <= max_depth:
        count = min(PASS, max_depth - depth + 1)
        level = durable(frontier.select("export_id", F.inline(_levels(F.col("children"), F.col("parent_key"), F.col("parent_path"), depth, count))))
        kept = level.filter(F.col("kind").isin("folder", "url"))
        nodes = nodes.unionByName(kept.select(
            "export_id", "node_key", "parent_key", "kind", "title",
            F.when(F.col("kind") == "url", F.col("url")).alias("url"),
            F.when(F.col("kind") == "url", from_1601(F.col("added"))).alias("date_added"),
            "ordinal", "depth", "folder_path",
        ))
        dropped = level.filter(~F.col("kind").isin("folder", "url")).select(
            "export_id", "parent_key", "position", "title", F.col("kind").alias("reason"), "folder_path",
        )
        rejected = dropped if rejected is None else rejected.unionByName(dropped)
        deeper = level.filter((F.col("kind") == "folder") & (F.size("children") > 0))
        if deeper.isEmpty():
            return nodes, rejected
        frontier = deeper.select(
            "export_id", F.col("node_key").alias("parent_key"), F.col("folder_path").alias("parent_path"),
            F.transform("children", _child).alias("children"),
        )
        depth += count
    too_deep = frontier.select("export_id").distinct()
    reasons = frontier.select("export_id", "parent_key", F.lit(0).alias("position"), F.element_at("parent_path", -1).alias("title"),
                              F.lit(TOO_DEEP).alias("reason"), F.col("parent_path").alias("folder_path"))
    whole, told = (part.join(too_deep, "export_id", "left_anti") for part in (nodes, rejected))
    return whole, told.unionByName(reasons)


def fold_exports(nodes: DataFrame) -> DataFrame:
    """Inverse of the flatten: one nested JSON document ``(export_id, raw)`` per export.

    A document is one row of the result, so the child lists gathered here are never larger than a
    row the reader already held. Folders are folded bottom-up, one grouping per level.
    """
    def body(*fields: Column) -> Column:
        """JSON object text without its closing brace."""
        text = F.to_json(F.struct(*fields))
        return F.left(text, F.char_length(text) - 1)

    micros = (F.unix_micros("date_added") + F.lit(11_644_473_600_000_000)).cast("string")
    leaves = nodes.filter(F.col("kind") == "url").select(
        "export_id", "parent_key", F.substring_index("node_key", "/", -1).alias("place"), "depth",
        F.concat(body(F.lit("url").alias("type"), F.col("title").alias("name"), F.col("url"),
                      micros.alias("date_added")), F.lit("}")).alias("json"),
    )
    folders = nodes.filter(F.col("kind") == "folder")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = None
    # The first round has no members: it folds the childless folders of the deepest level.
    for depth in range(deepest + 1, 0, -1):
        at_level = leaves.filter(F.col("depth") == depth).drop("depth")
        members = at_level if below is None else at_level.unionByName(below)
        lists = members.groupBy("export_id", "parent_key").agg(
            F.array_sort(F.collect_list(F.struct("place", "json"))).alias("members")
        )
        parents = folders.filter(F.col("depth") == depth - 1).select("export_id", "node_key", F.col("parent_key").alias("upper"), "title")
        joined = parents.join(
            lists.withColumnRenamed("parent_key", "node_key"), ["export_id", "node_key"], "left"
        )
        inner = F.array_join(F.transform(F.coalesce("members", F.array().cast(lists.schema["members"].dataType)),
                                         lambda m: m["json"]), ",")
        if depth == 1:
            return _documents(joined)
        below = joined.select(
            "export_id", F.col("upper").alias("parent_key"), F.substring_index("node_key", "/", -1).alias("place"),
            F.concat(body(F.lit("folder").alias("type"), F.col("title").alias("name")),
                     F.lit(',"children":['), inner, F.lit("]}")).alias("json"),
        )
    raise AssertionError("unreachable")


def _documents(tops: DataFrame) -> DataFrame:
    """Place the members of the top folder under the root section that their name stands for."""
    def section(key: str, label: str) -> Column:
        own = F.filter("members", lambda m: F.get_json_object(m["json"], "$.name") == label)
        return F.when(F.size(own) > 0, F.concat(F.lit(f'"{key}":'), own[0]["json"]))

    parts = F.array_compact(F.array(*[section(k, label) for k, label in SECTIONS]))
    return tops.select(
        "export_id", F.concat(F.lit('{"version":1,"roots":{'), F.array_join(parts, ","), F.lit("}}")).alias("raw")
    )


# ---------------------------------------------------------------- hierarchy queries

def ancestor_keys(node_key: Column) -> Column:
    """Keys of all folders above a node, the top first."""
    parts = F.split(node_key, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def subtree_sums(nodes: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Sums over all bookmarks below every folder, at any depth; folders without any get 0.

    Bookmarks are first summed per parent folder, so that the ancestors of a big folder are
    spelled out once and not once per bookmark.
    """
    names = list(measures)
    direct = nodes.filter(F.col("kind") == "url").groupBy("export_id", "parent_key").agg(
        *[F.sum(m).alias(n) for n, m in measures.items()]
    )
    above_parent = F.when(F.col("parent_key") == TOP_KEY, F.array().cast("array<string>")).otherwise(
        ancestor_keys(F.col("parent_key"))
    )
    chain = F.concat(above_parent, F.array("parent_key"))
    above = direct.select("export_id", F.explode(chain).alias("node_key"), *names)
    zero = nodes.filter(F.col("kind") == "folder").select(
        "export_id", "node_key", *[F.lit(0).cast("bigint").alias(n) for n in names]
    )
    return above.unionByName(zero).groupBy("export_id", "node_key").agg(
        *[F.sum(n).cast("bigint").alias(n) for n in names]
    )


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """Bookmarks below every folder."""
    return subtree_sums(nodes, {"bookmarks": F.lit(1)})


def child_counts(nodes: DataFrame) -> DataFrame:
    """Direct sub-folders and bookmarks per folder; empty folders are kept with zeros.

    Folders come in as rows with zero counts, so one grouping does the work of the outer join.
    """
    isf = (F.col("kind") == "folder").cast("bigint")
    as_child = nodes.filter(F.col("parent_key").isNotNull()).select(
        "export_id", F.col("parent_key").alias("node_key"), isf.alias("f"), (1 - isf).alias("b")
    )
    zero = F.lit(0).cast("bigint")
    as_self = nodes.filter(F.col("kind") == "folder").select("export_id", "node_key", zero.alias("f"), zero.alias("b"))
    return as_child.unionByName(as_self).groupBy("export_id", "node_key").agg(
        F.sum("f").cast("bigint").alias("folders"), F.sum("b").cast("bigint").alias("bookmarks")
    )


def visit_order(nodes: DataFrame, order: str = "processing") -> DataFrame:
    """Adds the 1-based place of every node in its export, in 'processing' or 'outline' order."""
    key = {"processing": F.col("node_key"), "outline": outline_key(F.col("node_key"))}[order]
    chunks = OrderedChunks(nodes.withColumn("_visit", key), ["export_id"], ["_visit"])
    return chunks.row_number("position").result().drop("_visit")
