"""Queries over exports and folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.operators import tree as T
from linkatlas.plans.derive import EPOCH_1601_GAP, LARGE_CTE, NODES_CTE, damaged_exports, exports, large_nodes, link_pages, nodes, stored_nodes
from linkatlas.plans.registry import query
from linkatlas.session import durable, scratch_path
from linkatlas.sources import exports as S
from linkatlas.sources.tables import table

SHOWN = "export_id, node_key, parent_key, kind, title, url, ordinal::INTEGER AS ordinal, depth::INTEGER AS depth, path, strftime(date_added, '%Y-%m-%dT%H:%M:%S.%f') AS added"


def shown(nodes_df):
    """Nodes with arrays and times as text; the instant is taken from its micros, whatever the session zone."""
    instant = F.timestamp_add("MICROSECOND", F.unix_micros("date_added"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return nodes_df.select(
        "export_id", "node_key", "parent_key", "kind", "title", "url", "ordinal", "depth",
        F.array_join("folder_path", "/").alias("path"),
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("added"))


def sound_docs(spark, sf_dir):
    return S.sound(S.parse_exports(exports(spark, sf_dir)))


@query("s1_read_exports", f"""WITH {NODES_CTE}
SELECT export_id, count(*) FILTER (kind = 'folder' AND depth = 1) AS sections, '1' AS version FROM nodes GROUP BY export_id""")
def read_exports(spark, sf_dir):
    """Exports as files of the shared folder, one document each, read whole; the id comes back out of the folder's name."""
    path = scratch_path(spark, "exports")
    exports(spark, sf_dir).select("export_id", F.col("raw").alias("value")).write.partitionBy("export_id").option("lineSep", "\n").text(path)
    files = S.read_exports(spark, f"{path}/*/*.txt").withColumn("export_id", F.regexp_extract("export_id", "export_id=([^/]+)/", 1))
    parsed = S.parse_exports(files)
    roots = F.size(S.field(F.col("doc"), "roots").cast("map<string,variant>")).cast("bigint")
    return parsed.select("export_id", roots.alias("sections"), S.field(F.col("doc"), "version", "string").alias("version"))


@query("s2_validate_exports", f"""WITH {NODES_CTE}, docs AS (SELECT DISTINCT export_id, substr(export_id, 2)::BIGINT % 5 AS k FROM nodes)
SELECT export_id, CASE k WHEN 0 THEN '' WHEN 1 THEN '{S.NOT_JSON}' WHEN 2 THEN '{S.NOT_OBJECT}'
  WHEN 3 THEN '{S.NO_ROOTS.replace("'", "''")}' ELSE '{S.ROOTS_NOT_OBJECT.replace("'", "''")}' END AS reason FROM docs""")
def validate_exports(spark, sf_dir):
    return S.parse_exports(damaged_exports(spark, sf_dir)).select("export_id", "reason")


@query("s2_quarantine", f"""WITH {NODES_CTE}, docs AS (SELECT DISTINCT export_id, substr(export_id, 2)::BIGINT % 5 AS k FROM nodes)
SELECT CASE k WHEN 1 THEN '{S.NOT_JSON}' WHEN 2 THEN '{S.NOT_OBJECT}'
  WHEN 3 THEN '{S.NO_ROOTS.replace("'", "''")}' ELSE '{S.ROOTS_NOT_OBJECT.replace("'", "''")}' END AS reason, count(*) AS exports
FROM docs WHERE k <> 0 GROUP BY 1""")
def quarantine(spark, sf_dir):
    bad = S.quarantined(S.parse_exports(damaged_exports(spark, sf_dir)))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).cast("bigint").alias("exports"))


@query("s2_required_keys", """
SELECT event_id, (event_type <> 'error' AND json_exists(props, '$.k')) AS has_k,
  (event_type <> 'error' AND json_exists(props, '$.k') AND json_exists(props, '$.absent')) AS has_both FROM events""")
def required_keys(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    doc = F.try_parse_json(raw)
    return table(spark, sf_dir, "events").select(
        "event_id", S.has_keys(doc, ["k"]).alias("has_k"), S.has_keys(doc, ["k", "absent"]).alias("has_both"))


@query("t1_flatten", f"WITH {NODES_CTE} SELECT {SHOWN} FROM nodes")
def flatten(spark, sf_dir):
    return shown(T.flatten_exports(sound_docs(spark, sf_dir))[0])


@query("t1_large_flatten", f"WITH {LARGE_CTE} SELECT {SHOWN} FROM nodes")
def large_flatten(spark, sf_dir):
    """Documents of over a thousand nodes, over fifty children and twelve levels, there and back."""
    docs = durable(T.fold_exports(durable(large_nodes(spark, sf_dir))))
    return shown(T.flatten_exports(S.sound(S.parse_exports(docs)))[0])


@query("t8_large_counts", f"""WITH {LARGE_CTE}
SELECT f.export_id, f.node_key, count(b.node_key) AS bookmarks FROM nodes f
LEFT JOIN nodes b ON b.export_id = f.export_id AND b.kind = 'url' AND starts_with(b.node_key, f.node_key || '/')
WHERE f.kind = 'folder' GROUP BY 1, 2""")
def large_counts(spark, sf_dir):
    return T.subtree_counts(durable(large_nodes(spark, sf_dir)))


# Every page as a raw node whose shape depends on its host and language: the rules on kinds, names and drops.
ODD_NODES_SQL = f"""WITH {NODES_CTE}, odd AS (SELECT *, page_id % 8 AS k FROM link_pages)"""


def odd_exports(spark, sf_dir):
    """One small export per page: a bar section that holds the page in one of eight odd shapes."""
    def js(c):
        text = F.to_json(F.struct(c.alias("v")))
        return F.substring(text, F.lit(6), F.char_length(text) - 6)

    url, title = js(F.col("url")), js(F.col("title"))

    def t(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    k = F.col("page_id") % 8
    node = (
        F.when(k == 0, t('{"type":"URL","name":', title, ',"url":', url, "}"))
        .when(k == 1, t('{"name":', title, ',"children":[{"type":"url","name":"","url":', url, "}]}"))
        .when(k == 2, t('{"type":"separator","name":', title, "}"))
        .when(k == 3, t('{"type":"url","name":', title, ',"url":""}'))
        .when(k == 4, t('{"name":', title, ',"url":', url, "}"))
        .when(k == 5, t('{"type":"folder","name":null}'))
        .when(k == 6, t('"', "text", '"'))
        .otherwise(t('{"type":"url","url":', url, ',"date_added":"never"}'))
    )
    # Half of the sections carry their own name; a known other root key and an unknown one surround them.
    name = F.when(k < 4, '"name":"Mine",').otherwise("")
    raw = t('{"roots":{"trash":{"type":"folder","children":[', node, ']},"other":{},"bookmark_bar":{', name, '"type":"folder","children":[', node, "]}}}")
    return link_pages(spark, sf_dir).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("export_id"), raw.alias("raw"))


@query("t2_node_kinds", ODD_NODES_SQL + """
SELECT 'p' || page_id AS export_id, 'Root' AS path, 'folder' AS kind, 'Root' AS title, NULL::VARCHAR AS url FROM odd
UNION ALL SELECT 'p' || page_id, 'Root/' || CASE WHEN k < 4 THEN 'Mine' ELSE 'Bookmark Bar' END, 'folder', CASE WHEN k < 4 THEN 'Mine' ELSE 'Bookmark Bar' END, NULL FROM odd
UNION ALL SELECT 'p' || page_id, 'Root/Mine', 'url', title, url FROM odd WHERE k = 0
UNION ALL SELECT 'p' || page_id, 'Root/Mine/' || coalesce(nullif(title, ''), 'Untitled'), 'folder', coalesce(nullif(title, ''), 'Untitled'), NULL FROM odd WHERE k = 1
UNION ALL SELECT 'p' || page_id, 'Root/Mine/' || coalesce(nullif(title, ''), 'Untitled'), 'url', 'Untitled', url FROM odd WHERE k = 1
UNION ALL SELECT 'p' || page_id, 'Root/Bookmark Bar/Untitled', 'folder', 'Untitled', NULL FROM odd WHERE k = 5
UNION ALL SELECT 'p' || page_id, 'Root/Bookmark Bar', 'url', 'Untitled', url FROM odd WHERE k = 7""")
def node_kinds(spark, sf_dir):
    kept, _ = T.flatten_exports(S.sound(S.parse_exports(odd_exports(spark, sf_dir))))
    return kept.select("export_id", F.array_join("folder_path", "/").alias("path"), "kind", "title", "url")


@query("t3_titles", f"""WITH {NODES_CTE} SELECT title, kind, count(*) AS n FROM nodes GROUP BY ALL""")
def titles(spark, sf_dir):
    kept, _ = T.flatten_exports(sound_docs(spark, sf_dir))
    return kept.groupBy("title", "kind").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("t4_sections", f"""WITH {NODES_CTE}
SELECT export_id, title AS section, ordinal::INTEGER AS place FROM nodes WHERE depth = 1""")
def sections(spark, sf_dir):
    docs = sound_docs(spark, sf_dir)
    return T.section_children(docs).select("export_id", F.inline(T.ranked_children(F.col("children")))).select(
        "export_id", F.col("title").alias("section"), F.col("ordinal").alias("place"))


@query("t5_rejected", ODD_NODES_SQL + """
SELECT 'p' || page_id AS export_id, CASE k WHEN 2 THEN 'rejected: unknown type ''separator''' WHEN 3 THEN 'rejected: bookmark without URL'
  WHEN 4 THEN 'rejected: unknown type ''''' ELSE 'rejected: not an object' END AS reason,
  CASE WHEN k < 4 THEN 'Root/Mine' ELSE 'Root/Bookmark Bar' END AS path FROM odd WHERE k IN (2, 3, 4, 6)""")
def rejected(spark, sf_dir):
    _, bad = T.flatten_exports(S.sound(S.parse_exports(odd_exports(spark, sf_dir))))
    return bad.select("export_id", "reason", F.array_join("folder_path", "/").alias("path"))


@query("t6_folder_paths", f"""WITH {NODES_CTE}
SELECT export_id, node_key, path, (length(path) - length(replace(path, '/', '')) + 1)::INTEGER AS levels FROM nodes""")
def folder_paths(spark, sf_dir):
    return nodes(spark, sf_dir, titled=False).select(
        "export_id", "node_key", F.array_join("folder_path", "/").alias("path"), F.size("folder_path").alias("levels"))


@query("t7_visit_orders", f"""WITH {NODES_CTE}
SELECT export_id, node_key, row_number() OVER (PARTITION BY export_id ORDER BY node_key) AS processing,
  row_number() OVER (PARTITION BY export_id ORDER BY translate(node_key, 'bf', 'fb')) AS outline FROM nodes""")
def visit_orders(spark, sf_dir):
    all_nodes = stored_nodes(spark, sf_dir, titled=False).select("export_id", "node_key")
    one = T.visit_order(all_nodes, "processing").withColumnRenamed("position", "processing")
    two = T.visit_order(all_nodes, "outline").withColumnRenamed("position", "outline")
    return one.join(two, ["export_id", "node_key"])


@query("t8_subtree_counts", f"""WITH {NODES_CTE}
SELECT f.export_id, f.node_key, count(b.node_key) AS bookmarks FROM nodes f
LEFT JOIN nodes b ON b.export_id = f.export_id AND b.kind = 'url' AND starts_with(b.node_key, f.node_key || '/')
WHERE f.kind = 'folder' GROUP BY 1, 2""")
def subtree_counts(spark, sf_dir):
    return T.subtree_counts(stored_nodes(spark, sf_dir, titled=False))


@query("t8_rollup_counts", """
SELECT r_name, n_name, c_mktsegment, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_counts(spark, sf_dir):
    """Counts up a hierarchy of fixed depth. Orders are counted per customer before they are joined."""
    def read(name):
        return table(spark, sf_dir, name)

    per_customer = read("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        read("customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_nationkey", "c_mktsegment").agg(F.sum("n").alias("n"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .rollup("r_name", "n_name", "c_mktsegment").agg(F.sum("n").cast("bigint").alias("orders"))
    )


@query("t9_child_counts", f"""WITH {NODES_CTE}
SELECT f.export_id, f.node_key, count(c.node_key) FILTER (c.kind = 'folder') AS folders, count(c.node_key) FILTER (c.kind = 'url') AS bookmarks
FROM nodes f LEFT JOIN nodes c ON c.export_id = f.export_id AND c.parent_key = f.node_key WHERE f.kind = 'folder' GROUP BY 1, 2""")
def child_counts(spark, sf_dir):
    return T.child_counts(stored_nodes(spark, sf_dir, titled=False))


@query("t10_fold", f"""WITH {NODES_CTE}
SELECT export_id, to_json(list(date_text ORDER BY node_key)) AS dates, count(*) AS bookmarks FROM (
  SELECT export_id, node_key, (epoch_us(date_added) + {EPOCH_1601_GAP})::VARCHAR AS date_text FROM nodes WHERE kind = 'url') GROUP BY export_id""")
def fold(spark, sf_dir):
    """Documents folded from the nodes; their dates in text order are the bookmarks in processing order."""
    dates = F.regexp_extract_all("raw", F.lit('"date_added":"([0-9]+)"'), F.lit(1))
    return exports(spark, sf_dir).select(
        "export_id", F.to_json(dates).alias("dates"), F.size(dates).cast("bigint").alias("bookmarks"))
