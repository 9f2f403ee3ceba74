"""Queries over outlines, with caps small enough to bite in exports of 25 pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.operators import outline as O
from linkatlas.plans import sqltext as Q
from linkatlas.plans.derive import LARGE_CTE, NODES_CTE, large_nodes, stored_nodes
from linkatlas.plans.registry import query
from linkatlas.session import durable

N, CAP = 3, 18

LABEL = Q.truncated("t", 60)
# Written with sibling ranks and prefix tests over the whole tree, not from the keys.
def outline_cte(nodes_cte: str, n: int, cap: int) -> str:
    return nodes_cte + f""",
sibs AS (SELECT *, translate(node_key, 'bf', 'fb') AS okey,
  CASE WHEN parent_key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY export_id, parent_key ORDER BY kind, ordinal) END AS rk FROM nodes),
cut AS (SELECT export_id, node_key FROM sibs WHERE rk > {n} AND kind = 'folder'),
visible AS (SELECT * FROM sibs n WHERE rk <= {n} AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.export_id = n.export_id AND starts_with(n.node_key, c.node_key || '/'))),
overflow AS (SELECT p.export_id, p.node_key || '/z' AS node_key, p.node_key AS parent_key, count(*) - {n} AS omitted
  FROM visible p JOIN nodes c ON c.export_id = p.export_id AND c.parent_key = p.node_key GROUP BY ALL HAVING count(*) > {n}),
all_rows AS (SELECT export_id, node_key, parent_key, kind, title AS raw FROM visible
  UNION ALL SELECT export_id, node_key, parent_key, 'collapsed', '... и ' || omitted || ' еще' FROM overflow),
numbered AS (SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY translate(node_key, 'bf', 'fb')) AS rn FROM all_rows),
labelled AS (SELECT *, {Q.squeeze("replace(replace(raw, chr(34), chr(39)), chr(96), '')")} AS t FROM numbered WHERE rn <= {cap + 1}),
shaped AS (SELECT export_id, node_key, parent_key, (rn - 1)::INTEGER AS pos, CASE WHEN rn > {cap} THEN 'limit' ELSE kind END AS kind,
  CASE WHEN rn > {cap} THEN 'limit_reached' WHEN kind = 'url' THEN 'bookmark_' || (rn - 1) ELSE kind || '_' || (rn - 1) END AS node_id,
  CASE WHEN rn > {cap} THEN 'Диаграмма обрезана: достигнут предел {cap} узлов' WHEN kind = 'collapsed' THEN raw ELSE {LABEL} END AS label FROM labelled),
outline AS (SELECT s.*, p.node_id AS parent_id FROM shaped s LEFT JOIN shaped p ON p.export_id = s.export_id AND p.node_key = s.parent_key)"""


OUTLINE_CTE = outline_cte(NODES_CTE, N, CAP)
NODE_LINE = """CASE WHEN kind = 'url' THEN '  ' || node_id || '("' || label || '")' ELSE '  ' || node_id || '[' || label || ']' END"""
TEXT_SQL = f"""'graph TD' || chr(10) || string_agg({NODE_LINE} || CASE WHEN parent_id IS NULL THEN '' ELSE chr(10) || '  ' || parent_id || ' --> ' || node_id END, chr(10) ORDER BY pos)"""


def rows(spark, sf_dir):
    return O.outline_rows(stored_nodes(spark, sf_dir), N, CAP)


@query("w1_top_children", f"WITH {OUTLINE_CTE} SELECT export_id, node_key, kind, title FROM visible")
def top_children(spark, sf_dir):
    return O.top_children(stored_nodes(spark, sf_dir), N).select("export_id", "node_key", "kind", "title")


@query("w2_overflow", f"WITH {OUTLINE_CTE} SELECT export_id, parent_key, omitted, '... и ' || omitted || ' еще' AS label FROM overflow")
def overflow(spark, sf_dir):
    return O.overflow_rows(stored_nodes(spark, sf_dir), N).select("export_id", "parent_key", "omitted", F.col("title").alias("label"))


@query("w3_node_cap", f"WITH {OUTLINE_CTE} SELECT export_id, pos, kind, label FROM outline")
def node_cap(spark, sf_dir):
    return rows(spark, sf_dir).select("export_id", "pos", "kind", "label")


@query("w4_node_ids", f"WITH {OUTLINE_CTE} SELECT export_id, node_id, {NODE_LINE} AS line FROM outline")
def node_ids(spark, sf_dir):
    return O.outline_lines(rows(spark, sf_dir)).filter(F.col("part") == 0).select("export_id", "node_id", "line")


@query("w5_edges", f"WITH {OUTLINE_CTE} SELECT export_id, pos, parent_id, node_id AS child_id FROM outline WHERE parent_id IS NOT NULL")
def edges(spark, sf_dir):
    return rows(spark, sf_dir).filter(F.col("parent_id").isNotNull()).select("export_id", "pos", "parent_id", F.col("node_id").alias("child_id"))


@query("w6_outline_text", f"WITH {OUTLINE_CTE} SELECT export_id, {TEXT_SQL} AS outline FROM outline GROUP BY export_id")
def outline_text(spark, sf_dir):
    return O.outline_text(rows(spark, sf_dir))


@query("w6_outline_defaults", f"""WITH {NODES_CTE}, lines AS (SELECT export_id, title, kind, row_number() OVER w - 1 AS pos, parent_key, node_key FROM nodes WINDOW w AS (PARTITION BY export_id ORDER BY translate(node_key, 'bf', 'fb')))
SELECT export_id, count(*) AS nodes, count(parent_key) AS edges FROM lines GROUP BY 1""")
def outline_defaults(spark, sf_dir):
    """The default caps, which exports of 25 pages never reach."""
    return O.outline_rows(stored_nodes(spark, sf_dir)).groupBy("export_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("nodes"), F.count("parent_id").cast("bigint").alias("edges"))


@query("s9_outline_document", f"WITH {OUTLINE_CTE} SELECT export_id, '```mermaid' || chr(10) || {TEXT_SQL} || chr(10) || '```' AS document FROM outline GROUP BY export_id")
def outline_document(spark, sf_dir):
    return O.fenced(O.outline_text(rows(spark, sf_dir)))


@query("w6_large_outline", f"WITH {outline_cte(LARGE_CTE, O.MAX_CHILDREN, O.MAX_NODES)} SELECT export_id, {TEXT_SQL} AS outline FROM outline GROUP BY export_id")
def large_outline(spark, sf_dir):
    """Outlines under the default caps, of exports that pass both: a folder of up to 1000 links, and over 1000 nodes in all."""
    return O.outline_text(O.outline_rows(durable(large_nodes(spark, sf_dir))))


@query("w3_large_caps", f"WITH {outline_cte(LARGE_CTE, O.MAX_CHILDREN, O.MAX_NODES)} SELECT export_id, kind, count(*) AS n, max(pos) AS last FROM outline GROUP BY ALL")
def large_caps(spark, sf_dir):
    return O.outline_rows(durable(large_nodes(spark, sf_dir))).groupBy("export_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
