"""Queries that use the SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from linkatlas.functions import sql as G
from linkatlas.functions import text as X
from linkatlas.functions.times import EPOCH_1601_GAP, epoch_micros
from linkatlas.plans import sqltext as Q
from linkatlas.plans.derive import NODES_CTE, exports
from linkatlas.plans.pages import TEXT
from linkatlas.plans.registry import query
from linkatlas.plans.scalars import NAMES_SQL, NOISY_SQL, PATHS_SQL, URL_FORMS_SQL, _paths, names, noisy, url_forms
from linkatlas.sources.tables import table


@query("g1_sql_text_functions", f"""WITH {NOISY_SQL}
SELECT doc_id, md5({Q.clean('t')}) AS clean_md5, md5({Q.squeeze('t')}) AS squeezed_md5, {Q.truncated('t', 80)} AS short,
  md5({Q.underscored('t')}) AS sane_md5, {Q.hashed('t')} AS hash_name FROM noisy""")
def sql_text_functions(spark, sf_dir):
    G.register_sql_functions(spark)
    return noisy(spark, sf_dir).selectExpr(
        "doc_id", "md5(clean_text(t)) AS clean_md5", "md5(normalize_whitespace(t)) AS squeezed_md5", "truncate_text(t, 80) AS short",
        "md5(replace_forbidden(t)) AS sane_md5", "hash_name(t) AS hash_name")


@query("g1_sql_url_functions", f"""WITH {URL_FORMS_SQL}
SELECT page_id, form::INTEGER AS form, (lower(split_part(ltrim(url), '://', 1)) IN ('http', 'https') AND strpos(url, '://') > 0
   AND split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) <> '') AS valid,
  CASE WHEN strpos(url, '://') > 0 THEN nullif(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '') END AS domain FROM url_forms""")
def sql_url_functions(spark, sf_dir):
    G.register_sql_functions(spark)
    return url_forms(spark, sf_dir).selectExpr("page_id", "form", "is_valid_url(url) AS valid", "extract_domain(url) AS domain")


@query("g1_sql_name_functions", f"""WITH {NAMES_SQL}, clean AS (SELECT source, id, name, {Q.squeeze("replace(replace(name, chr(34), chr(39)), chr(96), '')")} AS label,
  {Q.squeeze("regexp_replace(name, " + Q.quoted(X.FORBIDDEN) + ", '', 'g')")} AS bare FROM names), cut AS (SELECT *, {Q.byte_prefix('bare', 255)} AS file FROM clean)
SELECT source, id, {Q.truncated('label', 60)} AS label, CASE WHEN length(label) <= 20 THEN label ELSE left(label, 17) || '...' END AS short_label,
  CASE WHEN file = '' THEN 'unnamed' ELSE file END AS file_name, md5(name) AS md5, sha256(name) AS sha256, CASE WHEN length(name) <= 30 THEN name ELSE left(name, 29) || '…' END AS cut FROM cut""")
def sql_name_functions(spark, sf_dir):
    G.register_sql_functions(spark)
    return names(spark, sf_dir).selectExpr(
        "source", "id", "sanitize_label(name) AS label", "sanitize_label(name, 20) AS short_label", "safe_filename(name) AS file_name",
        "text_hash(name) AS md5", "text_hash(name, 'sha256') AS sha256", "truncate_text(name, 30, '…') AS cut")


@query("g1_sql_path_functions", f"""WITH {NODES_CTE}, {PATHS_SQL}, flat AS (SELECT *, replace(p, '/./', '/') AS q FROM paths)
SELECT export_id, node_key, starts_with(CASE WHEN p LIKE '%/../%' THEN regexp_replace(p, '/[^/]*/\\.\\./', '/') ELSE replace(p, '/./', '/') END || '/', '/out/Root/Bookmark Bar/') AS safe,
  CASE WHEN starts_with(q, '/out/Root/Other/') THEN substr(q, length('/out/Root/Other/') + 1) ELSE p END AS relative FROM flat""")
def sql_path_functions(spark, sf_dir):
    G.register_sql_functions(spark)
    return _paths(spark, sf_dir).selectExpr(
        "export_id", "node_key", "is_safe_path(p, '/out/Root/Bookmark Bar') AS safe", "relative_path(p, '/out/Root/Other') AS relative")


@query("g1_sql_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def sql_iso_time(spark, sf_dir):
    G.register_sql_functions(spark)
    return table(spark, sf_dir, "events").selectExpr("event_id", "iso_text(cast(ts AS TIMESTAMP_NTZ)) AS iso")


@query("g1_sql_time_functions", """SELECT event_id, epoch_us(ts) AS us, CASE WHEN value * 25 < 60 THEN format('{:.1f} сек', value * 25)
  WHEN value * 25 < 3600 THEN format('{:.1f} мин', value * 25 / 60.0::DOUBLE) ELSE format('{:.1f} час', value * 25 / 3600.0::DOUBLE) END AS shown FROM events""")
def sql_time_functions(spark, sf_dir):
    G.register_sql_functions(spark)
    text = (epoch_micros(F.col("ts")) + F.lit(EPOCH_1601_GAP)).cast("string")
    return table(spark, sf_dir, "events").withColumn("added", text).selectExpr(
        "event_id", "unix_micros(from_1601(added)) AS us", "format_duration(value * 25.0D) AS shown")


@query("g2_sql_extract_text", f"WITH {TEXT} SELECT page_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM page_text")
def sql_extract_text(spark, sf_dir):
    G.register_python_functions(spark)
    read = table(spark, sf_dir, "pages").selectExpr("page_id", "extract_text(html) AS text")
    return read.selectExpr("page_id", "md5(text) AS text_md5", "cast(char_length(text) AS bigint) AS n_chars")


@query("g3_bookmark_nodes", f"WITH {NODES_CTE} SELECT export_id, node_key, parent_key, kind, title, url, ordinal::INTEGER AS ordinal, depth::INTEGER AS depth FROM nodes")
def bookmark_nodes(spark, sf_dir):
    G.register_python_functions(spark)
    return spark.sql("SELECT e.export_id, n.* FROM {docs} e, LATERAL bookmark_nodes(e.raw) n", docs=exports(spark, sf_dir))


@query("g5_tolerant", """WITH parsed AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_id, CASE WHEN k % 5 = 0 THEN -1 ELSE 100 // (k % 5) END AS value, k % 5 = 0 AS failed FROM parsed""")
def tolerant(spark, sf_dir):
    safe = G.tolerant(lambda props: 100 // (json.loads(props)["k"] % 5), -1)
    done = table(spark, sf_dir, "events").select("event_id", safe("props").alias("r"))
    return done.select("event_id", F.col("r.value").alias("value"), F.col("r.error").isNotNull().alias("failed"))


@query("g5_tolerant_native", """WITH parsed AS (SELECT event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_type, count(*) FILTER (k % 5 = 0) AS failures, sum(CASE WHEN k % 5 = 0 THEN -1 ELSE 100 // (k % 5) END)::BIGINT AS total FROM parsed GROUP BY 1""")
def tolerant_native(spark, sf_dir):
    """The same without Python: try_ functions, with the failures counted."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    value = F.floor(F.try_divide(F.lit(100), k % 5))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(value.isNull()).cast("bigint").alias("failures"), F.sum(F.coalesce(value, F.lit(-1))).cast("bigint").alias("total"))
