"""URL, path and scalar text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkatlas.functions import text as X
from linkatlas.functions import times, urls
from linkatlas.functions.html import page_title
from linkatlas.operators.ledger import settings_hash
from linkatlas.plans import sqltext as Q
from linkatlas.plans.derive import ATTEMPTS_CTE, NODES_CTE, attempts, nodes
from linkatlas.plans.registry import query
from linkatlas.sources.tables import table

URL_FORMS_SQL = """
url_forms AS (
  SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS form,
    unnest([url, replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:'), upper(url), 'https:///' || page_id,
      replace(url, '://', '://u:p@'), substr(url, strpos(url, '//') + 2), ' ' || url, replace(url, '.example', ' example:8080')]) AS url
  FROM pages)"""


def url_forms(spark, sf_dir):
    """Every page URL in eight forms, valid and broken ones."""
    u = F.col("url")
    forms = F.array(
        u, F.replace(F.replace(u, F.lit("https:"), F.lit("ftp:")), F.lit("http:"), F.lit("ftp:")), F.upper(u),
        F.concat(F.lit("https:///"), F.col("page_id").cast("string")), F.replace(u, F.lit("://"), F.lit("://u:p@")),
        F.substring(u, F.instr(u, "//") + 2, F.char_length(u)), F.concat(F.lit(" "), u),
        F.replace(u, F.lit(".example"), F.lit(" example:8080")),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


@query("u1_valid_url", f"""WITH {URL_FORMS_SQL}
SELECT page_id, form::INTEGER AS form, url,
  (lower(split_part(ltrim(url), '://', 1)) IN ('http', 'https') AND strpos(url, '://') > 0
   AND split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) <> '') AS valid FROM url_forms""")
def valid_url(spark, sf_dir):
    return url_forms(spark, sf_dir).select("page_id", "form", "url", urls.is_valid_url(F.col("url")).alias("valid"))


@query("u2_domain", f"""WITH {URL_FORMS_SQL}
SELECT page_id, form::INTEGER AS form, CASE WHEN strpos(url, '://') > 0 THEN
  nullif(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '') END AS domain FROM url_forms""")
def domain(spark, sf_dir):
    return url_forms(spark, sf_dir).select("page_id", "form", urls.extract_domain(F.col("url")).alias("domain"))


@query("u3_size_gate", """
SELECT 'page' AS source, page_id AS id, strlen(html)::BIGINT AS n_bytes, strlen(html) / 1048576.0::DOUBLE <= 0.004::DOUBLE AS fits FROM pages
UNION ALL SELECT 'document', doc_id, strlen(text)::BIGINT, strlen(text) / 1048576.0::DOUBLE <= 0.004::DOUBLE FROM documents""")
def size_gate(spark, sf_dir):
    def gated(source, name, key, column):
        c = F.col(column)
        return table(spark, sf_dir, name).select(
            F.lit(source).alias("source"), F.col(key).alias("id"), F.octet_length(c).cast("bigint").alias("n_bytes"),
            urls.within_size(c, 0.004).alias("fits"))

    return gated("page", "pages", "page_id", "html").unionByName(gated("document", "documents", "doc_id", "text"))


PATHS_SQL = """
paths AS (SELECT export_id, node_key, '/out/' || path || CASE kind WHEN 'url' THEN '/../' || ordinal ELSE '/./x' END AS p, path FROM nodes)"""


def _paths(spark, sf_dir):
    path = F.array_join("folder_path", "/")
    tail = F.when(F.col("kind") == "url", F.concat(F.lit("/../"), F.col("ordinal").cast("string"))).otherwise(F.lit("/./x"))
    return nodes(spark, sf_dir, titled=False).select("export_id", "node_key", F.concat(F.lit("/out/"), path, tail).alias("p"), path.alias("path"))


@query("u5_safe_path", f"""WITH {NODES_CTE}, {PATHS_SQL}
SELECT export_id, node_key, starts_with(CASE WHEN p LIKE '%/../%' THEN regexp_replace(p, '/[^/]*/\\.\\./', '/') ELSE replace(p, '/./', '/') END || '/', '/out/Root/Bookmark Bar/') AS safe,
  false AS sibling_safe FROM paths""")
def safe_path(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "export_id", "node_key", urls.is_safe_path(F.col("p"), F.lit("/out/Root/Bookmark Bar")).alias("safe"),
        urls.is_safe_path(F.col("p"), F.lit("/out/Roo")).alias("sibling_safe"))


@query("u6_relative_path", f"""WITH {NODES_CTE}, {PATHS_SQL}, flat AS (SELECT *, replace(p, '/./', '/') AS q FROM paths)
SELECT export_id, node_key, CASE WHEN starts_with(q, '/out/Root/Other/') THEN substr(q, length('/out/Root/Other/') + 1) ELSE p END AS relative FROM flat""")
def relative_path(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "export_id", "node_key", urls.relative_path(F.col("p"), F.lit("/out/Root/Other")).alias("relative"))


# Documents with letters turned into tabs, no-break spaces and line separators, so that blanks matter.
NOISY_SQL = "noisy AS (SELECT doc_id, translate(text, 'xwk', chr(9) || chr(160) || chr(8232)) AS t FROM documents)"


def noisy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "xwk", "\t\u00a0\u2028").alias("t"))


@query("x1_clean_text", f"""WITH {NOISY_SQL}, done AS (SELECT doc_id, {Q.clean('t')} AS c FROM noisy)
SELECT doc_id, md5(c) AS text_md5, length(c)::BIGINT AS n_chars FROM done""")
def clean_text(spark, sf_dir):
    done = noisy(spark, sf_dir).withColumn("c", X.clean_text(F.col("t")))
    return done.select("doc_id", F.md5("c").alias("text_md5"), F.char_length("c").cast("bigint").alias("n_chars"))


@query("x2_normalize_whitespace", f"""WITH {NOISY_SQL}, done AS (SELECT doc_id, {Q.squeeze('t')} AS c FROM noisy)
SELECT doc_id, md5(c) AS text_md5, length(c)::BIGINT AS n_chars FROM done""")
def normalize_whitespace(spark, sf_dir):
    done = noisy(spark, sf_dir).withColumn("c", X.normalize_whitespace(F.col("t")))
    return done.select("doc_id", F.md5("c").alias("text_md5"), F.char_length("c").cast("bigint").alias("n_chars"))


@query("x3_truncate_text", f"SELECT doc_id, {Q.truncated('text', 500)} AS short FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_text(F.col("text"), 500).alias("short"))


@query("x4_outline_label", f"""WITH named AS (
  SELECT 'part' AS source, p_partkey AS id, p_name || ' "' || p_brand || '" `' || p_type || '`' AS t FROM part
  UNION ALL SELECT 'document', doc_id, text FROM documents),
clean AS (SELECT source, id, {Q.squeeze("replace(replace(t, chr(34), chr(39)), chr(96), '')")} AS t FROM named)
SELECT source, id, {Q.truncated('t', 60)} AS label FROM clean""")
def outline_label(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(' "'), "p_brand", F.lit('" `'), "p_type", F.lit("`")).alias("t"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return part.unionByName(docs).select("source", "id", X.sanitize_label(F.col("t")).alias("label"))


# Names to sanitise: page titles and whole documents, some of them with forbidden characters put in.
NAMES_SQL = """names AS (
  SELECT 'page' AS source, page_id AS id, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS name, url AS parent FROM pages
  UNION ALL SELECT 'document', doc_id, replace(replace(text, ', ', ' / '), '. ', '?: '), repeat(source || '-', (doc_id % 60)::INTEGER) FROM documents)"""


def names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), page_title(F.col("html")).alias("name"), F.col("url").alias("parent"))
    text = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" / ")), F.lit(". "), F.lit("?: "))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), text.alias("name"),
        F.expr("repeat(concat(source, '-'), cast(doc_id % 60 as int))").alias("parent"))
    return pages.unionByName(docs)


@query("x5_safe_filename", f"""WITH {NAMES_SQL}, bare AS (
  SELECT source, id, {Q.squeeze("regexp_replace(name, " + Q.quoted(X.FORBIDDEN) + ", '', 'g')")} AS n FROM names),
cut AS (SELECT source, id, {Q.byte_prefix('n', 255)} AS n FROM bare)
SELECT source, id, CASE WHEN n = '' THEN 'unnamed' ELSE n END AS file_name FROM cut""")
def safe_filename(spark, sf_dir):
    return names(spark, sf_dir).select("source", "id", X.safe_filename(F.col("name")).alias("file_name"))


@query("x6_replace_forbidden", f"WITH {NAMES_SQL} SELECT source, id, md5({Q.underscored('name')}) AS name_md5 FROM names")
def replace_forbidden(spark, sf_dir):
    return names(spark, sf_dir).select("source", "id", F.md5(X.replace_forbidden(F.col("name"))).alias("name_md5"))


@query("x7_path_budget", f"""WITH {NAMES_SQL}
SELECT source, id, {Q.path_name('name', 'parent', 250, False)} AS document_name, {Q.path_name('name', 'parent', 255, True)} AS folder_name FROM names""")
def path_budget(spark, sf_dir):
    name, parent = F.col("name"), F.col("parent")
    return names(spark, sf_dir).select(
        "source", "id", X.path_name(name, parent, 250).alias("document_name"),
        X.path_name(name, parent, 255, True).alias("folder_name"))


@query("x8_hash_name", f"WITH {NAMES_SQL} SELECT source, id, {Q.hashed('name')} AS hash_name FROM names")
def hash_name(spark, sf_dir):
    return names(spark, sf_dir).select("source", "id", X.hash_name(F.col("name")).alias("hash_name"))


@query("x10_text_hash", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[X.text_hash(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("x11_from_1601", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS added FROM events""")
def from_1601(spark, sf_dir):
    micros = (times.epoch_micros(F.col("ts")) + F.lit(times.EPOCH_1601_GAP)).cast("string")
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("invalid "), micros))
            .when(F.col("event_type") == "signup", F.concat(micros, F.lit("999"))).otherwise(micros))
    back = times.from_1601(text)
    # The instant is shown from its own micros, so that the session zone does not matter.
    shown = F.timestamp_add("MICROSECOND", F.unix_micros(back), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", times.iso_text(shown).alias("added"))


@query("x12_from_1601_legacy", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE strftime(make_timestamp(event_id * 97000003 * 10), '%Y-%m-%dT%H:%M:%S.%f') END AS added FROM events""")
def from_1601_legacy(spark, sf_dir):
    """Times in the spelling of old ledgers, with a hundred thousand units a second, read back."""
    units = (F.col("event_id") * 97_000_003 + 1_164_447_360_000).cast("string")
    back = times.from_1601_legacy(F.when(F.col("event_type") == "error", F.concat(F.lit("~"), units)).otherwise(units))
    shown = F.timestamp_add("MICROSECOND", F.unix_micros(back), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", times.iso_text(shown).alias("added"))


@query("x13_format_duration", f"""WITH {ATTEMPTS_CTE}, gaps AS (
  SELECT event_id, (bytes / 4000.0)::DOUBLE AS seconds FROM attempts)
SELECT event_id, CASE WHEN seconds < 60 THEN format('{{:.1f}} сек', seconds) WHEN seconds < 3600 THEN format('{{:.1f}} мин', seconds / 60.0::DOUBLE)
  ELSE format('{{:.1f}} час', seconds / 3600.0::DOUBLE) END AS shown FROM gaps""")
def format_duration(spark, sf_dir):
    seconds = F.col("bytes") / F.lit(4000.0)
    return attempts(spark, sf_dir).select("event_id", times.format_duration(seconds).alias("shown"))


@query("x14_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def iso_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.iso_text(F.col("ts")).alias("iso"))


@query("x15_settings_fingerprint", """
SELECT c_custkey, sha256('{"generate_mermaid_diagram": ' || CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END ||
  ', "llm_max_tokens": ' || (500 + c_nationkey) || ', "llm_model": "' || c_mktsegment || '", "llm_temperature": 0.' || (1 + c_nationkey % 9) ||
  ', "markdown_include_metadata": ' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || ', "output_dir": "' || c_name || '"}') AS config_hash FROM customer""")
def settings_fingerprint(spark, sf_dir):
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", settings_hash(
        model=F.col("c_mktsegment"), max_tokens=500 + nation, temperature=(1 + nation % 9) / F.lit(10.0),
        output_dir=F.col("c_name"), metadata=F.col("c_acctbal") > 0, diagram=nation % 2 == 0).alias("config_hash"))
