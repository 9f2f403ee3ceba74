"""Derived inputs: projections of the given tables that both engines can build.

Every function here has its DuckDB twin as a CTE text below, used by the checks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkatlas.functions.html import page_title
from linkatlas.functions.times import EPOCH_1601_GAP, epoch_micros
from linkatlas.functions.urls import extract_domain
from linkatlas.operators.fetchlog import final_outcomes
from linkatlas.operators.tree import NODE_COLUMNS, PAD, TOP, child_key, fold_exports
from linkatlas.session import durable
from linkatlas.sources.tables import table

# Parameters of the derivation: pages per export, so that a document is bounded whatever the data size.
PAGES_PER_EXPORT = 25


def link_pages(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """Pages as saved links: title, host, section, language; the markup itself is left behind.

    Only the title comes out of the markup: with ``titled=False`` it is null, and the scan leaves the pages' text unread.
    """
    host = extract_domain(F.col("url"))
    section = (
        F.when(F.endswith(host, F.lit(".com")), 0).when(F.endswith(host, F.lit(".org")), 2).otherwise(1)
    )
    title = page_title(F.col("html")) if titled else F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", title.alias("title"), host.alias("host"), section.alias("section_rank"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"),
        F.concat(F.lit("x"), F.lpad(F.floor(F.col("page_id") / PAGES_PER_EXPORT).cast("string"), PAD, "0")).alias("export_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("page_id") * 61_000_003).alias("date_added"),
    )


def nodes(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """Folder tree Root / section / host / language / page, one tree per export of 25 pages.

    An export has at most 25 pages, so the ranks inside it never meet a large group; one shuffle by
    export serves all of them and the removal of repeated folders.
    """
    def rank(keys: list[str], by: str, of=F.dense_rank):
        return of().over(Window.partitionBy("export_id", *keys).orderBy(by)) - 1

    label = F.when(F.col("section_rank") == 0, "Bookmark Bar").when(F.col("section_rank") == 1, "Other").otherwise("Mobile")
    ranked = (
        link_pages(spark, sf_dir, titled).repartition("export_id")
        .withColumn("so", rank([], "section_rank"))
        .withColumn("ho", rank(["section_rank"], "host"))
        .withColumn("lo", rank(["section_rank", "host"], "lang"))
        .withColumn("bo", rank(["section_rank", "host", "lang"], "page_id", F.row_number))
        .withColumn("label", label)
    )
    folder, leaf = F.lit("folder"), F.lit("url")
    keyed = (
        ranked.withColumn("k0", F.lit("R"))
        .withColumn("k1", child_key(F.col("k0"), folder, F.col("so")))
        .withColumn("k2", child_key(F.col("k1"), folder, F.col("ho")))
        .withColumn("k3", child_key(F.col("k2"), folder, F.col("lo")))
        .withColumn("k4", child_key(F.col("k3"), leaf, F.col("bo")))
    )
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    names = [F.lit(TOP), F.col("label"), F.col("host"), F.col("lang")]

    def row(depth: int, ordinal, parent, kind, title, url, added):
        return F.struct(
            F.col(f"k{depth}").alias("node_key"), parent.alias("parent_key"), kind.alias("kind"), title.alias("title"),
            url.alias("url"), added.alias("date_added"), ordinal.cast("int").alias("ordinal"), F.lit(depth).alias("depth"),
            F.array(*names[: min(depth, 3) + 1]).alias("folder_path"),
        )

    rows = F.array(
        row(0, F.lit(0), none, folder, names[0], none, no_time),
        row(1, F.col("so"), F.col("k0"), folder, names[1], none, no_time),
        row(2, F.col("ho"), F.col("k1"), folder, names[2], none, no_time),
        row(3, F.col("lo"), F.col("k2"), folder, names[3], none, no_time),
        row(4, F.col("bo"), F.col("k3"), leaf, F.col("title"), F.col("url"), F.col("date_added")),
    )
    return keyed.select("export_id", F.inline(rows)).dropDuplicates(["export_id", "node_key"]).select(*NODE_COLUMNS)


def stored_nodes(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """``nodes`` written once, for operators that read the table several times."""
    return durable(nodes(spark, sf_dir, titled))


def bookmarks(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    return nodes(spark, sf_dir, titled).filter(F.col("kind") == "url")


# Pages of a large export, levels of folders in it, and the digits of a page's place, one for each level.
LARGE, LEVELS = 1000, 10


def large_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of up to 1000 pages that are wide and deep: the first section holds every page in one folder, the second has ten levels of folders, two to a folder, by the binary digits
    of the page's place, and each page twice at the lowest one. A folder comes from its first page, so nothing is repeated.
    """
    place = (F.col("page_id") % LARGE).cast("bigint")
    pad = lambda c: F.lpad(c.cast("string"), PAD, "0")
    section = lambda i: F.concat(F.lit("R/f"), F.lpad(F.lit(str(i)), PAD, "0"))
    group = lambda level: F.floor(F.col("place") / F.pow(F.lit(2), LEVELS - level)).cast("bigint")
    names = lambda upto: F.transform(F.sequence(F.lit(1), upto), lambda i: F.concat(F.lit("L"), i.cast("string"), F.lit("-"), group(i).cast("string")))
    key = lambda upto: F.concat(section(1), F.array_join(F.transform(F.sequence(F.lit(1), upto), lambda i: F.concat(F.lit("/f"), pad(group(i) % 2))), ""))
    none, no_time, folder, leaf = F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.lit("folder"), F.lit("url")

    def row(node_key, parent, kind, title, ordinal, depth, path, own=False):
        return F.struct(node_key.alias("node_key"), parent.alias("parent_key"), kind.alias("kind"), title.alias("title"), (F.col("url") if own else none).alias("url"),
                        (F.col("date_added") if own else no_time).alias("date_added"), ordinal.cast("int").alias("ordinal"), depth.cast("int").alias("depth"), path.alias("folder_path"))

    bar, other = F.array(F.lit(TOP), F.lit("Bookmark Bar")), F.array(F.lit(TOP), F.lit("Other"))
    whole = F.lit(LEVELS)
    tops = F.when(F.col("place") == 0, F.array(
        row(F.lit("R"), none, folder, F.lit(TOP), F.lit(0), F.lit(0), F.array(F.lit(TOP))), row(section(0), F.lit("R"), folder, F.lit("Bookmark Bar"), F.lit(0), F.lit(1), bar),
        row(section(1), F.lit("R"), folder, F.lit("Other"), F.lit(1), F.lit(1), other)))
    leaves = F.array(row(F.concat(section(0), F.lit("/b"), pad(F.col("place"))), section(0), leaf, F.col("title"), F.col("place"), F.lit(2), bar, True), *[
        row(F.concat(key(whole), F.lit("/b"), pad(F.lit(i))), key(whole), leaf, F.col("title"), F.lit(i), F.lit(LEVELS + 2), F.concat(other, names(whole)), True) for i in range(2)])
    begun = F.filter(F.sequence(F.lit(1), whole), lambda i: F.col("place") % F.pow(F.lit(2), LEVELS - i).cast("bigint") == 0)
    parents = lambda i: F.when(i == 1, section(1)).otherwise(key(i - 1))
    folders = F.transform(begun, lambda i: row(key(i), parents(i), folder, F.concat(F.lit("L"), i.cast("string"), F.lit("-"), group(i).cast("string")), group(i) % 2, i + 1, F.concat(other, names(i))))
    pages = link_pages(spark, sf_dir).withColumn("place", place).withColumn("export_id", F.concat(F.lit("z"), F.floor(F.col("page_id") / LARGE).cast("string")))
    empty = F.array().cast(folders_type())
    return pages.select("export_id", F.inline(F.concat(F.coalesce(tops, empty), leaves, folders))).select(*NODE_COLUMNS)


def folders_type() -> str:
    return ("array<struct<node_key: string, parent_key: string, kind: string, title: string, url: string, date_added: timestamp, ordinal: int, depth: int, folder_path: array<string>>>")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes`` folded back to JSON documents. Both stand in for stored tables, so both are written once."""
    return durable(fold_exports(stored_nodes(spark, sf_dir)))


def damaged_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents again, four of five spoilt in a way that depends on the export number."""
    kind = F.pmod(F.substring("export_id", 2, PAD).cast("bigint"), F.lit(5))
    raw = (
        F.when(kind == 1, F.concat(F.lit("{"), "raw"))
        .when(kind == 2, F.concat(F.lit("["), "raw", F.lit("]")))
        .when(kind == 3, F.replace("raw", F.lit('"roots":'), F.lit('"root":')))
        .when(kind == 4, F.lit('{"version":1,"roots":[]}'))
        .otherwise(F.col("raw"))
    )
    return exports(spark, sf_dir).select("export_id", raw.alias("raw"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_attempts(table(spark, sf_dir, "events"))


def shape_attempts(events: DataFrame) -> DataFrame:
    """Fetch attempts, one per event. Times stay without zone; ``us`` is the same in microseconds."""
    status = (
        F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 301)
        .when(F.col("event_type") == "purchase", 404).when(F.col("event_type") == "signup", 503)
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("host"),
        (F.col("event_id") % 50).alias("url_id"),
        F.floor(F.col("event_id") / 200).alias("episode"),
        (F.floor(F.col("event_id") / 50) % 4).cast("int").alias("attempt"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        epoch_micros(F.col("ts")).alias("us"),
        status.alias("status"),
        F.when((status == 301) & (F.col("value") >= 10), F.concat(F.lit("https://to.example.org/"), "event_id")).alias("location"),
        F.round(F.col("value") * 100000).cast("bigint").alias("bytes"),
        F.when(status.isNull(), "transport error").alias("error"),
    )


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: where it redirects to, NULL when it answers itself.

    Pages with a query or a fragment in their URL redirect to page 7i+1 modulo the page count, others
    do not; every eleventh redirects to itself and a third of the rest to page 0.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    total = pages.count()
    target = (
        F.when(F.col("page_id") % 11 == 5, F.col("page_id"))
        .when(F.col("page_id") % 3 == 1, F.lit(0))
        .otherwise((F.col("page_id") * 7 + 1) % total)
    )
    moved = F.regexp_like("url", F.lit("[?#]")) | (F.col("page_id") % 11 == 5)
    return pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"),
        F.when(moved, F.concat(F.lit("p"), target.cast("string"))).alias("dst"),
    )


PAGES_CTE = f"""
link_pages AS (
  SELECT page_id, url, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS title,
         split_part(url, '/', 3) AS host,
         CASE WHEN split_part(url, '/', 3) LIKE '%.com' THEN 0 WHEN split_part(url, '/', 3) LIKE '%.org' THEN 2 ELSE 1 END AS section_rank,
         split_part(url, '/', 4) AS lang,
         'x' || lpad((page_id // {PAGES_PER_EXPORT})::VARCHAR, {PAD}, '0') AS export_id,
         make_timestamp(1704067200000000 + page_id * 61000003) AS date_added
  FROM pages)"""

NODES_CTE = PAGES_CTE + f""",
ranked_pages AS (
  SELECT *, CASE section_rank WHEN 0 THEN 'Bookmark Bar' WHEN 1 THEN 'Other' ELSE 'Mobile' END AS label,
    dense_rank() OVER (PARTITION BY export_id ORDER BY section_rank) - 1 AS so,
    dense_rank() OVER (PARTITION BY export_id, section_rank ORDER BY host) - 1 AS ho,
    dense_rank() OVER (PARTITION BY export_id, section_rank, host ORDER BY lang) - 1 AS lo,
    row_number() OVER (PARTITION BY export_id, section_rank, host, lang ORDER BY page_id) - 1 AS bo
  FROM link_pages),
keyed_pages AS (
  SELECT *, 'R' AS k0, 'R/f' || lpad(so::VARCHAR, {PAD}, '0') AS k1,
    k1 || '/f' || lpad(ho::VARCHAR, {PAD}, '0') AS k2, k2 || '/f' || lpad(lo::VARCHAR, {PAD}, '0') AS k3,
    k3 || '/b' || lpad(bo::VARCHAR, {PAD}, '0') AS k4
  FROM ranked_pages),
nodes AS (
  SELECT DISTINCT export_id, k0 AS node_key, NULL::VARCHAR AS parent_key, 'folder' AS kind, 'Root' AS title, NULL::VARCHAR AS url, NULL::TIMESTAMP AS date_added, 0 AS ordinal, 0 AS depth, 'Root' AS path FROM keyed_pages
  UNION ALL SELECT DISTINCT export_id, k1, k0, 'folder', label, NULL, NULL, so, 1, 'Root/' || label FROM keyed_pages
  UNION ALL SELECT DISTINCT export_id, k2, k1, 'folder', host, NULL, NULL, ho, 2, 'Root/' || label || '/' || host FROM keyed_pages
  UNION ALL SELECT DISTINCT export_id, k3, k2, 'folder', lang, NULL, NULL, lo, 3, 'Root/' || label || '/' || host || '/' || lang FROM keyed_pages
  UNION ALL SELECT export_id, k4, k3, 'url', title, url, date_added, bo, 4, 'Root/' || label || '/' || host || '/' || lang FROM keyed_pages)"""

LARGE_CTE = PAGES_CTE + f""",
placed AS (SELECT *, 'z' || page_id // {LARGE} AS large_id, page_id % {LARGE} AS place FROM link_pages),
steps AS (SELECT large_id, page_id, place, l, place // (1 << ({LEVELS} - l)) AS g FROM placed, range(1, {LEVELS + 1}) r(l)),
ways AS (SELECT large_id, page_id, l, g, string_agg('/f' || lpad((g % 2)::VARCHAR, {PAD}, '0'), '') OVER w AS steps, string_agg('/L' || l || '-' || g, '') OVER w AS names,
    place % (1 << ({LEVELS} - l)) = 0 AS begins FROM steps WINDOW w AS (PARTITION BY page_id ORDER BY l)),
ends AS (SELECT p.*, w.steps, w.names, 'R/f' || lpad('1', {PAD}, '0') || w.steps AS folder_key FROM placed p JOIN ways w USING (page_id) WHERE l = {LEVELS}),
nodes AS (
  SELECT DISTINCT large_id AS export_id, 'R' AS node_key, NULL::VARCHAR AS parent_key, 'folder' AS kind, 'Root' AS title, NULL::VARCHAR AS url, NULL::TIMESTAMP AS date_added, 0 AS ordinal, 0 AS depth, 'Root' AS path FROM placed
  UNION ALL SELECT DISTINCT large_id, 'R/f' || lpad(i::VARCHAR, {PAD}, '0'), 'R', 'folder', CASE i WHEN 0 THEN 'Bookmark Bar' ELSE 'Other' END, NULL, NULL, i, 1, 'Root/' || CASE i WHEN 0 THEN 'Bookmark Bar' ELSE 'Other' END FROM placed, range(2) r(i)
  UNION ALL SELECT large_id, 'R/f' || lpad('0', {PAD}, '0') || '/b' || lpad(place::VARCHAR, {PAD}, '0'), 'R/f' || lpad('0', {PAD}, '0'), 'url', title, url, date_added, place, 2, 'Root/Bookmark Bar' FROM placed
  UNION ALL SELECT large_id, folder_key || '/b' || lpad(i::VARCHAR, {PAD}, '0'), folder_key, 'url', title, url, date_added, i, {LEVELS + 2}, 'Root/Other' || names FROM ends, range(2) r(i)
  UNION ALL SELECT large_id, 'R/f' || lpad('1', {PAD}, '0') || steps, 'R/f' || lpad('1', {PAD}, '0') || left(steps, length(steps) - {PAD + 2}), 'folder', 'L' || l || '-' || g, NULL, NULL, (g % 2)::BIGINT, l + 1, 'Root/Other' || names FROM ways WHERE begins)"""

ATTEMPTS_CTE = """
attempts AS (
  SELECT event_id, user_id AS host, event_id % 50 AS url_id, event_id // 200 AS episode,
    ((event_id // 50) % 4)::INTEGER AS attempt, ts::TIMESTAMP AS ts, epoch_us(ts) AS us,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 503 END AS status,
    CASE WHEN event_type = 'click' AND value >= 10 THEN 'https://to.example.org/' || event_id END AS location,
    round(value * 100000)::BIGINT AS bytes,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'transport error' END AS error
  FROM events)"""

REDIRECTS_CTE = """
redirects AS (
  SELECT 'p' || page_id AS src,
    CASE WHEN regexp_matches(url, '[?#]') OR page_id % 11 = 5 THEN 'p' ||
      CASE WHEN page_id % 11 = 5 THEN page_id WHEN page_id % 3 = 1 THEN 0 ELSE (page_id * 7 + 1) % (SELECT count(*) FROM pages) END
    END AS dst
  FROM pages)"""


def ledger(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """Run ledger: one record per fetch, about sixteen records per link over the days of the log. Untitled, it reads no markup.

    A fetch that succeeded at the third try or later is taken as processed with an error.
    """
    ends = final_outcomes(attempts(spark, sf_dir), ["url_id", "episode"]).withColumn(
        "link", F.floor((F.col("episode") * 50 + F.col("url_id")) / 16)
    )
    known = link_pages(spark, sf_dir, titled).select(F.col("page_id").alias("link"), "url", "title")
    return ends.join(known, "link", "left").select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.coalesce("url", F.concat(F.lit("https://gone.example.org/"), F.col("link").cast("string"))).alias("url"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        "ts", "us", "outcome",
        F.when(F.col("outcome") == "failed", F.col("error")).when(F.col("tries") >= 3, "summary error").alias("error"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of the log, with version, source and settings that vary by day."""
    day = F.dayofyear("ts")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.when(day % 7 == 3, "0.9").otherwise("1.0").alias("version"),
        F.when(day % 5 == 0, "other.json").otherwise("bookmarks.json").alias("source"),
        F.concat(F.lit("settings-"), (day % 3).cast("string")).alias("config_hash"),
    ).distinct()


def ledger_cte(outcomes_cte: str) -> str:
    """DuckDB twin of ``ledger`` and ``runs``; needs the CTEs of the outcomes and of the page links."""
    return outcomes_cte + "," + PAGES_CTE + """,
ledger AS (
  SELECT 'run-' || strftime(o.ts, '%Y%m%d') AS run_id, coalesce(p.url, 'https://gone.example.org/' || ((o.episode * 50 + o.url_id) // 16)) AS url,
    coalesce(p.title, 'Untitled') AS title, o.ts, epoch_us(o.ts) AS us, o.outcome,
    CASE WHEN o.outcome = 'failed' THEN o.error WHEN o.tries >= 3 THEN 'summary error' END AS error
  FROM outcomes o LEFT JOIN link_pages p ON p.page_id = (o.episode * 50 + o.url_id) // 16),
runs AS (
  SELECT DISTINCT 'run-' || strftime(ts, '%Y%m%d') AS run_id, CASE WHEN dayofyear(ts) % 7 = 3 THEN '0.9' ELSE '1.0' END AS version,
    CASE WHEN dayofyear(ts) % 5 = 0 THEN 'other.json' ELSE 'bookmarks.json' END AS source, 'settings-' || (dayofyear(ts) % 3) AS config_hash FROM events)"""
