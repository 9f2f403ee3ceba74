"""One query per operator, with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.llm import exact, language, licenses, minhash, negatives, packing, prefixtrie, shards, substring, tokens, topk, toxicity, urls
from linkatlas.session import scratch_path
from linkatlas.sources.tables import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Host, path and verdict of the URL rules.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM tokens),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
    FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
steps AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, steps.y FROM reach JOIN steps ON reach.y = steps.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = x
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judged_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN strpos(rest, '/') > 0 THEN rest[strpos(rest, '/'):] ELSE '' END AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
    SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS v
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM norm
"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i]))::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op5_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.coding_digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(table(spark, sf_dir, "documents"), window=50)


OP6_SQL = r"""
WITH tokens AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM starts),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE doc_id > least),
covered AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, range(0, 50) r(j)),
kept AS (
    SELECT doc_id, count(c.pos) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL), '') AS k
    FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM tokens) p LEFT JOIN covered c USING (doc_id, pos) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM tokens t LEFT JOIN kept USING (doc_id)
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_shards(table(spark, sf_dir, "documents"), WORD_VOCABULARY, scratch_path(spark, "shards"), key=20240601)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS anchor_id, q.label AS mine, r.vec_id, r.label, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i]))::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = mine
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> mine AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def _values(templates: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{label}', '{text}')" for label, text in templates)


OP12_SQL = rf"""
WITH tokens AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
phrases(label, body) AS (VALUES {_values(licenses.PHRASES)}),
notices(label, body) AS (VALUES {_values(licenses.NOTICES)}),
places AS (
    SELECT r, label, i - 1 AS start FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM tokens) t, phrases
    WHERE w[i:i + len(string_split(body, ' ')) - 1] = string_split(body, ' ')),
parts AS (SELECT label, len(t) AS total, j - 1 AS tpos, t[j] || ' ' || t[j + 1] || ' ' || t[j + 2] AS g
    FROM (SELECT label, string_split(body, ' ') AS t, unnest(range(1, len(string_split(body, ' ')) - 1)) AS j FROM notices)),
grams AS (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM tokens)),
votes AS (SELECT r, label, total, tpos, pos - tpos AS d FROM grams JOIN parts USING (g)),
lines AS (SELECT r, label, d, coalesce(d - lag(d) OVER (PARTITION BY r, label ORDER BY d) > {licenses.GAP}, false) AS far FROM (SELECT DISTINCT r, label, d FROM votes)),
spans AS (SELECT r, label, d, sum(far::INT) OVER (PARTITION BY r, label ORDER BY d) AS span FROM lines),
covers AS (
    SELECT r, label, span, count(DISTINCT tpos + k)::DOUBLE / max(total) AS coverage
    FROM votes JOIN spans USING (r, label, d), (VALUES (0), (1), (2)) o(k) GROUP BY r, label, span),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT r, label FROM places UNION SELECT r, label FROM covers WHERE coverage * 100 >= {licenses.PERCENT}) GROUP BY r),
scored AS (SELECT r, max(c) AS score FROM (SELECT r, 1.0::DOUBLE AS c FROM places UNION ALL SELECT r, coverage FROM covers) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM tokens LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN scored USING (r)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS nth FROM turns),
bytes AS (SELECT DISTINCT conv_id, list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)) AS b FROM own),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(b, lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT) % 4 AS h FROM bytes),
begun AS (SELECT c.conv_id, o.nth, o.k, o.w FROM convs c JOIN own o ON o.conv_id = c.first AND o.nth <= c.h),
seqs AS (
    SELECT conv_id, 0 AS part, nth, k, w FROM begun
    UNION ALL SELECT o.conv_id, 1, o.nth, o.k, o.w FROM own o JOIN convs c USING (conv_id) WHERE o.nth > c.h),
lists AS (
    SELECT conv_id, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws
    FROM convs LEFT JOIN (SELECT conv_id, list(k ORDER BY part, nth) AS ks, list(w ORDER BY part, nth) AS ws FROM seqs GROUP BY conv_id) USING (conv_id)),
prefixes AS (
    SELECT conv_id, d, array_to_string(ks[1:d], ',') AS key, array_to_string(ks[1:d - 1], ',') AS up, ws[d] AS w, d = len(ks) AS ended
    FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM lists)),
nodes AS (
    SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, coalesce(max(w), 0) AS w,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM prefixes GROUP BY d, key),
children AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, key)),
sums AS (
    SELECT a.d, a.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * CASE WHEN k.d = 0 THEN 0 ELSE k.w END) AS saved
    FROM known k JOIN prefixes a ON a.conv_id = k.conv_id AND a.d <= k.d GROUP BY a.d, a.key)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON k.d = s.d AND k.key = s.key LEFT JOIN known p ON k.d > 0 AND p.d = k.d - 1 AND p.key = k.up
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_near_dedup, op2_url_filters, op3_exact_dedup, op4_exact_top_k, op5_bpe_coding, op6_substring_dedup, op7_best_fit_packing,
        op8_token_shards, op9_language_id, op10_toxicity, op11_hard_negatives, op12_license_scan, op13_prefix_trie)
}
CHECKS: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL, "op2_url_filters": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_exact_top_k": OP4_SQL,
    "op6_substring_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_prefix_trie": OP13_SQL,
}
