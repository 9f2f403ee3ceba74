"""Functions callable from SQL: inlined SQL functions, the page reader, a table function, tolerant evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from linkatlas.functions.html import DEFAULT_LIMIT_MB, limit_bytes, read_each, read_markup
from linkatlas.functions.text import ANY_BLANK, BLANK_CHARS, FORBIDDEN, LINE_BREAKS
from linkatlas.functions.times import EPOCH_1601_GAP, FIRST_MICRO, ISO_PATTERN, LAST_MICRO
from linkatlas.functions.urls import IGNORED, NETLOC, VALID_URL
from linkatlas.operators.tree import PAD, SECTIONS, TOP, TOP_KEY, UNTITLED


def _raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    return 'r"' + pattern.replace('"', r"\x22") + '"'


BLANK_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in BLANK_CHARS) + "'"
SQUEEZED = "trim(regexp_replace({c}, " + _raw(f"(?U){ANY_BLANK}+") + ", ' '))"

def _whole_characters(text: str, limit: int) -> str:
    """SQL for the longest prefix of whole characters within ``limit`` bytes."""
    cuts = ", ".join(f"try_validate_utf8(CAST(substring(encode({text}, 'UTF-8'), 1, {limit - back}) AS STRING))" for back in range(4))
    return f"CASE WHEN octet_length({text}) <= {limit} THEN {text} ELSE coalesce({cuts}, '') END"


EMPTY = "''"
STEPS = "filter(split({c}, '/'), p -> p <> '' AND p <> '.')"
ANCHOR = "if(startswith({c}, '/'), array('/'), cast(array() AS ARRAY<STRING>))"


def _lexical(c: str) -> str:
    """SQL for the components of a path."""
    return f"concat({ANCHOR}, {STEPS})".replace("{c}", c)


def _resolved(c: str) -> str:
    """SQL for the components of a path with '..' resolved; '..' at the top is dropped."""
    up = "slice(kept, 1, greatest(size(kept) - 1, 0))"
    return f"concat({ANCHOR}, aggregate({STEPS}, cast(array() AS ARRAY<STRING>), (kept, step) -> if(step = '..', {up}, concat(kept, array(step)))))".replace("{c}", c)


# name -> (parameters, result type, expression); Catalyst inlines them, no Python runs.
SQL_FUNCTIONS = {
    "is_valid_url": ("u STRING", "BOOLEAN", f"coalesce(regexp_like(translate(u, {IGNORED!r}, ''), {_raw(VALID_URL)}), false)"),
    "extract_domain": ("u STRING", "STRING", f"nullif(regexp_extract(translate(u, {IGNORED!r}, ''), {_raw(NETLOC)}, 1), '')"),
    "clean_text": (
        "t STRING", "STRING",
        f"coalesce(trim(BOTH {BLANK_LITERAL} FROM regexp_replace(t, "
        + _raw(f"(?U)(?={ANY_BLANK}){ANY_BLANK}*[{LINE_BREAKS} ]{ANY_BLANK}*") + ", ' ')), '')"),
    "normalize_whitespace": ("t STRING", "STRING", SQUEEZED.format(c="t")),
    "truncate_text": (
        "t STRING, n INT, suffix STRING DEFAULT '...'", "STRING",
        "CASE WHEN n < char_length(suffix) THEN raise_error('limit is shorter than the suffix') "
        "WHEN char_length(t) <= n THEN t ELSE concat(left(t, n - char_length(suffix)), suffix) END"),
    "sanitize_label": (
        "t STRING, n INT DEFAULT 60", "STRING",
        "CASE WHEN char_length({s}) <= n THEN {s} ELSE concat(left({s}, n - 3), '...') END".replace("{s}", SQUEEZED.format(c="""translate(t, '"`', "'")"""))),
    "safe_filename": ("t STRING", "STRING", f"coalesce(nullif({_whole_characters(SQUEEZED.format(c=f'regexp_replace(t, {_raw(FORBIDDEN)}, {EMPTY})'), 255)}, ''), if(t IS NULL, NULL, 'unnamed'))"),
    "text_hash": (
        "t STRING, algorithm STRING DEFAULT 'md5'", "STRING",
        "CASE algorithm WHEN 'md5' THEN md5(t) WHEN 'sha1' THEN sha1(t) WHEN 'sha256' THEN sha2(t, 256) ELSE raise_error(concat('unsupported hash algorithm: ', algorithm)) END"),
    "iso_text": ("ts TIMESTAMP_NTZ", "STRING", f'date_format(ts, "{ISO_PATTERN}")'),
    "is_safe_path": ("path STRING, base STRING", "BOOLEAN", "slice({p}, 1, size({b})) = {b}".replace("{p}", _resolved("path")).replace("{b}", _resolved("base"))),
    "relative_path": (
        "path STRING, base STRING", "STRING",
        "CASE WHEN slice({p}, 1, size({b})) = {b} THEN coalesce(nullif(array_join(slice({p}, size({b}) + 1, greatest(size({p}) - size({b}), 0)), '/'), ''), '.') ELSE path END"
        .replace("{p}", _lexical("path")).replace("{b}", _lexical("base"))),
    "replace_forbidden": ("t STRING", "STRING", SQUEEZED.format(c=f"regexp_replace(t, {_raw(FORBIDDEN)}, '_')")),
    "hash_name": ("t STRING", "STRING", "concat('item_', left(md5(t), 8))"),
    "from_1601": (
        "t STRING", "TIMESTAMP",
        f"CASE WHEN try_cast(t AS BIGINT) BETWEEN {FIRST_MICRO + EPOCH_1601_GAP} AND {LAST_MICRO + EPOCH_1601_GAP} "
        f"THEN timestamp_micros(try_cast(t AS BIGINT) - {EPOCH_1601_GAP}) END"),
    "format_duration": (
        "s DOUBLE", "STRING",
        "CASE WHEN s < 60 THEN concat(format_number(s, '0.0'), ' сек') WHEN s < 3600 THEN concat(format_number(s / 60.0D, '0.0'), ' мин') "
        "ELSE concat(format_number(s / 3600.0D, '0.0'), ' час') END"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")


@F.arrow_udf(StringType())
def parsed_page(html: pa.Array) -> pa.Array:
    """The raw text that the parser finds in a page; no markup gives ''."""
    return read_each(html, lambda page: read_markup(page) if page else "")


class BookmarkNodes:
    """Table function ``bookmark_nodes(doc)``: the nodes of one small export, for lateral joins.

    ``operators.tree.flatten_exports`` is the form for big inputs.
    """

    def eval(self, doc: str):
        try:
            roots = json.loads(doc)["roots"]
        except (TypeError, KeyError, ValueError):
            return
        if not isinstance(roots, dict):
            return
        yield TOP_KEY, None, "folder", TOP, None, 0, 0
        yield from self._children(TOP_KEY, [(roots.get(k), label) for k, label in SECTIONS if roots.get(k)], 1)

    def _children(self, parent, nodes, depth):
        seen = {"folder": 0, "url": 0}
        for node, default in nodes:
            kind = self._kind(node)
            if kind is None:
                continue
            place = seen[kind]
            seen[kind] += 1
            key = f"{parent}/{'f' if kind == 'folder' else 'b'}{place:0{PAD}d}"
            yield key, parent, kind, node.get("name") or default, node.get("url") if kind == "url" else None, place, depth
            if kind == "folder":
                yield from self._children(key, [(c, UNTITLED) for c in node.get("children") or []], depth + 1)

    @staticmethod
    def _kind(node):
        if not isinstance(node, dict):
            return None
        kind = (node.get("type") or "").lower()
        if not kind and isinstance(node.get("children"), list):
            return "folder"
        return kind if kind == "folder" or (kind == "url" and node.get("url")) else None


NODE_SHAPE = "node_key string, parent_key string, kind string, title string, url string, ordinal int, depth int"


def register_python_functions(spark: SparkSession) -> None:
    spark.udf.register("parsed_page", parsed_page)
    register_sql_functions(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION capped_text(t STRING) RETURNS STRING RETURN {_whole_characters('t', limit_bytes(DEFAULT_LIMIT_MB))}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_text(html STRING) RETURNS STRING RETURN capped_text(clean_text(parsed_page(html)))")
    spark.udtf.register("bookmark_nodes", F.udtf(BookmarkNodes, returnType=NODE_SHAPE))


def tolerant(fn: Callable[[Any], int], default: int):
    """A function as a column function that gives ``(value, error)``: the default and the message when it raises."""
    shape = StructType([StructField("value", IntegerType()), StructField("error", StringType())])

    def one(x):
        try:
            return fn(x), None
        except Exception as e:
            return default, f"{type(e).__name__}: {e}"

    @F.pandas_udf(shape)
    def wrapped(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["value", "error"]).astype({"value": "int32"})

    return wrapped
