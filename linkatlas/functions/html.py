"""HTML to readable text.

Most pages go through native expressions. End tags are matched with their start tags by taking innermost pairs out, round by
round; where one is left inside a removed element or the chosen block, it ends an element around it. Such pages, and those with other markup that
expressions cannot follow exactly (nested or unclosed containers, ruby, odd entities), go to a streaming parser in Arrow batches;
all other rows reach it as NULL and cost nothing there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkatlas.functions.text import clean_text, utf8_prefix
from linkatlas.functions.urls import MEGABYTE

# Elements removed with their content, elements whose text does not count,
# elements without content, the class pattern of a content block, the size limit in MB.
REMOVED = ["script", "style", "nav", "footer", "header"]
UNREAD = ["rt", "rp", "template"]
VOID = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
]
CONTENT_CLASS = "main|content|article"
DEFAULT_LIMIT_MB = 5.0

BLOCKS = "(?is)<(?:!--.*?-->|" + "|".join(rf"{t}\b[^>]*>.*?</{t}\s*>" for t in REMOVED) + ")"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
MAIN = r"(?is)<main\b[^>]*>(.*?)</main\s*>"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article\s*>"
TAG = r"<[/a-zA-Z!?][^>]*>"
# Decoded natively, in this order; the ampersand is last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&")]
# Markup that the expressions may not follow exactly: left-over or unread containers, odd entities, a cut-off tag.
ODD = (
    rf"(?i)<(?:/?(?:{'|'.join(REMOVED)}|{'|'.join(UNREAD)}|textarea|plaintext|xmp|iframe|noembed|noframes)\b"
    r"|!--|!\[|/[^a-zA-Z]|[/a-zA-Z!?][^>]*\z)|&(?!(?:lt|gt|quot|nbsp|copy|middot|amp);)[#a-zA-Z]"
)
QUOTED_CLOSE = r"=\s*(?:\"[^\"<>]*>[^\"]*\"|'[^'<>]*>[^']*')"
# Any opening tag that may be a content div, and the plain spelling that surely is one.
CONTENT_DIV = rf"(?is)<div\b[^>]*\bclass\s*=[^>]*(?:{CONTENT_CLASS})[^>]*>"
PLAIN_DIV = r"(?i)^<div(?:\s+[a-z][a-z0-9-]*=\"[^\"<>&]*\"){1,20}\s*>$"
PLAIN_CLASS = rf"\s[cC][lL][aA][sS][sS]=\"[^\"]*(?:{CONTENT_CLASS})[^\"]*\""
# What has no part in matching tags: comments, raw text, elements without content, elements closed by their own slash.
RAW = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
EMPTY = rf"(?i)<(?:{'|'.join(VOID)})\b[^>]*>"
SELF_CLOSED = r"<[a-zA-Z][^\t\n\r\f />\x00]*(?:\s[^<>]*[\"'\s])?/>"
TAG_NAME = r"</?[a-zA-Z][^\t\n\r\f />\x00]*"
# A start tag and the first end tag behind it, of one name, with nothing but other start tags between. The bound keeps the matcher's stack small.
PAIR = r"<([^/<>]+)>(?:<(?!/|\1>)[^<>]*>){0,64}</\1>"
ROUNDS = 16
PAGES_AT_ONCE = 64


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE, 1)


def drop_blocks(html: Column) -> Column:
    """Comments and the removed elements go, in one pass, so that whichever opens first hides the other."""
    return F.regexp_replace(html, BLOCKS, "")


def _has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def main_block(body: Column) -> Column:
    """Which block holds the text: the first <main>, else the first <article>, else the first <div> of a content class, else the whole page."""
    return F.when(_has(body, MAIN), "main").when(_has(body, ARTICLE), "article").when(_has(body, CONTENT_DIV), "div").otherwise("page")


def main_part(body: Column, block: Column) -> Column:
    """Inside of the chosen block; an empty <main> wins over a filled <article>."""
    return (
        F.when(block == "main", F.regexp_extract(body, MAIN, 1))
        .when(block == "article", F.regexp_extract(body, ARTICLE, 1))
        .when(block == "div", _div_inside(body))
        .otherwise(body)
    )


def _div_inside(body: Column) -> Column:
    """What the first content div holds, up to the end tag that brings the count of open divs back; NULL where none does."""
    opening = F.regexp_extract(body, CONTENT_DIV, 0)
    behind = F.substr(body, F.position(opening, body) + F.char_length(opening))
    pieces = F.split(behind, r"(?i)(?=</?div\b)")
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("seen"), F.lit(0).alias("at"))

    def step(state: Column, piece: Column) -> Column:
        change = F.when(F.regexp_like(piece, F.lit(r"(?i)^<div\b")), 1).when(F.regexp_like(piece, F.lit(r"(?i)^</div\b")), -1).otherwise(0)
        now = state["open"] + change
        return F.struct(now.alias("open"), (state["seen"] + 1).alias("seen"), F.when((state["at"] == 0) & (now == 0), state["seen"] + 1).otherwise(state["at"]).alias("at"))

    # The piece that closes the div is the first that does not count any more.
    end = F.aggregate(pieces, start, step, lambda state: state["at"])
    return F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), end - 1), ""))


def stray_ends(markup: Column) -> Column:
    """Whether an end tag has no start tag of its own inside the markup, so that it would end an element around it.

    The tags alone are looked at. An end tag closes the nearest open element of its name with all that is open inside, so a pair with only start tags
    between goes out whole. What is left after the last round is stray, nested too deep to tell, or an odd spelling; all count as stray.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, RAW, ""), EMPTY, ""), SELF_CLOSED, "")
    tags = F.lower(F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(TAG_NAME), F.lit(0)), lambda t: F.concat(t, F.lit(">"))), ""))
    for _ in range(ROUNDS):
        tags = F.regexp_replace(tags, PAIR, "")
    return F.contains(plain, F.lit("/>")) | F.contains(tags, F.lit("</"))


def plain_text(part: Column) -> Column:
    """Tags vanish without a separator, then entities are decoded."""
    text = F.regexp_replace(part, TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _uneven(html: Column, opening: str, closing: str) -> Column:
    return F.regexp_count(html, F.lit(opening)) != F.regexp_count(html, F.lit(closing))


def needs_parser(html: Column, body: Column, block: Column, part: Column) -> Column:
    """Whether the native path may be inexact for a page.

    An unclosed script, style or comment swallows the rest of the page, even from inside a removed block;
    so does a removed block around one of its own kind. An end tag inside a removed or chosen block may end an element around the block, and the block with it.
    """
    chosen = block != "page"
    removed = F.array_join(F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(0)), "")
    opening = F.regexp_extract(body, CONTENT_DIV, 0)
    plain_div = F.regexp_like(opening, F.lit(PLAIN_DIV)) & (F.regexp_count(opening, F.lit(PLAIN_CLASS)) == 1) & (F.regexp_count(opening, F.lit(r"(?i)\sclass=")) == 1)
    return (
        _has(body, ODD)
        | _uneven(html, r"(?i)<script\b", r"(?i)</script\b")
        | _uneven(html, r"(?i)<style\b", r"(?i)</style\b")
        | _uneven(html, r"(?i)<(?:nav|footer|header)\b", r"(?i)</(?:nav|footer|header)\b")
        | _uneven(html, "<!--", "-->")
        | _has(body, QUOTED_CLOSE)
        | ((block != "main") & _has(body, r"(?i)<main\b"))
        | ((block == "main") & _has(part, r"(?i)<main\b"))
        | ((block != "main") & _has(part, r"(?i)<article\b"))
        | ((block == "div") & (part.isNull() | ~plain_div | _has(body, r"(?i)<article\b")))
        | (_has(html, r"(?i)<(?:nav|footer|header)\b") & stray_ends(removed))
        | (chosen & (stray_ends(F.coalesce(part, F.lit(""))) | _has(part, r"(?i)</(?:body|html)\b")))
    )


class _Reader(HTMLParser):
    """Collects the text of the page and of the first main, article and content div in one pass."""

    # Only these hold raw text, whatever newer versions of the base class add.
    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden_at: int | None = None
        self.text = {"page": []}
        self.inside: dict[str, int] = {"page": -1}

    def handle_starttag(self, tag, attrs):
        if self.hidden_at is None:
            if tag in REMOVED:
                self.hidden_at = len(self.open)
            elif tag in ("main", "article"):
                self._begin(tag)
            elif tag == "div" and re.search(CONTENT_CLASS, dict(attrs).get("class") or ""):
                self._begin("div")
        self.open.append(tag)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if self.hidden_at is None and not any(t in UNREAD for t in self.open):
            for block in self.inside:
                self.text[block].append(data)

    def _begin(self, block):
        if block not in self.text:
            self.text[block] = []
            self.inside[block] = len(self.open)

    def _close(self, depth):
        del self.open[depth:]
        self.inside = {b: d for b, d in self.inside.items() if d < depth}
        if self.hidden_at is not None and self.hidden_at >= depth:
            self.hidden_at = None


def read_markup(html: str) -> str:
    """Text of the preferred block of one page, before blanks are collapsed; broken markup gives ''."""
    try:
        reader = _Reader()
        reader.feed(html)
        reader.close()
    except Exception:
        return ""
    best = next(b for b in ("main", "article", "div", "page") if b in reader.text)
    return "".join(reader.text[best])


def read_each(pages: pa.Array, read: Callable[[str | None], str | None]) -> pa.Array:
    """``read`` of every page. Only some pages are Python objects at a time, so that a batch costs little more than its Arrow buffers."""
    parts = [pa.array([read(p.as_py()) for p in pages.slice(at, PAGES_AT_ONCE)], pa.string()) for at in range(0, len(pages), PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def parsed_text(html: pa.Array) -> pa.Array:
    return read_each(html, lambda page: None if page is None else read_markup(page))


def limit_bytes(limit_mb: float | str | None) -> int:
    """The byte limit of a size setting; a setting that is no number means the default."""
    try:
        return int(float(limit_mb) * MEGABYTE)
    except (TypeError, ValueError, OverflowError):
        return int(DEFAULT_LIMIT_MB * MEGABYTE)


def size_gated(df: DataFrame, html: str = "html", limit_mb: float | str | None = DEFAULT_LIMIT_MB) -> DataFrame:
    """Pages over the size limit are turned away whole: their markup is null, as if nothing had come."""
    return df.withColumn(html, F.when(F.octet_length(html) <= limit_bytes(limit_mb), F.col(html)))


def staged_parts(df: DataFrame, html: str = "html") -> DataFrame:
    """The steps of the extraction as columns of their own, so that each is computed once."""
    return (
        df.withColumn("_body", drop_blocks(F.col(html)))
        .withColumn("_block", main_block(F.col("_body")))
        .withColumn("_part", main_part(F.col("_body"), F.col("_block")))
        .withColumn("_odd", needs_parser(F.col(html), F.col("_body"), F.col("_block"), F.col("_part")))
        .withColumn("_parsed", parsed_text(F.when(F.col("_odd"), F.col(html))))
    )


def with_text(df: DataFrame, html: str = "html", out: str = "text",
              limit_mb: float | str | None = DEFAULT_LIMIT_MB) -> DataFrame:
    """Adds the readable text of an HTML column. Narrow: no shuffle, one Arrow hop for the odd pages."""
    staged = staged_parts(df, html)
    raw = F.when(F.col("_odd"), F.col("_parsed")).otherwise(plain_text(F.col("_part")))
    cleaned = staged.withColumn("_clean", clean_text(raw))
    return cleaned.withColumn(out, utf8_prefix(F.col("_clean"), limit_bytes(limit_mb))).drop(
        "_body", "_block", "_part", "_odd", "_parsed", "_clean"
    )
