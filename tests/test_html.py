"""Extraction rules on small pages, through both paths."""

import pytest

from linkatlas.functions.html import limit_bytes, read_markup, with_text

CASES = {
    "list items touch": ("<main><li>A</li><li>B</li></main>", "AB"),
    "main beats an earlier div": ('<div class="content">x</div><main>y</main>', "y"),
    "empty main wins": ("<main></main><p>z</p>", ""),
    "article when no main": ("<p>a</p><article>b</article><article>c</article>", "b"),
    "class search": ('<p>a</p><div class="maintain box">b</div>', "b"),
    "content box": ('<p>a</p><div id="q" class="x content-box">b<div>c</div>d</div>e', "bcd"),
    "whole page with title": ("<html><head><title>T </title></head><body>x<script>1</script></body></html>", "T x"),
    "nested removed": ("<p>a</p><nav>b<nav>c</nav>d</nav><p>e</p>", "ae"),
    "unclosed main": ("<body><main>a <p>b</body>", "a b"),
    "main inside a removed header": ("<header><main>h</main></header><article>a</article>", "a"),
    "entities": ("<main>a &amp; b &lt;c&gt; &#8364; &eacute;&nbsp;</main>", "a & b <c> € é"),
    "comment hides a tag": ("<main>a<!-- <script> -->b</main>", "ab"),
    "comment inside script": ("<main>a<script><!-- x </script>b</main>", "ab"),
    "quoted bracket": ('<main><a title="x > y">t</a></main>', "t"),
    "nested article": ("<article>a<article>b</article>c</article>d", "abc"),
    "main closed by its parent": ("<div><main>a</div>b</main>", "a"),
    "void elements": ("<main>a<br>b<img src=x>c<br/>d</main>", "abcd"),
    "ruby": ("<main><ruby>k<rt>r</rt></ruby></main>", "k"),
    "tab inside a piece": ("<main>a\tb  c\n\n d</main>", "a\tb c d"),
    "end tag inside a removed block": ("<b>a<footer></b>kept</footer>", "akept"),
    "paragraph ended inside a header": ("<p>x<header><div></p>y</header>z</div>", "xyz"),
    "own unclosed tag does not make up": ("<b><main>a<i></b>c</main>d", "a"),
    "balanced navigation": ("<main>a<nav><ul><li><a href='x'>b</a><li>c</ul></nav>d</main>", "ad"),
    "drawing in a header": ('<p>a</p><header><svg><path d="M0 0"/><g/></svg></header>b', "ab"),
    "content div": ('<p>a</p><div id="x" class="page content">b<div>c</div><span>d</span></div>e', "bcd"),
    "content div ended by its parent": ('<section><div class="content">a</section>b</div>c', "a"),
    "inner div ended by a span": ('<div class="content"><span><div></span>b</div>c</div>', "b"),
    "class of another attribute": ('<p>a</p><div data-main="1" class="x">b</div>c', "abc"),
    "content in capitals": ('<p>a</p><div class="Content">b</div>c', "abc"),
    "no markup": ("plain   text", "plain text"),
    "empty": ("", ""),
}


def test_pages(spark):
    rows = [(k, html) for k, (html, _) in CASES.items()]
    got = {r["k"]: r["text"] for r in with_text(spark.createDataFrame(rows, "k string, html string")).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_null_page(spark):
    assert with_text(spark.createDataFrame([(None,)], "html string")).first()["text"] == ""


def test_byte_limit(spark):
    df = spark.createDataFrame([("<main>яяяя</main>",)], "html string")
    assert with_text(df, limit_mb=5 / 1024 / 1024).first()["text"] == "яя"


@pytest.mark.parametrize("setting", [None, "many", float("inf")])
def test_bad_limit_means_default(setting):
    assert limit_bytes(setting) == 5 * 1024 * 1024


def test_parser_survives_anything():
    assert read_markup("<main><![x]><a <b") is not None


TOKENS = ["<main>", "</main>", "<article>", "</article>", "<div>", '<div class="content">', "</div>", "<p>", "</p>", "<b>", "<br>", "<nav>", "</nav>",
          "<script>", "</script>", "<style>", "</style>", "<header>", "</header>", "<!-- x -->", "<!-- <nav> -->", "</div>", "<ul><li>", "</li>", "<footer>", "</footer>", "<i>", "</i>", "<i/>", "<br/>", '<path d="x"/>', "</ul>", "<title>", "</title>", "a", "b ", "\n", " c\td ", "&amp;", "&lt;", "&#65;", "&copy", "<section>", "</section>", "</body>"]


def test_both_ways_agree(spark):
    """Random pages: the chosen path gives what the parser gives."""
    import random

    from linkatlas.functions.sql import register_python_functions

    register_python_functions(spark)

    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(TOKENS) for _ in range(rng.randrange(1, 14)))) for i in range(16000)]
    got = with_text(spark.createDataFrame(rows, "i int, html string")).selectExpr("i", "html", "text", "extract_text(html) AS parsed").collect()
    wrong = [(r["html"], r["text"], r["parsed"]) for r in got if r["text"] != r["parsed"]]
    assert wrong == []
