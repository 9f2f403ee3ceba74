"""Edge rows of the scalar rules."""

import datetime
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkatlas.functions import text as X
from linkatlas.functions import times, urls


def values(spark, rows, column):
    """Evaluate a column over inputs ``v``, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select("i", column.alias("o")).orderBy("i").select("o").collect()]


V = F.col("v")
MIXED = st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　я😀")), max_size=30)


def clean(t):
    lines = (line.strip() for line in t.splitlines())
    return " ".join(c for c in (p.strip() for line in lines for p in line.split(" ")) if c)


@given(st.lists(MIXED, min_size=20, max_size=60))
@settings(max_examples=8, deadline=None)
def test_blank_rules(spark, rows):
    assert values(spark, rows, X.clean_text(V)) == [clean(r) for r in rows]
    assert values(spark, rows, X.normalize_whitespace(V)) == [re.sub(r"\s+", " ", r).strip() for r in rows]


def test_clean_text_edges(spark):
    assert values(spark, [None, "", "a\tb", " x \n\n y "], X.clean_text(V)) == ["", "", "a\tb", "x y"]


@given(st.lists(st.text(max_size=20), min_size=20, max_size=60), st.integers(0, 24))
@settings(max_examples=8, deadline=None)
def test_utf8_prefix(spark, rows, limit):
    want = [r.encode()[:limit].decode(errors="ignore") for r in (r.replace("\x00", "") for r in rows)]
    rows = [r.replace("\x00", "") for r in rows]
    assert values(spark, rows, X.utf8_prefix(V, limit)) == want


def test_truncate_and_label(spark):
    assert values(spark, ["abcdef", "abcde"], X.truncate_text(V, 5)) == ["ab...", "abcde"]
    assert values(spark, ['a "b" `c`\n d'], X.sanitize_label(V)) == ["a 'b' c d"]
    with pytest.raises(ValueError):
        X.truncate_text(V, 2)


def test_names(spark):
    assert values(spark, ["<>:", "a/b", "я" * 200], X.safe_filename(V)) == ["unnamed", "ab", "я" * 127]
    assert values(spark, ["<>:"], X.replace_forbidden(V)) == ["___"]
    digest = "item_" + hashlib.md5("яяя".encode()).hexdigest()[:8]
    assert values(spark, ["яяя"], X.path_name(V, F.lit(""), 4, True)) == ["яя"]
    assert values(spark, ["яяя"], X.path_name(V, F.lit(""), 5, True)) == [digest]
    assert values(spark, ["яяя"], X.path_name(V, F.lit("p" * 300), 255, True)) == [digest]
    assert values(spark, ["   ", "", None], X.path_name(V, F.lit("/d"), 250)) == ["unnamed"] * 3
    blank = "item_" + hashlib.md5(b"   ").hexdigest()[:8]
    assert values(spark, ["   "], X.path_name(V, F.lit("/d"), 12)) == [blank]


def test_document_file_appends_its_ending(spark):
    assert values(spark, ["Node.js", "x.md"], X.document_file(V, F.lit("/o"))) == ["/o/Node.js.md", "/o/x.md"]


def test_text_hash_rejects_unknown():
    with pytest.raises(ValueError):
        X.text_hash(V, "crc")


def test_urls(spark):
    bad = ["http://[::1/x", "ftp://example.com", "javascript:alert('xss')", "file:///etc/passwd", "not-a-url", "", "http://", "https:///x", None]
    good = ["HTTP://A.B", "http://[::1]/x", "ht\ntp://x", "https://a b/c", " http://x", "http://@/"]
    assert values(spark, bad, urls.is_valid_url(V)) == [False] * len(bad)
    assert values(spark, good, urls.is_valid_url(V)) == [True] * len(good)
    assert values(spark, ["http://u:p@h:80/x", "x", "http:///y", "//h/z"], urls.extract_domain(V)) == ["u:p@h:80", None, None, "h"]


URLS = st.lists(st.sampled_from(["http", "HTTPS", "ftp", ":", "//", "/", "?", "#", "[", "]", "a", "h.x", "@", ":80", " ", "\t", "\n", "::1"]), max_size=9).map("".join)


@given(st.lists(URLS, min_size=60, max_size=120))
@settings(max_examples=8, deadline=None)
def test_urls_split_like_the_standard_library(spark, rows):
    from urllib.parse import urlsplit

    def host(u):
        try:
            parts = urlsplit(u)
        except ValueError:
            return None, False
        return parts.netloc or None, parts.scheme in ("http", "https") and bool(parts.netloc)

    # Addresses inside brackets are not checked, so those are left out.
    rows = [r for r in rows if not ("[" in r and "]" in r)]
    got = list(zip(values(spark, rows, urls.extract_domain(V)), values(spark, rows, urls.is_valid_url(V))))
    assert got == [host(r) for r in rows]


def test_paths(spark):
    base = F.lit("/base")
    assert values(spark, ["/base/x", "/base_evil", "/base/../x", "/base", "/a/../base/./y"], urls.is_safe_path(V, base)) == [True, False, False, True, True]
    assert values(spark, ["/base/x/y", "/other", "/base", "base/x"], urls.relative_path(V, base)) == ["x/y", "/other", ".", "base/x"]


def test_size_limit_is_inclusive(spark):
    assert values(spark, ["x" * 1024, "x" * 1025], urls.within_size(V, 1 / 1024)) == [True, False]


def test_times(spark):
    got = values(spark, ["13321112345678901", "invalid_date", "", None, "9" * 18], times.from_1601(V))
    assert got == [datetime.datetime(2023, 2, 17, 12, 59, 5, 678901), None, None, None, None]
    # The old formula puts the same text in another age.
    assert values(spark, ["13321112345678901"], F.year(times.from_1601_legacy(V))) == [6190]


@given(st.lists(st.floats(0, 1e6).map(lambda x: round(x, 3)) | st.integers(0, 4000).map(lambda n: n / 20), min_size=30, max_size=80))
@settings(max_examples=6, deadline=None)
def test_duration_rounds_like_the_exact_binary_value(spark, rows):
    def shown(s):
        return f"{s:.1f} сек" if s < 60 else f"{s / 60:.1f} мин" if s < 3600 else f"{s / 3600:.1f} час"

    assert values(spark, [repr(r) for r in rows], times.format_duration(V.cast("double"))) == [shown(r) for r in rows]


def test_duration_examples(spark):
    assert values(spark, ["30.5", "150", "7200"], times.format_duration(V.cast("double"))) == ["30.5 сек", "2.5 мин", "2.0 час"]
