"""URL and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The admitted schemes, where the host part of a URL ends, characters ignored anywhere in a URL.
# A host part with only one kind of square bracket is broken.
_HOST = r"(?:[^/?#\[\]]*|(?=[^/?#]*\[)(?=[^/?#]*\])[^/?#]*)(?=[/?#]|\z)"
VALID_URL = rf"(?i)\A[\x00-\x20]*https?://(?=[^/?#]){_HOST}"
NETLOC = rf"\A[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//({_HOST})"
IGNORED = "\t\r\n"
MEGABYTE = 1024 * 1024


def is_valid_url(url: Column) -> Column:
    """http(s) scheme and a non-empty host part; NULL is not valid."""
    return F.coalesce(F.regexp_like(F.translate(url, IGNORED, ""), F.lit(VALID_URL)), F.lit(False))


def extract_domain(url: Column) -> Column:
    """Host part with user info and port, NULL when there is none."""
    return F.nullif(F.regexp_extract(F.translate(url, IGNORED, ""), NETLOC, 1), F.lit(""))


def within_size(text: Column, limit_mb: float = 5.0) -> Column:
    """UTF-8 size test; a page of exactly the limit passes."""
    return F.octet_length(text) / F.lit(float(MEGABYTE)) <= F.lit(float(limit_mb))


def _anchor(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))


def lexical_parts(path: Column) -> Column:
    """Path components without empty ones and '.'; an absolute path begins with the component '/'."""
    return F.concat(_anchor(path), F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")))


def resolved_parts(path: Column) -> Column:
    """Path components with '..' resolved; '..' at the top is dropped."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda kept, step: F.when(
            step == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.concat(kept, F.array(step))),
    )
    return F.concat(_anchor(path), done)


def _below(parts: Column, top: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(top)) == top


def is_safe_path(path: Column, base: Column) -> Column:
    """True when the resolved path is the base folder or lies below it, compared by whole components."""
    return _below(resolved_parts(path), resolved_parts(base))


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base``, or the path unchanged when it is not below it; the base itself is '.'."""
    parts, top = lexical_parts(path), lexical_parts(base)
    rest = F.array_join(F.slice(parts, F.size(top) + 1, F.greatest(F.size(parts) - F.size(top), F.lit(0))), "/")
    return F.when(_below(parts, top), F.when(rest == "", ".").otherwise(rest)).otherwise(path)
