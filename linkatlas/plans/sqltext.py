"""DuckDB spellings of the text rules, written independently of the Column expressions where possible."""

from __future__ import annotations

from linkatlas.functions.text import BLANKS, FORBIDDEN, LINE_BREAKS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(t: str) -> str:
    return (
        f"coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '[{LINE_BREAKS} ]'), "
        f"lambda x: regexp_replace(x, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')), lambda x: x <> ''), ' '), '')"
    )


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{BLANKS}]+', ' ', 'g'))"


def truncated(t: str, limit: int) -> str:
    return f"CASE WHEN length({t}) <= {limit} THEN {t} ELSE left({t}, {limit - 3}) || '...' END"


def byte_prefix(t: str, limit: int) -> str:
    cuts = ", ".join(f"try(decode(array_slice(encode({t}), 1, {limit - back})))" for back in range(4))
    return f"CASE WHEN strlen({t}) <= {limit} THEN {t} ELSE coalesce({cuts}, '') END"


def underscored(t: str) -> str:
    return squeeze(f"regexp_replace({t}, {quoted(FORBIDDEN)}, '_', 'g')")


def hashed(t: str) -> str:
    return f"'item_' || left(md5({t}), 8)"


def path_name(name: str, parent: str, limit: int, folder: bool) -> str:
    """Name under a path budget; ``name`` and ``parent`` are column references."""
    tail = 0 if folder else 3
    budget = f"({limit} - strlen({parent}) - CASE WHEN {parent} = '' THEN 0 ELSE 1 END - {tail})"
    sane = underscored(name)
    cut = f"CASE WHEN strlen({sane}) <= {budget} THEN {sane} ELSE try(decode(array_slice(encode({sane}), 1, {budget}))) END"
    named = f"CASE WHEN ({cut}) = '' THEN 'unnamed' ELSE ({cut}) END"
    return (
        f"CASE WHEN coalesce({name}, '') = '' THEN 'unnamed' WHEN {budget} <= 0 OR ({cut}) IS NULL OR {sane} IN ('.', '..') THEN {hashed(name)} "
        f"WHEN {parent} <> '' AND strlen({named}) > {budget} THEN {hashed(name)} ELSE {named} END"
    )


def _inside(name: str) -> str:
    """The first element of a name: what stands between its opening tag and the next end tag."""
    behind = f"regexp_replace(body, '(?is)^.*?<{name}(\\s[^>]*)?>', '')"
    return f"WHEN regexp_matches(body, '(?is)<{name}(\\s[^>]*)?>.*</{name}\\s*>') THEN regexp_extract({behind}, '(?is)^(.*?)</{name}\\s*>', 1)"


# Divs are counted piece by piece from the content div's opening tag; the first piece at which more are closed than opened ends it.
CLASSED = "(?is)<div[^>]*\\sclass=\"[^\"]*(main|content|article)[^\"]*\"[^>]*>"
DIV_PIECES = f"string_split(regexp_replace(regexp_replace(body, '(?is)^.*?' || '{CLASSED[5:]}', ''), '(?i)(</?div[ >])', chr(1) || '\\1', 'g'), chr(1))"
DIV_STEP = "CASE WHEN starts_with(lower(x), '</div') THEN -1 WHEN starts_with(lower(x), '<div') THEN 1 ELSE 0 END"


def page_text_ctes(source: str = "pages", form: str = "") -> str:
    """CTEs ending in ``page_text(page_id, url, html, text)``; ``form`` names a column of the source to carry along. The patterns are spelled here anew: one kind of
    element goes after the other, and blocks are cut at their tags."""
    keys = "page_id, url, " + (f"{form}, " if form else "")
    body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in ("script", "style", "nav", "footer", "header"):
        body = f"regexp_replace({body}, '(?is)<{name}(\\s[^>]*)?>.*?</{name}\\s*>', '', 'g')"
    decoded = "regexp_replace(part, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·")):
        decoded = f"replace({decoded}, '{entity}', '{char}')"
    decoded = f"regexp_replace({decoded}, '&amp;?', '&', 'g')"
    return f"""
page_bodies AS (SELECT {keys}html, {body} AS body FROM {source}),
page_pieces AS (SELECT *, CASE WHEN regexp_matches(body, '{CLASSED}') THEN {DIV_PIECES} END AS pieces FROM page_bodies),
page_parts AS (
  SELECT * EXCLUDE (pieces), CASE {_inside('main')} {_inside('article')}
    WHEN pieces IS NOT NULL THEN array_to_string(pieces[1:list_position(list_transform(range(1, len(pieces) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: {DIV_STEP}))::INTEGER), -1) - 1], '')
    ELSE body END AS part
  FROM page_pieces),
page_plain AS (SELECT *, {decoded} AS plain FROM page_parts),
page_text AS (SELECT {keys}html, {clean('plain')} AS text FROM page_plain)"""
