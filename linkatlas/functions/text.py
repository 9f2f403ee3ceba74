"""Text expressions. All are plain Column expressions that stay inside whole-stage codegen.

Blanks are Unicode blanks: ``(?U)\\s`` plus the four ASCII separators that it leaves out. That form runs
about three times as fast on the JVM as the spelled-out class, which the checks use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode blanks, the line breaks among them, characters not allowed in file names.
BLANKS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAKS = r"\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
FORBIDDEN = r'[<>:"/\\|?*]'
UNNAMED = "unnamed"
ANY_BLANK = r"[\s\x1c-\x1f]"

HASHES = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
}


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK_CHARS))


def clean_text(c: Column) -> Column:
    """Split at line breaks and at single blanks, trim the pieces, join the non-empty by a blank.

    A run of blanks is a cut exactly when it holds a line break or a plain blank, so a tab
    inside a piece survives. NULL gives ''.
    """
    cut = rf"(?U)(?={ANY_BLANK}){ANY_BLANK}*[{LINE_BREAKS} ]{ANY_BLANK}*"
    return F.coalesce(strip_blanks(F.regexp_replace(c, cut, " ")), F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """Every run of blanks becomes one plain blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){ANY_BLANK}+", " "))


def truncate_text(c: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` characters, the last of them being ``suffix`` when something was cut."""
    if limit < len(suffix):
        raise ValueError("limit is shorter than the suffix")
    return F.when(F.char_length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit - len(suffix)), F.lit(suffix))
    )


def sanitize_label(c: Column, limit: int = 60) -> Column:
    """Outline label: double quotes become single ones, backticks go, blanks collapse, long text is cut."""
    return truncate_text(normalize_whitespace(F.translate(c, '"`', "'")), limit)


def _byte_cut(c: Column, n: Column | int) -> Column:
    """The first ``n`` bytes as text, NULL when they end inside a character."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.try_validate_utf8(F.substring(c.cast("binary"), F.lit(1), n).cast("string"))


def utf8_prefix(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters that fits in ``limit`` bytes."""
    cuts = [_byte_cut(c, limit - back) for back in range(min(4, limit + 1))]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*cuts, F.lit("")))


def text_hash(c: Column, algorithm: str = "md5") -> Column:
    if algorithm not in HASHES:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return HASHES[algorithm](c)


# ---------------------------------------------------------------- file and folder names

def safe_filename(c: Column) -> Column:
    """Name form A: forbidden characters deleted, blanks collapsed, at most 255 bytes."""
    name = utf8_prefix(normalize_whitespace(F.regexp_replace(c, FORBIDDEN, "")), 255)
    return F.when(name == "", UNNAMED).otherwise(name)


def replace_forbidden(c: Column) -> Column:
    """Name form B, first step: forbidden characters become underscores, blanks collapse."""
    return normalize_whitespace(F.regexp_replace(c, FORBIDDEN, "_"))


def hash_name(c: Column) -> Column:
    return F.concat(F.lit("item_"), F.left(F.md5(c), F.lit(8)))


def path_name(name: Column, parent: Column, limit: int = 255, folder: bool = False) -> Column:
    """Name form B under a whole-path byte budget.

    Too long names are cut at the budget; a cut inside a character, or no room at all, gives the hash name.
    """
    lead = F.octet_length(parent) + F.when(parent == "", 0).otherwise(1)
    budget = F.lit(limit) - lead - F.lit(0 if folder else len(".md"))
    blank = F.regexp_like(name, F.lit(rf"(?U)\A{ANY_BLANK}*\z"))
    room_for_unnamed = (parent == "") | (budget >= len(UNNAMED))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", UNNAMED)
        .when((budget <= 0) | replace_forbidden(name).isin(".", ".."), hash_name(name))
        .when(blank & room_for_unnamed, UNNAMED)
        .when(blank, hash_name(name))
        .otherwise(F.coalesce(_byte_cut(replace_forbidden(name), budget), hash_name(name)))
    )


def output_folder(folder_path: Column, base: str) -> Column:
    """Sanitised folder path of a raw name path; each step's budget depends on the path so far."""
    return F.aggregate(
        folder_path,
        F.lit(base),
        lambda path, name: F.when(path == "", path_name(name, path, 255, True)).otherwise(
            F.concat(path, F.lit("/"), path_name(name, path, 255, True))
        ),
    )


def document_file(title: Column, folder: Column) -> Column:
    """``folder/name.md``; the ending is appended, never swapped for a part of the title."""
    name = path_name(title, folder, 250)
    return F.concat(folder, F.lit("/"), name, F.when(F.endswith(name, F.lit(".md")), "").otherwise(".md"))
