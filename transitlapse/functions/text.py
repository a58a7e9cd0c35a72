"""Name normalisation as JVM-side column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Unicode-aware regex class (Java's \s alone is ASCII only).
WS = "[\\s" + "".join(chr(c) for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                         0x3000, 0xFEFF]) + "]"

# A platform with its argument; station words, most specific first; a closing remark in parentheses.
PLATFORM = r"(?i)(?:[\s,/-]+)(?:steig|stg\.?|gleis|gl\.?|bahnsteig|bstg\.?|kante|platform|plat\.?|ausgang)[\s._-]*[0-9a-z]+\b"
STATIONS = [r"(?i)\b(?:hauptbahnhof|hbf)\b", r"(?i)\b(?:bahnhof|bhf)\b", r"(?i)\b(?:bahnhst|bst)\b", r"(?i)\b(?:haltestelle|hst)\b",
            r"(?i)\b(?:station)\b"]
CLOSING_REMARK = r"\s*\([^)]*\)\s*$"
# Punctuation folded to blanks; the loose form also folds the hyphen.
PUNCTUATION = r"[._/\\,;:\"'`()\[\]{}!?*+=<>#]"
PUNCTUATION_AND_HYPHEN = r"[._/\\,;:\"'`()\[\]{}!?*+=<>#-]"


def _is_mark(ch: str) -> bool:
    cp = ord(ch)
    return (
        (unicodedata.category(ch) == "Mn" and unicodedata.combining(ch) != 0)
        or unicodedata.category(ch) == "Sk"
        or ch == "·"
        or 0x02B0 <= cp <= 0x02FF
    )


@functools.lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """``translate`` arguments that decompose each accented BMP letter and delete bare marks."""
    src, dst, deleted = [], [], []
    for cp in range(0x5E, 0xFFFF):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if _is_mark(ch):
            deleted.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not _is_mark(c))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src + deleted), "".join(dst)


def strip_accents(c: Column) -> Column:
    src, dst = _accent_table()
    return F.translate(c, src, dst)


def fold(c: Column) -> Column:
    """Accents off, then sharp s spelled out. Umlauts lose their dots: they were decomposed first."""
    return F.replace(strip_accents(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, WS + "+", " "), "^ | $", "")


def normalize_stop_name(c: Column) -> Column:
    s = F.lower(fold(c))
    for pattern in (PLATFORM, *STATIONS, CLOSING_REMARK):
        s = F.regexp_replace(s, pattern, " ")
    s = F.regexp_replace(s, PUNCTUATION, " ")
    s = F.regexp_replace(s, WS + "+-" + WS + "+", " ")
    return squeeze(s)


def normalize_route_short_name(c: Column) -> Column:
    return F.regexp_replace(F.upper(fold(c)), WS + "+", "")


def normalize_loose(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(fold(c)), PUNCTUATION_AND_HYPHEN, " "))


SLUG_LENGTH = 24


def slug(c: Column) -> Column:
    """Readable part of an id; only ``digest`` tells apart what it drops or cuts off."""
    s = F.regexp_replace(c, WS + "+", "-")
    return F.lower(F.substring(F.regexp_replace(s, "(?i)[^a-z0-9-]", ""), 1, SLUG_LENGTH))


def digest(*keys: Column) -> Column:
    """Part of an id for what the readable parts leave out of the full keys."""
    return F.substring(F.md5(F.concat_ws("|", *keys)), 1, 16)


def natural_key(c: Column) -> Column:
    """Sort key: accent- and case-blind text; a digit run is led by its number of digits, so it compares as a number."""
    parts = F.regexp_extract_all(F.lower(strip_accents(F.coalesce(c, F.lit("")))), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    return F.array_join(F.transform(parts, lambda x: F.when(
        x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 9, "0"), digits(x))).otherwise(x)), "")


def line_sort_key(c: Column) -> Column:
    """Digit-led line names first, each group in natural order."""
    s = F.coalesce(c, F.lit(""))
    return F.concat(F.when(s.rlike("^[0-9]"), F.lit("0")).otherwise(F.lit("1")), natural_key(s))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
