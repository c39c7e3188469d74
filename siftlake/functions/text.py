"""Text cleaning for anything that leaves the lake as a key or label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest key shown, the mark for a cut key, and the HTML escapes in the order they apply.
KEY_LENGTH = 64
CUT_MARK = "…"
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
NULL_KEY = "<null>"
NON_SCALAR_KEY = "<non-scalar>"
TEXT_LENGTH = 80
DOMAIN_SUFFIXES = (".corp", ".local", ".internal")


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def safe_key(c: Column, scalar: bool = True) -> Column:
    """A key that is safe to show: printable ASCII, no backtick, bounded, HTML-escaped, never NULL."""
    if not scalar:
        return F.when(c.isNull(), F.lit(NULL_KEY)).otherwise(F.lit(NON_SCALAR_KEY))
    text = _replace(F.regexp_replace(c.cast("string"), "[^ -~]", ""), "`", "")
    text = F.regexp_replace(text, f"^(.{{{KEY_LENGTH}}}).+$", "$1" + CUT_MARK)
    for old, new in HTML_ESCAPES:
        text = _replace(text, old, new)
    return F.coalesce(text, F.lit(NULL_KEY))


def safe_key_of(df: DataFrame, name: str) -> Column:
    """``safe_key`` for a named column, choosing the non-scalar form from the column's type."""
    data_type = df.schema[name].dataType
    scalar = not isinstance(
        data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BooleanType, T.BinaryType)
    )
    return safe_key(F.col(f"`{name}`"), scalar)


def safe_text(c: Column, length: int = TEXT_LENGTH) -> Column:
    """Control characters become spaces; at most ``length`` characters are kept."""
    return F.substring(F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", " "), 1, length)


def strip_ansi(c: Column) -> Column:
    """Drop terminal colour and cursor sequences."""
    return F.regexp_replace(c, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def basename(c: Column) -> Column:
    """Last part of a path, ignoring trailing slashes."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def strip_domain_suffix(c: Column, suffixes: Sequence[str] = DOMAIN_SUFFIXES) -> Column:
    """Lower-case, then remove one listed domain suffix (the longest that fits)."""
    longest_first = sorted((s.lower() for s in suffixes), key=len, reverse=True)
    pattern = "|".join(f"\\Q{s}\\E" for s in longest_first)
    return F.regexp_replace(F.lower(c), f"({pattern})$", "")


def user_format_valid(c: Column) -> Column:
    """True for the two accepted identity shapes; NULL and anything else are false."""
    return F.coalesce(c.rlike(r"@acme\.example$") | c.rlike(r"^ACME\\u\d+$"), F.lit(False))
