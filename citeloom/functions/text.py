"""Column helpers for text: trimming, missing values, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Strip all Unicode whitespace at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    """Null, blank or the literal ``nan``."""
    t = trim_ws(c)
    return c.isNull() | (t == "") | (t == "nan")


def split_terms(c: Column, sep: str = ";") -> Column:
    """Trimmed non-empty pieces of a cell; an empty array for missing cells."""
    parts = F.filter(F.transform(F.split(c, sep), trim_ws), lambda x: x != "")
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(parts)


def term_key(c: Column) -> Column:
    """Lower case, each run of whitespace as one space."""
    return squash_ws(F.lower(c))


def safe_text(c: Column, fallback: str = "Unknown") -> Column:
    """The trimmed text, or ``fallback`` for missing and blank cells."""
    return F.when(is_blank(c), F.lit(fallback)).otherwise(trim_ws(c))


def cut_label(c: Column, most: int = 48) -> Column:
    """A label of at most ``most`` characters, shortened ones with three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def without_old_suffixes(c: Column) -> Column:
    """A paper label without bracketed additions at its end and without one in round brackets after the year."""
    bare = trim_ws(F.regexp_replace(trim_ws(c), r"(?:\s*\[[^\]]+\]\s*)+$", ""))
    return trim_ws(F.regexp_replace(bare, r"(,\s*(?:\d{4}|N/A))\s*\([^)]*\)\s*$", "$1"))


def rule_entries(text: str | None) -> list[str]:
    """Entries of a rule text: pieces between semicolons and line breaks, trimmed, none empty."""
    pieces = (text or "").replace("\r", "\n").replace("\n", ";").split(";")
    return [p.strip() for p in pieces if p.strip()]


def alias_rules(text: str | None) -> list[tuple[str, str]]:
    """(alias, term) of the entries ``alias => term`` of a rule text; others are left out."""
    halves = (e.split("=>", 1) for e in rule_entries(text) if "=>" in e)
    return [(a.strip(), b.strip()) for a, b in halves if a.strip() and b.strip()]
