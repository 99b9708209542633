"""Parsers of cited references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, squash_ws, trim_ws


def reference_list(cell: Column) -> Column:
    parts = F.filter(F.transform(F.split(cell, ";"), trim_ws), lambda x: x != "")
    return F.when(is_blank(cell), F.array().cast("array<string>")).otherwise(parts)


def _parts(ref: Column) -> Column:
    return F.transform(F.split(ref, ","), trim_ws)


def short_reference(raw: Column) -> Column:
    """``AUTHOR, YEAR`` in the writing given; null for anonymous, undated and numeric references."""
    ref = trim_ws(raw)
    p = _parts(ref)
    year = F.get(F.filter(F.slice(p, 2, 1000), lambda x: x.rlike(r"^\d{4}")), F.lit(0))
    author = F.get(p, F.lit(0))
    named = F.when((F.length(author) >= 2) & year.isNotNull(), F.concat_ws(", ", author, year))
    whole = F.when(F.length(ref) >= 8, F.substring(ref, 1, 60))
    out = F.when(F.size(p) >= 2, named).otherwise(whole)
    return F.when((F.length(ref) >= 5) & ~F.lower(ref).startswith("[anonymous]") & ~out.rlike(r"^[\d\s]+$"), out)


def upper_reference(raw: Column) -> Column:
    """``AUTHOR, YEAR`` in upper case with a bare four-digit year from the second to fourth part."""
    ref = trim_ws(raw)
    p = F.filter(_parts(ref), lambda x: x != "")
    year = F.get(F.filter(F.transform(F.slice(p, 2, 3), lambda x: F.regexp_extract(x, r"^(\d{4})", 1)), lambda x: x != ""), F.lit(0))
    author = F.upper(F.get(p, F.lit(0)))
    return F.when((F.length(author) >= 2) & ~author.startswith("[ANONYMOUS]") & year.isNotNull(), F.concat_ws(", ", author, year))


def reference_year(raw: Column, low: int = 1900, high: int = 2030) -> Column:
    y = F.regexp_extract(raw, r"(?U),\s*(\d{4})\b", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def reference_author(raw: Column) -> Column:
    ref = trim_ws(raw)
    bare = F.regexp_replace(F.regexp_replace(ref, r"\[.*?\]", ""), r"\(.*?\)", "")
    a = trim_ws(F.get(F.split(bare, ","), F.lit(0)))
    return F.when((F.length(ref) >= 5) & (F.length(a) >= 2) & ~F.lower(a).isin("et al", "et al.") & ~a.rlike(r"^[\d\s]+$"), a)


def reference_journal(raw: Column) -> Column:
    """The first part after the year that is neither volume, page, number nor ``et al``."""
    ref = trim_ws(raw)
    bare = F.regexp_replace(F.regexp_replace(ref, r"\[.*?\]", ""), r"\(.*?\)", "")
    rest = F.regexp_extract(bare, r"(?s)^.*?,\s*\d{4}\b(.*)$", 1)
    rest = F.regexp_replace(trim_ws(rest), r"^,", "")
    ok = F.filter(
        F.transform(F.split(rest, ","), trim_ws),
        lambda x: ~F.upper(x).rlike(r"^V[OL.]*\s*\d+") & ~F.upper(x).rlike(r"^P[AG.]*\s*\d+") & ~x.rlike(r"^\d+$") & ~F.lower(x).isin("et al", "et al.") & (F.length(x) >= 2),
    )
    return F.when((F.length(ref) >= 10) & bare.rlike(r",\s*\d{4}\b"), squash_ws(F.get(ok, F.lit(0))))


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, lower case elsewhere."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def author_token(c: Column) -> Column:
    t = F.regexp_replace(F.substring_index(F.substring_index(F.upper(trim_ws(c)), ",", 1), " ", 1), "[^A-Z0-9-]", "")
    return F.when(is_blank(c) | (t == ""), F.lit("UNKNOWN")).otherwise(t)


def year_token(c: Column) -> Column:
    t = trim_ws(c)
    d = t.try_cast("double")
    return F.when(is_blank(c), "").when(d.isNotNull() & ~F.isnan(d), F.floor(d).cast("string")).when(F.substring(t, 1, 4).rlike(r"^\d{4}$"), F.substring(t, 1, 4)).otherwise("")


def journal_token(c: Column) -> Column:
    return F.when(is_blank(c), "").otherwise(F.regexp_extract(F.upper(c), "[A-Z0-9]+", 0))


def doi_token(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)10\.\d{4,9}/[^\s\],;]+", 0)
    return F.when(found != "", F.upper(F.regexp_replace(found, r"[\].,;)]+$", "")))


def primary_key(author: Column, year: Column, journal: Column) -> Column:
    return F.when((author != "") & (year != "") & (journal != ""), F.concat_ws(", ", author, year, journal))
