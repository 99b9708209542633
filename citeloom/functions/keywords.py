"""Keyword canonicalisation and automatic terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import lookups as L
from citeloom.functions.text import alias_rules, is_blank, rule_entries, split_terms, squash_ws

CODE = r"^[a-z]*\d+[a-z0-9-]*$"
EDGE = r"""^[ ;,:.\[\](){}"']+|[ ;,:.\[\](){}"']+$"""


def strip_markup(c: Column) -> Column:
    return squash_ws(F.regexp_replace(c, "<[^>]+>", " "))


def _capitalised(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


def _subtoken(t: Column) -> Column:
    low = F.lower(t)
    return (
        F.when(low.isin(L.UPPER_TOKENS) | low.rlike(CODE), F.upper(t))
        .when((F.length(t) <= 2) & t.rlike(r"(?U)^\p{L}+$"), F.upper(t))
        .otherwise(_capitalised(t))
    )


def _token(t: Column, i: Column) -> Column:
    low = F.lower(t)
    subs = F.filter(F.split(t, "-"), lambda s: s != "")
    shown = F.transform(subs, _subtoken)
    compound = F.when(F.forall(subs, lambda s: s.rlike("^[A-Za-z]+$")), F.array_join(shown, " ")).otherwise(F.array_join(shown, "-"))
    return (
        F.when(low.isin(L.CONNECTORS) & (i != 0), low)
        .when(low.isin(L.UPPER_TOKENS) | low.rlike(CODE), F.upper(t))
        .when(t.contains("-") & (F.size(subs) > 0), compound)
        .otherwise(_subtoken(t))
    )


def normalize_keyword(c: Column) -> Column:
    """Canonical writing of a keyword; null for missing, empty and noise terms."""
    s = strip_markup(c)
    s = F.when((s != "") & (F.lower(s) != "nan"), s)
    s = F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), r"\s*/\s*", " "), r"\s*-\s*", "-")
    s = F.regexp_replace(s, EDGE, "")
    known = F.when(s.rlike(r"(?i)^h[1-9][0-9]?n[1-9][0-9]?$"), F.upper(s))
    for pattern, name in L.CANONICAL_TERMS:
        known = known.when(s.rlike(f"(?i)^(?:{pattern})$"), F.lit(name))
    words = F.transform(F.split(s, " "), lambda t, i: F.when(t != "", _token(t, i)))
    free = F.array_join(F.filter(words, lambda t: t.isNotNull()), " ")
    out = F.coalesce(known, free)
    return F.when((s != "") & (out != "") & ~out.isin(L.NOISE_TERMS), out)


def metadata_terms(author_keywords: Column, keywords_plus: Column, source: str = "DE+ID") -> Column:
    """Normalised terms of a record, distinct, in order; ``source`` is DE, ID or DE+ID."""
    kind = (source or "").strip().upper()
    fields = {"DE": [author_keywords], "ID": [keywords_plus]}.get(kind, [author_keywords, keywords_plus])
    raw = F.concat(*[split_terms(f) for f in fields])
    return F.array_distinct(F.filter(F.transform(raw, normalize_keyword), lambda x: x.isNotNull()))


def normalized_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` with ``term`` normalised, noise dropped. Each writing is normalised once and joined back."""
    from citeloom.session import spread

    once = spread(terms.select(F.col(term).alias("_raw")).filter("_raw is not null").distinct())
    # exploding keeps the long expression from being computed again for the filter
    named = once.select("_raw", F.explode(F.array(normalize_keyword(F.col("_raw")))).alias("_name")).filter("_name is not null")
    joined = terms.join(named, terms[term] == F.col("_raw"))
    return joined.withColumn(term, F.col("_name")).drop("_raw", "_name")


def acronyms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}(?:-[A-Z0-9]+)*\b|\b[A-Z]\d+[A-Z0-9-]*\b"), F.lit(0))
    return F.filter(F.transform(found, normalize_keyword), lambda x: x.isNotNull())


def text_tokens(segment: Column) -> Column:
    """Lower-case tokens of a segment without stop words."""
    found = F.regexp_extract_all(F.lower(segment), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(L.STOPWORDS))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.slice("t", i, n))


def ngram_terms(df: DataFrame, id_col: str, text: str, max_ngram: int = 3, boost: int = 1) -> DataFrame:
    """(``id_col``, term, score, first): scored n-gram candidates; ``first`` is the first place of a term."""
    segs = df.filter(~is_blank(F.col(text))).select(id_col, F.posexplode(F.split(text, r"[.;:,()\[\]{}\n\t]+")).alias("seg", "s"))
    toks = segs.select(id_col, "seg", text_tokens(F.col("s")).alias("t"))
    parts = []
    for n in range(1, max_ngram + 1):
        grams = toks.filter(F.size("t") >= n).select(id_col, "seg", F.posexplode(_grams(n)).alias("at", "g"))
        grams = grams.filter(F.forall("g", lambda x: (F.length(x) >= 3) | x.rlike(r"\d")))
        order = F.col("seg") * 1_000_000 + (n - 1) * 100_000 + F.col("at")
        parts.append(grams.select(id_col, normalize_keyword(F.array_join("g", " ")).alias("term"), F.lit(boost if n > 1 else max(1, boost - 1)).alias("w"), order.cast("long").alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("term is not null").groupBy(id_col, "term").agg(F.sum("w").alias("score"), F.min("o").alias("first"))


def automatic_terms(df: DataFrame, id_col: str, title: str = "title", abstract: str = "abstract", max_terms: int = 8) -> DataFrame:
    """(``id_col``, pos, term): best terms of title and abstract where a record has no keywords."""
    base = df.select(id_col, F.coalesce(F.col(title), F.lit("")).alias("_t"), F.coalesce(F.col(abstract), F.lit("")).alias("_a"))
    acr = base.select(id_col, F.posexplode(acronyms(F.concat_ws(" ", "_t", "_a"))).alias("o", "term"))
    acr = acr.groupBy(id_col, "term").agg((F.count(F.lit(1)) * 3).alias("score"), (F.min("o") + F.lit(2 * 10**15)).alias("first"))
    both = (
        ngram_terms(base, id_col, "_t", 3, 4)
        .unionByName(ngram_terms(base, id_col, "_a", 2, 1).withColumn("first", F.col("first") + F.lit(10**15)))
        .unionByName(acr)
    )
    best = both.groupBy(id_col, "term").agg(F.sum("score").alias("score"), F.min("first").alias("first"))
    ranked = best.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "first", "term"))), 1, max_terms).alias("x"))
    return ranked.select(id_col, F.posexplode("x").alias("pos", "e")).select(id_col, "pos", F.col("e.term").alias("term"))


def governed(terms: DataFrame, id_col: str, blocked: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Apply an alias table (alias, term) and a table of blocked terms (term) to (id, pos, term).

    Aliases are replaced first, then blocked terms dropped, then repeats within a record. Each
    writing is normalised, replaced and judged once and joined back.
    """
    once = terms.select(F.col("term").alias("_raw")).filter("_raw is not null").distinct()
    named = once.select("_raw", F.explode(F.array(normalize_keyword(F.col("_raw")))).alias("_name")).filter("_name is not null")
    if aliases is not None:
        pair = F.explode(F.array(F.struct(normalize_keyword(F.col("alias")).alias("_alias"), normalize_keyword(F.col("term")).alias("_new")))).alias("x")
        a = aliases.select(pair).select("x.*").dropDuplicates(["_alias"])
        named = named.join(a, named["_name"] == a["_alias"], "left").select("_raw", F.coalesce("_new", "_name").alias("_name"))
    if blocked is not None:
        b = blocked.select(F.explode(F.array(F.coalesce(normalize_keyword(F.col("term")), squash_ws(F.col("term"))))).alias("_name")).distinct()
        named = named.join(b, "_name", "left_anti")
    t = terms.join(named, terms["term"] == F.col("_raw")).select(id_col, "pos", F.col("_name").alias("term"))
    return t.groupBy(id_col, "term").agg(F.min("pos").alias("pos")).select(id_col, "pos", "term")


def rule_tables(spark: SparkSession, blocked_text: str | None = None, alias_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocked, aliases) for ``governed`` from the two rule texts; a later alias of a term wins."""
    blocked = spark.createDataFrame([(t,) for t in rule_entries(blocked_text)], "term string")
    return blocked, spark.createDataFrame(list(dict(alias_rules(alias_text)).items()), "alias string, term string")


def selected_keywords(spark: SparkSession, text: str | None) -> DataFrame:
    """(pos, keyword): keywords typed between commas, semicolons and line breaks, normalised, each once."""
    typed = spark.createDataFrame([(text or "",)], "t string").select(F.posexplode(F.split("t", "[,;\n]")).alias("pos", "k"))
    named = typed.select("pos", F.explode(F.array(normalize_keyword(F.col("k")))).alias("keyword")).filter("keyword is not null")
    return named.groupBy("keyword").agg(F.min("pos").alias("pos")).select("pos", "keyword")


def pattern_terms(df: DataFrame, id_col: str, patterns: dict[str, str], title: str = "title", abstract: str = "abstract") -> DataFrame:
    """(``id_col``, term): names whose regular expression occurs in title or abstract in lower case."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    hits = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]) if patterns else F.array().cast("array<string>")
    return df.select(id_col, F.explode(F.array_compact(hits)).alias("term"))
