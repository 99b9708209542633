"""From record tables to long tables: the pipeline entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import affiliations as A
from citeloom.functions import keywords as K
from citeloom.functions import references as R
from citeloom.functions.text import is_blank, split_terms, trim_ws
from citeloom.operators.citations import internal_citations
from citeloom.operators.records import deduplicate, number_or_zero, safe_year

# Column of the record table -> column of ``papers``.
COLUMNS = {
    "Title": "title", "Abstract": "abstract", "Year": "year", "Journal": "journal", "DOI": "doi", "Authors": "authors", "Author_Keywords": "author_keywords",
    "Keywords_Plus": "keywords_plus", "Times_Cited": "times_cited", "Affiliations": "affiliations", "Cited_References": "cited_references", "DocType": "doctype",
    "Language": "language", "Publisher": "publisher", "Funding": "funding", "WoS_Categories": "categories", "Research_Areas": "areas",
}


def papers_of(records: DataFrame, max_year: int | None = None) -> DataFrame:
    """Typed papers of a record table; absent columns are null, bad years null, bad counts 0."""
    have = set(records.columns)
    cols = [F.col(a).cast("string").alias(b) if a in have else F.lit(None).cast("string").alias(b) for a, b in COLUMNS.items()]
    p = records.select("rec_id", *cols)
    filled = F.when(~is_blank(F.col("journal")), trim_ws(F.col("journal")))
    return p.withColumn("year", safe_year(F.col("year"), max_year)).withColumn("times_cited", number_or_zero(F.col("times_cited"))).withColumn("journal", filled)


def keyword_table(papers: DataFrame, source: str = "DE+ID", blocked: DataFrame | None = None, aliases: DataFrame | None = None, max_auto_terms: int = 8, patterns: dict[str, str] | None = None) -> DataFrame:
    """(rec_id, pos, keyword): metadata terms of each record, governed.

    With the default source, records without any get automatic terms of title and abstract and
    the canonical names of ``patterns`` (name -> regular expression) that their text matches.
    """
    terms = K.metadata_terms(F.col("author_keywords"), F.col("keywords_plus"), source)
    base = papers.select("rec_id", "title", "abstract", terms.alias("t"))
    own = base.select("rec_id", F.posexplode("t").alias("pos", "term"))
    if (source or "").strip().upper() not in ("DE", "ID"):
        bare = base.filter(F.size("t") == 0).select("rec_id", "title", "abstract")
        own = own.unionByName(K.automatic_terms(bare, "rec_id", max_terms=max_auto_terms))
        if patterns:
            own = own.unionByName(K.pattern_terms(bare, "rec_id", patterns).select("rec_id", F.lit(1000).alias("pos"), "term"))
    return K.governed(own, "rec_id", blocked, aliases).withColumnRenamed("term", "keyword")


def long_tables(papers: DataFrame, **keyword_options) -> dict[str, DataFrame]:
    """keywords, authors, countries, institutions, references and citations of ``papers``."""
    raw = papers.select("rec_id", F.explode(R.reference_list(F.col("cited_references"))).alias("raw"))
    refs = raw.select("rec_id", "raw", R.short_reference(F.col("raw")).alias("ref"), R.reference_year(F.col("raw")).alias("ref_year"), R.title_case(R.reference_journal(F.col("raw"))).alias("ref_source"))
    return {
        "keywords": keyword_table(papers, **keyword_options).select("rec_id", "keyword"),
        "authors": papers.select("rec_id", F.explode(split_terms(F.col("authors"))).alias("author")),
        "countries": papers.select("rec_id", F.explode(A.countries_of(F.col("affiliations"))).alias("country")),
        "institutions": papers.select("rec_id", F.explode(A.institutions_of(F.col("affiliations"))).alias("institution")),
        "references": refs,
        "citations": internal_citations(papers, raw),
    }


def build(records: DataFrame, max_year: int | None = None, dedup: bool = True, **keyword_options) -> tuple[DataFrame, dict[str, DataFrame], DataFrame | None]:
    """(papers, long tables, deduplication report) of a record table with ``rec_id``; all lazy."""
    papers = papers_of(records, max_year)
    report = None
    if dedup:
        papers, report = deduplicate(papers)
    return papers, long_tables(papers, **keyword_options), report
