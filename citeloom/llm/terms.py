"""Keyword terms of publication records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, split_terms, term_key
from citeloom.operators.multivalue import split_packed


def record_terms(papers: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(``id_col``, term, n): each term of a record with its number of occurrences there.

    Terms are the packed values of ``author_keywords`` and the ``;`` pieces of
    ``keywords_plus``, in lower case with single spaces. Missing cells give no row; rows with the
    same id are one record.
    """
    own = split_packed(papers, id_col, ["author_keywords"]).select(id_col, term_key(F.col("item")).alias("term"))
    plus = (
        papers.filter(~is_blank(F.col("keywords_plus")))
        .select(id_col, F.explode(split_terms(F.col("keywords_plus"))).alias("item"))
        .select(id_col, term_key(F.col("item")).alias("term"))
    )
    return own.unionByName(plus).filter("term <> ''").groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
