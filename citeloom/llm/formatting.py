"""Duplicates that differ in formatting only: Merkle-style hashing of nested records.

Leaves are normalised (letter case, white space, punctuation, signs). An author node digests
the leaves of its surname and of its initials, wherever they stand; the authors node, whose
children have no order, digests their digests in digest order; the root digests title, authors
and year. Rows are grouped by root digest and then compared as a whole with the group's first
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, trim_ws
from citeloom.operators.multivalue import split_packed
from citeloom.session import materialize

#: Writings that stand in for a missing title.
TITLE_STAND_INS = ["", "nan", "n/a", "na", "none", "null", "untitled", "no title", "title not available", "title missing", "title unavailable", "not available"]


def folded(c: Column) -> Column:
    """Case folded: lower case, sharp s and final sigma unified."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bare_text(c: Column) -> Column:
    """Folded letters, digits and marks; white space, punctuation and signs are left out."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}\p{M}]+", "")


def spaced_text(c: Column) -> Column:
    return trim_ws(F.regexp_replace(folded(c), r"[\p{P}\p{Z}\p{C}\p{Sk}\s]+", " "))


def is_stand_in(c: Column) -> Column:
    """Missing, or nothing but a stand-in for a title."""
    return c.isNull() | spaced_text(c).isin([x for x in TITLE_STAND_INS if "/" not in x] + ["n a"])


def year_number(c: Column) -> Column:
    """The year as an integer from any writing of the number; null if it is none."""
    d = trim_ws(c).try_cast("double")
    return F.when((d >= 0) & (d < 10000), F.floor(d)).cast("int")


def author_node(item: Column) -> Column:
    """(digest, text) of an author: the leaves are the surname words and the initials, each in order."""
    words = F.filter(F.split(spaced_text(item), " "), lambda w: w != "")
    names = F.array_join(F.filter(words, lambda w: F.length(w) > 1), " ")
    initials = F.array_join(F.filter(words, lambda w: F.length(w) == 1), "")
    return F.struct(F.md5(F.concat(F.md5(names), F.md5(initials))).alias("digest"), F.concat_ws("|", names, initials).alias("text"))


def formatting_duplicates(papers: DataFrame, id_col: str = "paper_id", title: str = "title", authors: str = "authors", year: str = "pub_year") -> DataFrame:
    """(group_id, member_id, copies): every row that has a copy in another writing.

    ``group_id`` is the smallest id of the group; the group's first row is a member too.
    Rows without title (or with a stand-in), authors, or a year from 1900 on are left out.
    Rows with null ids are left out, repeated rows count once; an empty table gives an empty result.
    """
    base = papers.select(F.col(id_col).alias("id"), F.col(title).alias("t"), F.col(authors).alias("au"), year_number(F.col(year)).alias("y"))
    base = base.filter(F.col("id").isNotNull() & ~is_stand_in(F.col("t")) & ~is_blank(F.col("au")) & (F.col("y") >= 1900)).distinct()
    leaves = base.select("id", bare_text(F.col("t")).alias("t"), "y").filter("t <> ''")
    people = (
        split_packed(base.select("id", "au"), "id", ["au"])
        .select("id", author_node(F.col("item")).alias("node"))
        .groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # one record's authors, in digest order
    )
    inner = F.md5(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
    tree = leaves.join(people, "id").withColumn("root", F.md5(F.concat(F.md5("t"), inner, F.md5(F.col("y").cast("string")))))
    tree = tree.withColumn("nodes", F.transform("nodes", lambda x: x["text"]))
    tree = materialize(tree, "merkle")
    groups = tree.groupBy("root").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "rep")
    members = tree.join(groups, "root")
    # the hot side is the members; AQE splits it, each representative is one row
    firsts = members.filter("id = rep").select("rep", F.col("t").alias("t0"), F.col("nodes").alias("n0"), F.col("y").alias("y0")).dropDuplicates(["rep"])
    compared = members.join(firsts, "rep")
    same = F.expr("t = t0 and nodes = n0 and y = y0")
    equal = compared.filter(same).select("rep", F.col("id"))
    odd = compared.filter(~same)
    by_text = odd.groupBy("t", "nodes", "y").agg(F.min("id").alias("rep"))
    odd = odd.drop("rep").join(by_text, ["t", "nodes", "y"]).select("rep", "id")
    pairs = equal.unionByName(odd).distinct()
    sizes = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return pairs.join(sizes, "rep").select(F.col("rep").alias("group_id"), F.col("id").alias("member_id"), "copies")
