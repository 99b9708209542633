"""Counts, shares and distributions over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, split_terms, trim_ws


def frequency(long: DataFrame, label: str, name: str = "n") -> DataFrame:
    """(label, n); a hot label costs one partial row per task."""
    return long.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def label_year_counts(df: DataFrame, label: str, year: str = "year") -> DataFrame:
    """(label, year, n) over rows that have both."""
    return df.filter(F.col(label).isNotNull() & F.col(year).isNotNull()).groupBy(label, year).agg(F.count(F.lit(1)).alias("n"))


def single_value_frequency(df: DataFrame, column: str) -> DataFrame:
    return frequency(df.filter(~is_blank(F.col(column))).select(trim_ws(F.col(column)).alias(column)), column)


def multi_value_frequency(df: DataFrame, column: str) -> DataFrame:
    return frequency(df.select(F.explode(split_terms(F.col(column))).alias(column)), column)


def funding_frequency(df: DataFrame, column: str = "funding") -> DataFrame:
    """(column, n) of the funders named in a cell, repeats counted."""
    return multi_value_frequency(df, column)


def fallback_frequency(df: DataFrame, first: str, second: str, label: str = "category") -> DataFrame:
    """Frequency of the first column, or of the second if the first yields nothing at all."""
    a, b = multi_value_frequency(df, first).withColumnRenamed(first, label), multi_value_frequency(df, second).withColumnRenamed(second, label)
    return a.unionByName(b.filter(a.agg(F.count(F.lit(1))).scalar() == 0))


def top_k(freq: DataFrame, label: str, k: int, by: str = "n") -> DataFrame:
    """The k most frequent labels, ties by label."""
    return freq.orderBy(F.desc(by), F.asc(label)).limit(k)


def ranked_table(freq: DataFrame, label: str, top_n: int = 10) -> DataFrame:
    """(rank, label, papers, share): share of the sum of the whole counter, in percent."""
    total = freq.agg(F.sum("n")).scalar()
    top = top_k(freq, label, top_n).withColumn("share", F.round(F.col("n") * 100 / total, 2))
    rank = F.row_number().over(W.orderBy(F.desc("n"), F.asc(label)))  # over the k rows only
    return top.select(rank.alias("rank"), label, F.col("n").alias("papers"), "share")


def distinct_count(long: DataFrame, column: str, name: str) -> DataFrame:
    return long.agg(F.countDistinct(column).alias(name))


def by_year(papers: DataFrame) -> DataFrame:
    """(year, publications, avg_citations, total_citations)."""
    return papers.filter("year is not null").groupBy("year").agg(
        F.count(F.lit(1)).alias("publications"), F.round(F.avg("times_cited"), 4).alias("avg_citations"), F.round(F.sum("times_cited"), 4).alias("total_citations")
    )


def annual_growth(papers: DataFrame) -> DataFrame:
    """(year, n, growth) over consecutive observed years, in percent."""
    years = frequency(papers.filter("year is not null"), "year")
    before = F.lag("n").over(W.orderBy("year"))  # one row per year
    return years.select("year", "n", F.round((F.col("n") - before) * 100 / before, 1).alias("growth"))


def overview(papers: DataFrame, keywords: DataFrame) -> DataFrame:
    base = papers.agg(
        F.count(F.lit(1)).alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("journal").alias("journals")
    )
    return base.withColumn("keywords", keywords.agg(F.countDistinct("keyword")).scalar())


def descriptive(papers: DataFrame, doi: str = "doi", abstract: str = "abstract") -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    span = F.max("year") - F.min("year") + 1
    return papers.agg(
        F.count(F.lit(1)).alias("records"), span.alias("span"), F.round(F.count_if(F.col("year").isNotNull()) / span, 2).alias("per_year"),
        F.round(F.count_if(~is_blank(F.col(doi))) * 100 / n, 2).alias("doi_coverage"), F.round(F.count_if(~is_blank(F.col(abstract))) * 100 / n, 2).alias("abstract_coverage"),
    )


def highly_cited(papers: DataFrame, k: int = 20) -> DataFrame:
    return papers.orderBy(F.desc("times_cited"), F.asc("rec_id")).limit(k).select("rec_id", "journal", "year", "times_cited")


def citation_quantile(papers: DataFrame, q: float = 0.99) -> DataFrame:
    return papers.agg(F.round(F.percentile("times_cited", F.lit(q)), 4).alias("p"))


def citation_histogram(papers: DataFrame, width: int = 10) -> DataFrame:
    b = F.floor(F.col("times_cited") / width) * width
    return papers.groupBy(b.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bradford_core(journals: DataFrame, label: str = "journal") -> DataFrame:
    """(rank, label, n, cumulative): journals whose cumulative share is at most a third of all papers, else the first.

    Journals are counted by size first, so the running sums are over one row per size; within a
    size the place follows from the order of labels, numbered over all tasks.
    """
    from citeloom.operators.records import numbered

    total = journals.agg(F.sum("n")).scalar()
    sizes = journals.groupBy("n").agg(F.count(F.lit(1)).alias("_k"))
    larger = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)  # one row per size
    before = sizes.select("n", F.coalesce(F.sum("_k").over(larger), F.lit(0)).alias("_r"), F.coalesce(F.sum(F.col("_k") * F.col("n")).over(larger), F.lit(0)).alias("_s"))
    out = numbered(journals, "n", label).drop("_n").join(before, "n")
    out = out.withColumn("rank", (F.col("_r") + F.col("_pos") + 1).cast("int")).withColumn("cumulative", F.col("_s") + (F.col("_pos") + 1) * F.col("n"))
    return out.filter((F.col("cumulative") <= total / 3) | (F.col("rank") == 1)).select("rank", label, "n", "cumulative")


def concentration(freq: DataFrame, label: str, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """(top, share): share of the k largest labels in all, in percent."""
    total = freq.agg(F.sum("n")).scalar()
    top = top_k(freq, label, max(ks)).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), F.asc(label))))
    ranks = F.explode(F.array(*[F.lit(k) for k in ks]))
    return top.withColumn("top", ranks).filter("r <= top").groupBy("top").agg(F.sum("n").alias("s")).select("top", F.round(F.col("s") * 100 / total, 2).alias("share"))


def lotka(authors: DataFrame, label: str = "author", tail: int = 99) -> DataFrame:
    """(papers, authors, empirical, theoretical): productivity against C / x**2."""
    per = frequency(authors, label, "papers")
    hist = frequency(per, "papers", "authors")
    total = per.agg(F.count(F.lit(1))).scalar()
    top = hist.agg(F.max("papers").cast("int").alias("m"))
    weight = 1 / F.aggregate(F.sequence(F.lit(1), F.col("m") + tail), F.lit(0.0), lambda a, x: a + 1 / (x.cast("double") * x))
    grid = top.select(weight.alias("c"), F.explode(F.sequence(F.lit(1), "m")).alias("papers"))
    out = grid.join(hist.select(F.col("papers").alias("_p"), "authors"), grid.papers == F.col("_p"), "left")
    return out.select(
        F.col("papers").cast("long").alias("papers"), F.coalesce("authors", F.lit(0)).alias("authors"), F.round(F.coalesce("authors", F.lit(0)) / total, 6).alias("empirical"),
        F.round(F.col("c") / (F.col("papers").cast("double") * F.col("papers")), 6).alias("theoretical"),
    )


def frequency_of_frequency(freq: DataFrame) -> DataFrame:
    return freq.groupBy(F.col("n").alias("frequency")).agg(F.count(F.lit(1)).alias("labels"))


def stacked_by_year(long: DataFrame, label: str, top_n: int = 5, other: str = "Others") -> DataFrame:
    """(year, label, n): the top labels kept, the rest as ``other``."""
    top = top_k(frequency(long, label), label, top_n).select(F.col(label).alias("_t"))
    named = long.filter("year is not null").join(F.broadcast(top), long[label] == F.col("_t"), "left")  # at most top_n rows
    return named.groupBy("year", F.when(F.col("_t").isNotNull(), F.col(label)).otherwise(F.lit(other)).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def entity_year_grid(long: DataFrame, label: str, entities: DataFrame, years: Column) -> DataFrame:
    """(label, year, n) for each entity of a bounded list and each year of an array."""
    grid = entities.select(label).withColumn("year", F.explode(years))
    counts = long.filter("year is not null").join(F.broadcast(entities.select(label)), label, "left_semi").groupBy(label, "year").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [label, "year"], "left").select(label, "year", F.coalesce("n", F.lit(0)).alias("n"))


def observed_years(papers: DataFrame) -> Column:
    """The observed years, sorted, as one array: bounded by the range of valid years."""
    return papers.filter("year is not null").agg(F.sort_array(F.collect_set("year"))).scalar()


def production_over_time(authors: DataFrame, papers: DataFrame, top_n: int = 10, label: str = "author") -> DataFrame:
    """(author, year, papers, total): top authors on all observed years."""
    dated = authors.join(papers.filter("year is not null").select("rec_id", "year"), "rec_id")
    top = top_k(frequency(dated, label, "total"), label, top_n, "total")
    grid = entity_year_grid(dated, label, top, observed_years(papers))
    return grid.join(F.broadcast(top), label).select(label, "year", F.col("n").alias("papers"), "total")
