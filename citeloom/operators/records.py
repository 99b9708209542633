"""Record tables: cleaning, coverage, deduplication, labels."""

from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import is_blank, trim_ws
from citeloom.session import materialize


def safe_year(c: Column, max_year: int | None = None) -> Column:
    """The year of a number in any writing, within 1900 and ``max_year`` (next year); else null."""
    d = trim_ws(c.cast("string")).try_cast("double")
    top = (date.today().year + 1) if max_year is None else max_year
    return F.when((d >= 1900) & (d < top + 1), F.floor(d)).cast("int")


def clean_years(df: DataFrame, year: str = "year", max_year: int | None = None) -> DataFrame:
    return df.withColumn(year, safe_year(F.col(year), max_year)).filter(F.col(year).isNotNull())


def year_window(df: DataFrame, start: int | None = None, end: int | None = None, year: str = "year") -> DataFrame:
    """Rows within a window that is clamped to the observed years."""
    lo, hi = df.agg(F.min(year)).scalar(), df.agg(F.max(year)).scalar()
    first = lo if start is None else F.greatest(F.lit(start), lo)
    last = hi if end is None else F.least(F.lit(end), hi)
    return df.filter(F.col(year).between(first, last))


def number_or_zero(c: Column) -> Column:
    d = trim_ws(c.cast("string")).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d).otherwise(F.lit(0.0))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, coverage): share of rows with a value, in one pass."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    wide = df.agg(*[F.count_if(~is_blank(F.col(c)) & (F.lower(trim_ws(F.col(c))) != "nan")).alias(c) for c in columns], n.alias("_n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    return wide.select(F.explode(pairs).alias("x"), "_n").select("x.field", "x.filled", F.round(F.col("x.filled") / F.col("_n"), 4).alias("coverage"))


def longest_earliest(column: str, order: str) -> Column:
    """The longest value of a group, the earliest row among equals; nulls lose. Associative."""
    c = F.col(column)
    key = F.struct((-F.length(c.cast("string"))).alias("l"), F.col(order).alias("o"))
    return F.min_by(c, F.when(c.isNotNull(), key)).alias(column)


def merge_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows with equal keys become one: per column the longest value; null keys stay single.

    The merged row keeps the smallest ``order``. Aggregation only, so a hot key costs one
    partial row per task.
    """
    keyed = df.withColumn("_k", key).withColumn("_k", F.coalesce(F.concat(F.lit("k"), F.col("_k")), F.concat(F.lit("r"), F.col(order).cast("string"))))
    others = [c for c in df.columns if c != order]
    out = keyed.groupBy("_k").agg(F.min(order).alias(order), *[longest_earliest(c, order) for c in others])
    return out.select(*df.columns)


def doi_key(c: Column) -> Column:
    k = F.lower(trim_ws(c))
    return F.when((k != "") & (k != "nan"), k)


def fuzzy_key(title: Column, authors: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat(title, F.coalesce(authors, F.lit("nan")))), "[^a-z0-9]", "")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _near(a: str, b: str, ratio: float) -> bool:
    return SequenceMatcher(None, a, b).ratio() > ratio


def _anchors(rows: pd.DataFrame, ratio: float) -> pd.DataFrame:
    """For each row the first earlier anchor that it resembles, else itself.

    Texts under 10 characters or of lengths that differ by over 30 do not resemble each other (the
    rule followed here). The ratio cannot exceed what the counts of equal characters allow; this
    bound, taken against all anchors at once, leaves few exact comparisons.
    """
    texts = rows["text"].tolist()
    sizes = np.array([len(t) for t in texts])
    counts = np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.int32)
    kept: list[int] = []
    anchor = []
    for i, ident in enumerate(rows["id"]):
        hit = None
        if kept and sizes[i] >= 10:
            k = np.array(kept)
            both = np.minimum(counts[k], counts[i]).sum(axis=1)
            fit = (sizes[k] >= 10) & (np.abs(sizes[k] - sizes[i]) <= 30) & (2 * both > ratio * (sizes[k] + sizes[i]))
            hit = next((j for j in k[fit] if _near(texts[j], texts[i], ratio)), None)
        if hit is None:
            kept.append(i)
            anchor.append(ident)
        else:
            anchor.append(rows["id"].iloc[hit])
    return pd.DataFrame({"id": rows["id"], "anchor": anchor})


def fuzzy_groups(df: DataFrame, order: str, title: str, authors: str, year: str, ratio: float = 0.85) -> DataFrame:
    """(id, anchor) of rows that resemble an earlier row of their block.

    Blocks are year (missing years are one) and the first 20 letters and digits of title and authors. Equal texts are
    collapsed before the pairwise step, so a block only holds different texts; the comparison
    is greedy in the order of rows, with ``ratio`` of the longest matching blocks.
    """
    base = df.select(F.col(order).alias("id"), F.coalesce(F.substring(trim_ws(F.col(year).cast("string")), 1, 4), F.lit("")).alias("y"), fuzzy_key(F.col(title), F.col(authors)).alias("text"))
    base = base.filter("text <> ''").withColumn("b", F.substring("text", 1, 20))
    texts = base.groupBy("y", "b", "text").agg(F.min("id").alias("id"))
    many = texts.groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("y", "b")
    schema = T.StructType([T.StructField("id", df.schema[order].dataType), T.StructField("anchor", df.schema[order].dataType)])
    near = texts.join(many, ["y", "b"]).groupBy("y", "b").applyInPandas(lambda p: _anchors(p.sort_values("id"), ratio), schema)
    first = base.join(texts.withColumnRenamed("id", "first"), ["y", "b", "text"], "left")
    named = first.join(near.withColumnRenamed("id", "first"), "first", "left")
    return named.select("id", F.coalesce("anchor", "first").alias("anchor")).filter("id <> anchor")


def deduplicate(df: DataFrame, order: str = "rec_id", doi: str = "doi", title: str = "title", authors: str = "authors", year: str = "year", ratio: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(records, report): rows merged by DOI, then by resembling title and authors.

    ``report`` is one row (original, removed, final).
    """
    once = merge_by_key(df, doi_key(F.col(doi)), order)
    groups = fuzzy_groups(once, order, title, authors, year, ratio).withColumnRenamed("id", order)
    named = once.join(groups, order, "left").withColumn("_g", F.coalesce("anchor", order)).drop("anchor")
    others = [c for c in df.columns if c != order]
    out = named.groupBy("_g").agg(F.min(order).alias(order), *[longest_earliest(c, order) for c in others]).select(*df.columns)
    report = df.agg(F.count(F.lit(1)).alias("original")).select("original", (F.col("original") - out.agg(F.count(F.lit(1))).scalar()).alias("removed"), out.agg(F.count(F.lit(1))).scalar().alias("final"))
    return out, report


#: Most letters of a suffix; 26 ** 9 repeats of one label are beyond any table.
SUFFIX_LETTERS = 9


def label_suffix(pos: Column) -> Column:
    """a, b, ..., z, aa, ab, ..., zz, aaa, ... for 0, 1, ..."""
    out, first = F.lit(""), 0  # first position of each length
    chain = None
    for size in range(1, SUFFIX_LETTERS + 1):
        rest = pos - F.lit(first).cast("long")
        out = F.concat(*[F.char((F.lit(97) + F.floor(rest / F.lit(26**k).cast("long")) % 26).cast("int")) for k in range(size - 1, -1, -1)])
        first += 26**size
        fits = pos < F.lit(first).cast("long")
        chain = F.when(fits, out) if chain is None else chain.when(fits, out)
    return chain


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with _pos, the place of each row in its group from 0, and _n, the size of the group.

    The rows are sorted over all tasks and each task numbers its share; what comes before is a
    sum over the tasks. So a group that holds a third of the rows is never gathered in one task.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(width, group, order).withColumn("_task", F.spark_partition_id()), "numbered")
    share = placed.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_c"))  # at most one row per group and task
    w = W.partitionBy(group)
    before = share.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy(group, "_task").orderBy(order)) - 1)
    return own.join(before.drop("_c"), [group, "_task"]).withColumn("_pos", F.col("_own") + F.col("_before")).drop("_own", "_before", "_task")


def paper_labels(df: DataFrame, order: str = "rec_id", authors: str = "authors", year: str = "year", title: str = "title") -> DataFrame:
    """(``order``, label): ``FirstAuthor, Year`` or a short title; repeats get a, b, ... after the year.

    Repeats are numbered in the order of ``order``.
    """
    first = trim_ws(F.get(F.split(F.get(F.split(authors, ";"), F.lit(0)), ","), F.lit(0)))
    first = F.when(first.rlike(r"(?U)^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") & (F.length(first) > 1), F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2))))).otherwise(first)
    short = F.when(F.length(title) <= 25, F.col(title)).otherwise(F.concat(F.substring(title, 1, 22), F.lit("...")))
    shown = F.when(~is_blank(F.col(authors)) & (first != ""), first).when(~is_blank(F.col(title)), short).otherwise(F.concat(F.lit("Paper "), (F.col(order) + 1).cast("string")))
    y = F.coalesce(F.col(year).cast("string"), F.lit("N/A"))
    base = df.select(order, F.concat_ws(", ", shown, y).alias("label"))
    return numbered(base, "label", order).select(order, F.when(F.col("_n") > 1, F.concat("label", label_suffix(F.col("_pos")))).otherwise(F.col("label")).alias("label"))
