"""Cited references: frequencies, year spectroscopy, internal citations and disruption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import references as R
from citeloom.functions.text import trim_ws
from citeloom.operators.networks import HEAVY, signature_overlaps, signatures
from citeloom.session import materialize, spread


def reference_frequency(refs: DataFrame, label: str = "ref") -> DataFrame:
    return refs.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def references_per_paper(refs: DataFrame, key: str = "rec_id") -> DataFrame:
    return refs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rpys(refs: DataFrame, year: str = "ref_year") -> DataFrame:
    """(year, n, median, deviation): counts on every year of the range against a centred 5-year median."""
    counts = refs.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    full = grid.join(counts, grid.year == counts.y, "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))
    w = W.orderBy("year").rowsBetween(-2, 2)  # one row per year
    return full.withColumn("median", F.percentile("n", F.lit(0.5)).over(w)).withColumn("deviation", F.col("n") - F.col("median"))


def rpys_peaks(refs: DataFrame, top_n: int = 10, refs_per_year: int = 3, label: str = "ref", year: str = "ref_year") -> DataFrame:
    """(year, n, deviation, top_references): years above their median with their most cited works."""
    peaks = rpys(refs, year).filter("deviation > 0").orderBy(F.desc("deviation"), "year").limit(top_n)
    counts = refs.filter(F.col(label).isNotNull()).join(F.broadcast(peaks.select(F.col("year").alias(year))), year, "left_semi").groupBy(year, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("k", F.row_number().over(W.partitionBy(year).orderBy(F.desc("n"), F.asc(label)))).filter(F.col("k") <= refs_per_year)
    shown = best.groupBy(year).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), "; ").alias("top_references"))
    return peaks.join(shown, peaks.year == shown[year], "left").select(peaks.year, "n", F.col("deviation").cast("int").alias("deviation"), F.coalesce("top_references", F.lit("")).alias("top_references"))


def match_keys(papers: DataFrame, authors: str = "authors", year: str = "year", journal: str = "journal", doi: str = "doi") -> DataFrame:
    """(rec_id, key, doi): first author, year and first journal word, and the DOI of each paper."""
    first = F.get(F.filter(R.reference_list(F.col(authors)), lambda x: x != ""), F.lit(0))
    return papers.select(
        "rec_id", R.primary_key(R.author_token(first), R.year_token(F.col(year).cast("string")), R.journal_token(F.col(journal))).alias("key"), R.doi_token(F.col(doi)).alias("doi")
    )


def internal_citations(papers: DataFrame, refs: DataFrame, raw: str = "raw", **columns: str) -> DataFrame:
    """(src, dst) distinct: references resolved to papers by key, else by DOI; the first paper of a key wins."""
    keys = match_keys(papers, **columns)
    by_key = keys.filter("key is not null").groupBy("key").agg(F.min("rec_id").alias("k_id"))
    by_doi = keys.filter("doi is not null").groupBy("doi").agg(F.min("rec_id").alias("d_id"))
    # works are cited often, so each writing is parsed and resolved once
    once = spread(refs.select(F.col(raw).alias("raw")).filter("raw is not null").distinct())
    p = F.filter(F.transform(F.split(F.upper("raw"), ","), trim_ws), lambda x: x != "")
    r = once.withColumn("p", p).withColumn("y", F.transform(F.slice("p", 2, 4), R.year_token))
    r = r.withColumn("at", (F.array_position(F.transform("y", lambda x: x != ""), F.lit(True))).cast("int"))
    key = R.primary_key(R.author_token(F.get("p", F.lit(0))), F.get("y", F.col("at") - 1), R.journal_token(F.get("p", F.col("at") + 1)))
    r = r.select("raw", F.when((F.size("p") >= 3) & (F.col("at") > 0), key).alias("key"), R.doi_token(F.col("raw")).alias("doi"))
    found = r.join(by_key, "key", "left").join(by_doi, "doi", "left").select("raw", F.coalesce("k_id", "d_id").alias("dst")).filter("dst is not null")
    return refs.select(F.col("rec_id").alias("src"), F.col(raw).alias("raw")).join(found, "raw").select("src", "dst").distinct()


def sharers(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(f, n): papers other than f that share a reference with f.

    ``edges`` are distinct (src, dst). Works cited by at most ``heavy`` papers pair their citers;
    the other works a paper cites form its signature, papers with overlapping signatures are
    counted per signature, and paired citers whose signatures overlap are not counted twice.
    """
    light, sigs = signatures(edges, "src", "dst", heavy)
    sigs = materialize(sigs, "signatures")
    kinds = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("sig", "sb")
    union = signature_overlaps(sigs, "src").join(kinds, "sb").groupBy("sa").agg((F.sum("m") - 1).alias("n"))
    by_sig = sigs.select(F.col("src").alias("f"), F.col("sig").alias("sa")).join(union, "sa").select("f", "n")
    pairs = light.select(F.col("src").alias("f"), "dst").join(light.select(F.col("src").alias("o"), "dst"), "dst").filter("f <> o").select("f", "o").distinct()
    sf, so = sigs.select(F.col("src").alias("f"), F.col("sig").alias("sf")), sigs.select(F.col("src").alias("o"), F.col("sig").alias("so"))
    once = pairs.join(sf, "f", "left").join(so, "o", "left").filter(~F.coalesce(F.arrays_overlap("sf", "so"), F.lit(False)))
    return once.groupBy("f").agg(F.count(F.lit(1)).alias("n")).unionByName(by_sig).groupBy("f").agg(F.sum("n").alias("n"))


def disruption(papers: DataFrame, edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(rec_id, nd, nc, na, references, citers, support, di) for every paper.

    With C the citers of a paper and B the papers that share a reference with it (itself
    included), nc = |C and B|, nd = |C without B|, na = |B without C and the paper|. nc and nd
    come from the citation edges, each with the reference lists of its two papers; na from the
    number of sharers, so a work cited by N papers never makes N squared rows beyond ``heavy``.
    """
    e = materialize(edges.select("src", "dst").distinct(), "citations")
    lists = e.groupBy("src").agg(F.collect_list("dst").alias("r"))  # references of one paper
    ends = e.join(lists.withColumnRenamed("r", "rs"), "src").join(lists.select(F.col("src").alias("dst"), F.col("r").alias("rd")), "dst", "left")
    shared = F.coalesce(F.arrays_overlap("rs", "rd"), F.lit(False))
    per = ends.groupBy(F.col("dst").alias("f")).agg(
        F.count_if(~shared).alias("nd"), F.count_if(shared).alias("nc"), F.count_if(shared & (F.col("src") != F.col("dst"))).alias("_both"), F.count(F.lit(1)).alias("citers")
    )
    out_refs = lists.select(F.col("src").alias("f"), F.size("r").cast("long").alias("references"))
    full = papers.select(F.col("rec_id").alias("f")).join(per, "f", "left").join(sharers(e, heavy), "f", "left").join(out_refs, "f", "left").fillna(0)
    full = full.withColumn("na", F.col("n") - F.col("_both"))
    support = F.col("nd") + F.col("nc") + F.col("na")
    di = F.when(support > 0, (F.col("nd") - F.col("nc")) / support).otherwise(0.0)
    return full.select(F.col("f").alias("rec_id"), "nd", "nc", "na", "references", "citers", support.alias("support"), F.round(di, 4).alias("di"))


def disruption_summary(di: DataFrame) -> DataFrame:
    return di.agg(
        F.count(F.lit(1)).alias("papers"), F.round(F.avg("di"), 4).alias("mean_di"), F.count_if(F.col("di") > 0).alias("positive"),
        F.count_if(F.col("di") < 0).alias("negative"), F.count_if(F.col("di") == 0).alias("neutral"),
    )


def topic_match(df: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows whose texts contain one of the terms."""
    import re

    text = F.lower(F.concat_ws(" ", *columns))
    return df.filter(text.rlike("|".join(re.escape(t.lower()) for t in terms))) if terms else df


def disruption_extremes(di: DataFrame, kind: str = "disruptive", top_n: int = 10, min_support: int = 0, min_citers: int = 0, min_references: int = 0, mode: str = "any") -> DataFrame:
    """The most disruptive or consolidating papers; thresholds of 0 are off, ``mode`` any or all."""
    tests = [F.col(c) >= t for c, t in (("support", min_support), ("citers", min_citers), ("references", min_references)) if t > 0]
    rows = di
    if tests:
        cond = tests[0]
        for t in tests[1:]:
            cond = (cond & t) if mode == "all" else (cond | t)
        rows = di.filter(cond)
    first = F.desc("di") if kind == "disruptive" else F.asc("di")
    return rows.orderBy(first, F.desc("support"), F.desc("citers"), F.asc("rec_id")).limit(top_n)
