"""Time series of keywords and entities: growth, shares, forecasts, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.frequency import entity_year_grid, frequency, observed_years, top_k


def dated(long: DataFrame, papers: DataFrame) -> DataFrame:
    return long.join(papers.filter("year is not null").select("rec_id", "year"), "rec_id")


def timeline(long: DataFrame, papers: DataFrame, label: str = "keyword", top_n: int = 20) -> DataFrame:
    """(label, year, n) of the top labels, years with a count only."""
    top = F.broadcast(top_k(frequency(long, label), label, top_n).select(label))
    return dated(long.join(top, label, "left_semi"), papers).groupBy(label, "year").agg(F.count(F.lit(1)).alias("n"))


def selected_share(long: DataFrame, papers: DataFrame, selected: list[str], label: str = "keyword") -> DataFrame:
    """(year, label, n, total, share) among selected labels; years without any are left out."""
    rows = dated(long.filter(F.col(label).isin(selected)), papers).groupBy("year", label).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("year").agg(F.sum("n").alias("total"))
    grid = totals.withColumn(label, F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(selected)])))
    full = grid.join(rows, ["year", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("year", label, "n", "total", F.round(F.col("n") * 100 / F.col("total"), 2).alias("share"))


def _slope(y: str, x: str = "year") -> Column:
    return F.coalesce(F.when(F.count_distinct(F.col(y)) > 1, F.regr_slope(y, x)), F.lit(0.0))


def yearly_shares(long: DataFrame, papers: DataFrame, label: str, candidates: DataFrame) -> DataFrame:
    """(label, year, n, publications, share): share of papers on all observed years."""
    pubs = frequency(papers.filter("year is not null"), "year", "publications")
    grid = entity_year_grid(dated(long, papers), label, candidates, observed_years(papers))
    return grid.join(F.broadcast(pubs), "year").withColumn("share", F.round(F.col("n") * 100 / F.col("publications"), 4))  # one row per year


def keyword_growth(long: DataFrame, papers: DataFrame, label: str = "keyword", top_n: int = 60, min_total: int = 3, min_latest: int = 2) -> DataFrame:
    """Growth of the share of papers from the previous to the latest observed year, with the trend."""
    cand = top_k(frequency(long, label), label, top_n).filter(F.col("n") >= min_total).select(label)
    y = yearly_shares(long, papers, label, cand)
    years = observed_years(papers)
    last, prev = F.element_at(years, -1), F.try_element_at(years, F.lit(-2))
    at = lambda c, year: F.max(F.when(F.col("year") == year, F.col(c)))
    s = y.groupBy(label).agg(
        at("n", last).alias("latest_count"), at("n", prev).alias("previous_count"), at("share", last).alias("ls"), at("share", prev).alias("ps"), at("publications", prev).alias("pp"),
        _slope("share").alias("slope"), F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("active_years"),
    ).filter((F.col("latest_count") >= min_latest) & F.col("ps").isNotNull())
    base = F.greatest("ps", F.lit(100.0) / F.greatest("pp", F.lit(1)))
    return s.select(
        label, last.alias("latest_year"), prev.alias("previous_year"), "latest_count", "previous_count", F.round("ls", 3).alias("latest_share"), F.round("ps", 3).alias("previous_share"),
        F.round((F.col("ls") - F.col("ps")) / base * 100, 2).alias("growth"), F.round(F.col("ls") - F.col("ps"), 3).alias("net_change"), F.round("slope", 4).alias("trend_slope"), "total", "active_years",
    )


def publication_forecast(papers: DataFrame, horizon: int = 4, lookback: int = 8, min_years: int = 4) -> DataFrame:
    """(year, publications, series): observed counts and a line through the last observed years."""
    counts = frequency(papers.filter("year is not null"), "year")
    recent = counts.orderBy(F.desc("year")).limit(lookback)
    fit = recent.agg(F.regr_slope("n", "year").alias("s"), F.regr_intercept("n", "year").alias("i"), F.max("year").alias("last"))
    enough = counts.agg(F.count(F.lit(1))).scalar() >= min_years
    future = fit.select("s", "i", F.explode(F.sequence(F.col("last") + 1, F.col("last") + horizon)).alias("year"))
    actual = counts.select("year", F.col("n").cast("double").alias("publications"), F.lit("Actual").alias("series"))
    ahead = future.select("year", F.round(F.greatest(F.lit(0.0), F.col("s") * F.col("year") + F.col("i")), 2).alias("publications"), F.lit("Forecast").alias("series"))
    return actual.unionByName(ahead).filter(enough)


def entity_forecast(long: DataFrame, papers: DataFrame, label: str, top_n: int = 15, horizon: int = 3, lookback: int = 6, min_total: int = 3) -> tuple[DataFrame, DataFrame]:
    """(summary, series): lines through the last observed years of each candidate."""
    base = dated(long.select("rec_id", label).distinct(), papers)
    years = observed_years(papers)
    cand = top_k(frequency(base, label), label, top_n * 3).filter(F.col("n") >= min_total).select(label)
    grid = entity_year_grid(base, label, cand, years)
    last, first_fit = F.element_at(years, -1), F.element_at(years, -F.least(F.lit(lookback), F.size(years)))
    fits = F.col("year") >= first_fit
    y, x = F.when(fits, F.col("n").cast("double")), F.when(fits, F.col("year").cast("double"))
    s = grid.groupBy(label).agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("year") == last, F.col("n"))).alias("latest"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count_if(F.col("n") > 0).alias("active_years")
    ).filter(F.size(years) >= 4)
    ahead = lambda year: F.greatest(F.lit(0.0), F.col("slope") * year + F.col("intercept"))
    nxt = ahead(last + 1)
    summary = s.select(
        label, "total", last.alias("latest_year"), F.col("latest").cast("double").alias("latest_count"), F.round(nxt, 2).alias("projected_next"),
        F.round((nxt - F.col("latest")) / F.greatest(F.col("latest").cast("double"), F.lit(1.0)) * 100, 2).alias("projected_growth"), F.round("slope", 4).alias("trend_slope"), "active_years",
    ).orderBy(F.desc("projected_growth"), F.desc("projected_next"), F.desc("total"), F.asc(label)).limit(top_n)
    kept = F.broadcast(summary.select(label))
    actual = grid.join(kept, label, "left_semi").select(label, "year", F.col("n").cast("double").alias("n"), F.lit("Actual").alias("series"))
    future = s.join(kept, label, "left_semi").withColumn("year", F.explode(F.sequence(last + 1, last + horizon)))
    return summary, actual.unionByName(future.select(label, "year", F.round(ahead(F.col("year")), 2).alias("n"), F.lit("Forecast").alias("series")))


def _windows(years: Column, recent: int) -> tuple[Column, Column]:
    """(focus, baseline): the last two of the last ``recent`` observed years, and the rest of them
    (or the first of them if there is no rest)."""
    tail = F.slice(years, -F.least(F.lit(recent), F.size(years)), recent)
    n = F.size(tail)
    focus = F.slice(tail, -F.least(F.lit(2), n), 2)
    rest = F.slice(tail, 1, F.greatest(n - 2, F.lit(0)))
    return focus, F.when(F.size(rest) > 0, rest).otherwise(F.slice(tail, 1, 1))


def leadership_shift(long: DataFrame, papers: DataFrame, label: str, top_n: int = 12, recent: int = 4, min_total: int = 3) -> DataFrame:
    """Shift of the share of papers between recent windows, with a signal by the median split."""
    base = long.select("rec_id", label).distinct()
    cand = top_k(frequency(dated(base, papers), label), label, top_n * 3).filter(F.col("n") >= min_total).select(label)
    years = observed_years(papers)
    y = yearly_shares(base, papers, label, cand).withColumn("share", F.col("n") * 100 / F.greatest("publications", F.lit(1)))
    focus, rest = _windows(years, recent)
    s = y.groupBy(label).agg(
        F.sum("n").alias("total"), F.avg(F.when(F.array_contains(focus, F.col("year")), F.col("share"))).alias("r"), F.avg(F.when(F.array_contains(rest, F.col("year")), F.col("share"))).alias("b"),
        F.max(F.when(F.col("year") == F.element_at(years, -1), F.col("n"))).alias("latest_count"), F.count_if(F.col("n") > 0).alias("active_years"),
    ).filter(F.size(years) >= 3)
    shift = F.col("r") - F.col("b")
    s = s.select(
        label, "total", F.round("r", 3).alias("recent_share"), F.round("b", 3).alias("baseline_share"), F.round(shift, 3).alias("share_shift"),
        F.round(shift / F.greatest(F.abs("b"), F.lit(0.1)) * 100, 2).alias("momentum"), "latest_count", "active_years",
    )
    mid = s.agg(F.percentile("recent_share", F.lit(0.5))).scalar()
    big, up = F.col("recent_share") >= mid, F.col("share_shift") >= 0
    signal = F.when(big & up, "Rising Leaders").when(~big & up, "Emerging Challengers").when(big, "Established but Slipping").otherwise("Peripheral / Stable")
    return s.withColumn("signal", signal).orderBy(F.desc("share_shift"), F.desc("recent_share"), F.desc("total"), F.asc(label)).limit(top_n)


def opportunity_map(long: DataFrame, papers: DataFrame, label: str = "keyword", top_n: int = 40, recent: int = 4, min_total: int = 3) -> DataFrame:
    """Recent against baseline share of keywords, with a signal by the median split over all rows."""
    cand = top_k(frequency(long, label), label, top_n).filter(F.col("n") >= min_total).select(label)
    years = observed_years(papers)
    y = yearly_shares(long, papers, label, cand)
    focus, rest = _windows(years, recent)
    in_focus, in_rest = F.array_contains(focus, F.col("year")), F.array_contains(rest, F.col("year"))
    s = y.groupBy(label).agg(
        F.avg(F.when(in_focus, F.col("share"))).alias("r"), F.avg(F.when(in_rest, F.col("share"))).alias("b"), F.max(F.when(in_rest, F.col("publications"))).alias("p"),
        F.sum(F.when(in_focus, F.col("n")).otherwise(0)).alias("recent_count"), F.sum("n").alias("total"),
    ).filter((F.size(years) >= 3) & (F.col("recent_count") > 0) & (F.col("total") >= min_total))
    growth = (F.col("r") - F.col("b")) / F.greatest("b", F.lit(100.0) / F.greatest("p", F.lit(1))) * 100
    s = s.select(label, F.round("r", 3).alias("recent_share"), F.round("b", 3).alias("baseline_share"), F.round(growth, 2).alias("growth"), "recent_count", "total")
    mid = s.agg(F.percentile("recent_share", F.lit(0.5))).scalar()
    big, up = F.col("recent_share") >= mid, F.col("growth") >= 0
    signal = F.when(big & up, "Core Hotspots").when(~big & up, "Emerging Signals").when(big, "Mature but Cooling").otherwise("Niche / Weakening")
    return s.withColumn("signal", signal)


def year_slices(papers: DataFrame, k: int = 4) -> DataFrame:
    """(year, slice): observed years in k runs of nearly equal length, the first ones longer."""
    years = papers.filter("year is not null").select("year").distinct()
    n = years.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # a number of years
    k = max(1, min(max(2, k), n))
    return years.select("year", F.ntile(k).over(W.orderBy("year")).alias("slice"))
