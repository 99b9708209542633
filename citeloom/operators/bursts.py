"""Kleinberg bursts of label series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import lookups as L
from citeloom.operators.frequency import observed_years, top_k
from citeloom.operators.temporal import dated

BURST_SCHEMA = "label string, burst_strength double, adjusted_score double, burst_weight double, start int, end int, duration int, max_freq long"


def burst_states(counts: np.ndarray) -> tuple[list[int], float]:
    """The cheapest path of states and its cost.

    States i have rate mean * 2**i up to one and a half times the peak (two at least); staying
    costs the Poisson deviance of the count, a move of d states ln(number of states) * d.
    """
    x = np.asarray(counts, dtype=float)
    mean = x.mean()
    top = 1
    while mean * 2 ** (top + 1) <= 1.5 * x.max():
        top += 1
    rates = mean * 2.0 ** np.arange(top + 1)
    step = math.log(top + 1)
    states = np.arange(top + 1)
    move = step * np.abs(states[:, None] - states[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.where(x[:, None] > 0, x[:, None] * np.log(x[:, None] / rates) + rates - x[:, None], rates)
    total = fit[0] + step * states
    parents = []
    for row in fit[1:]:
        via = total[:, None] + move
        best = via.argmin(axis=0)
        parents.append(best)
        total = via[best, states] + row
    path = [int(total.argmin())]
    for best in reversed(parents):
        path.append(int(best[path[-1]]))
    path.reverse()
    return path, float(total.min())


def burst_runs(counts: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first, last, weight, score) of each run above the base state."""
    x = np.asarray(counts, dtype=float)
    if x.size == 0 or x.max() <= 0:
        return []
    path, mean = burst_states(x)[0], x.mean()
    runs = []
    begin = None
    for t, s in enumerate([*path, 0]):
        if s > 0 and begin is None:
            begin = t
        elif s == 0 and begin is not None:
            part = x[begin:t]
            seen = part[part > 0]
            score = max(0.0, float((seen * np.log(seen / mean) - (seen - mean)).sum()))
            runs.append((begin, t - 1, float(part.mean() / mean), score))
            begin = None
    return runs


def _bursts(frame: pd.DataFrame, fallback: bool) -> pd.DataFrame:
    rows = []
    for label, years, entries in zip(frame["label"], frame["years"], frame["entries"]):
        seen = {e["year"]: e["n"] for e in entries}
        years = list(years)
        counts = np.array([seen.get(y, 0) for y in years])
        runs = burst_runs(counts)
        peak = int(counts.max()) if len(counts) else 0
        found = [(round(s, 4), w, i, j) for i, j, w, s in runs]
        if fallback and not runs and peak > 0:
            at = int(counts.argmax())
            found = [(1.0, peak / max(1.0, counts.mean()), at, at)]
        for s, w, i, j in found:
            d = int(years[j] - years[i] + 1)
            rows.append((label, s, round(s / max(1, d) ** 0.75, 4), round(w, 2), int(years[i]), int(years[j]), d, peak))
    return pd.DataFrame(rows, columns=["label", "burst_strength", "adjusted_score", "burst_weight", "start", "end", "duration", "max_freq"])


def burst_table(series: DataFrame, years: Column, top_n: int = 20, fallback: bool = False) -> DataFrame:
    """Bursts of (label, entries) with entries (year, n) over ``years``; needs three years at least."""
    base = series.select("label", years.alias("years"), "entries").filter(F.size("years") >= 3)
    found = base.mapInPandas(lambda it: (_bursts(f, fallback) for f in it), BURST_SCHEMA)
    return found.orderBy(F.desc("adjusted_score"), F.desc("burst_strength"), F.desc("burst_weight"), F.asc("start"), F.desc("max_freq"), F.asc("label")).limit(top_n)


def _series(counts: DataFrame) -> DataFrame:
    """(label, entries): one array of (year, n) per label, no longer than the range of years."""
    return counts.groupBy("label").agg(F.collect_list(F.struct("year", "n")).alias("entries"))


def keyword_bursts(keywords: DataFrame, papers: DataFrame, top_n: int = 20, min_total: int = 3, min_years: int = 2, label: str = "keyword") -> DataFrame:
    """Bursts of keywords; generic terms and single words that anchor the whole corpus are left out."""
    years = observed_years(papers)
    counts = dated(keywords, papers).groupBy(F.col(label).alias("label"), "year").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("active"))
    leaders = F.broadcast(top_k(stats, "label", 3, "total").select("label", F.lit(True).alias("lead")))
    anchor = F.col("lead").isNotNull() & ~F.col("label").contains(" ") & (F.col("total") >= 100) & (F.col("active") / F.size(years) >= 0.75)
    usual = stats.filter((F.col("total") >= min_total) & (F.col("active") >= min_years)).join(leaders, "label", "left")
    chosen = usual.filter(~F.col("label").isin(L.BURST_GENERIC) & ~anchor).select("label")
    return burst_table(_series(counts.join(chosen, "label", "left_semi")), years, top_n)


def reference_bursts(refs: DataFrame, papers: DataFrame, top_n: int = 20, label: str = "ref") -> DataFrame:
    """Bursts of cited references over the years of the citing papers, with a peak where there is none."""
    years = observed_years(papers)
    counts = dated(refs.filter(F.col(label).isNotNull()), papers).groupBy(F.col(label).alias("label"), "year").agg(F.count(F.lit(1)).alias("n"))
    return burst_table(_series(counts), years, top_n, fallback=True)




def register_udtf(spark, name: str = "kleinberg_bursts") -> None:
    """``name(years, counts)`` as a table function: a row per burst of aligned arrays."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="start int, end int, weight double, score double")
    class Bursts:
        def eval(self, years: list, counts: list):
            for i, j, w, s in burst_runs(np.asarray(counts or [])):
                yield int(years[i]), int(years[j]), round(w, 2), round(s, 4)

    spark.udtf.register(name, Bursts)
