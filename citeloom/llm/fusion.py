"""One surviving record per group of duplicates: Bayesian fusion with copy detection.

Every row claims a value for each field. Missing values, stand-ins and values cut short cannot
be true: their posterior is 0. For the rest, source accuracies and the dependence between
sources are estimated by EM over all groups: a source is as accurate as the mean posterior of
its claims, two sources that share more false values than independent errors would are taken
as copying, and copied votes are discounted.

Each candidate row gets one log posterior, the sum of a prior and of the votes for its value,
and the row with the greatest one survives. With ``declared`` standing the prior holds the
source's rank and the row's time in steps that exceed the sum of all votes, so votes, accuracies
and copying decide between rows of equal rank and time; without it the prior is flat. Rows that
are level in all of this are told apart by standing and then by the smallest id.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import trim_ws
from citeloom.session import materialize

# Writings that stand in for a missing value, as bare lower-case letters and digits.
STAND_INS = [
    "", "nan", "na", "none", "null", "untitled", "notitle", "titlenotavailable", "titlemissing", "noabstract", "noabstractavailable",
    "abstractmissing", "abstract", "abstractnotavailable", "abstractunavailable", "notavailable",
    "abstractnotsuppliedbythepublisherinthisexportseethefullrecord",
]
#: Fixed value: marks at the end of a value that was cut short.
CUT_MARK = r"(?i)\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\[truncated\]|\(truncated\)|\[cut\])\s*$"


def bare_doi(c: Column) -> Column:
    """The DOI in a cell in lower case, without prefixes and closing punctuation; null if none is whole."""
    found = F.regexp_extract(F.lower(c), r"(10\.\d{4,9}/\S*[^\s.,;:\"'])", 1)
    return F.when(found != "", found)


def comparable(c: Column) -> Column:
    """Letters and digits of a value in lower case, without a mark of shortening."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, CUT_MARK, "")), r"[^\p{L}\p{N}]+", "")


#: Microseconds that no two times lie apart (beyond the year 9999 since year 0).
SPAN = 400_000_000_000_000_000
#: Share of its values that a copying source takes over.
COPIED = 0.8


def _claims(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per row and field with ``usable``: neither missing, a stand-in nor cut short.

    A value is cut short if it is the beginning of the group's fullest value, or carries a mark
    of shortening and is shorter than it.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("c")
    r = rows.select("key", "id", "source", "rank", "at", cells).select("key", "id", "source", "rank", "at", "c.*")
    r = r.withColumn("text", F.coalesce(trim_ws(F.col("v")), F.lit(""))).withColumn("norm", comparable(F.col("text")))
    r = r.withColumn("blank", F.col("norm").isin(STAND_INS)).withColumn("size", F.when(F.col("blank"), 0).otherwise(F.length("norm")))
    r = r.withColumn("marked", F.col("text").rlike(CUT_MARK)).drop("v", "text")
    full = r.groupBy("field", "key").agg(F.max(F.struct("size", "norm")).alias("f")).select("field", "key", F.col("f.size").alias("most"), F.col("f.norm").alias("fullest"))
    short = (F.col("size") < F.col("most")) & (F.expr("startswith(fullest, norm)") | F.col("marked"))
    usable = ~F.col("blank") & ~short
    return r.join(full, ["field", "key"]).select("field", "key", "id", "source", "rank", "at", usable.alias("usable"), F.xxhash64("norm").alias("val"))


def _votes(claims: DataFrame) -> DataFrame:
    """(field, key, val, sources): usable values of each group with the set of their sources."""
    return (
        claims.filter("usable").groupBy("field", "key", "val").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    )  # a set of sources, of which there are few


def _weight(accuracy: float, error_values: int) -> float:
    return math.log(error_values * accuracy / (1 - accuracy))


def estimate(votes: DataFrame, rounds: int = 3, error_values: int = 10, prior_copy: float = 0.2) -> tuple[dict[tuple[str, str], float], dict[tuple[str, str, str], float]]:
    """Source accuracies by (field, source) and probabilities of copying by (field, a, b), by EM.

    One job a round; what comes to the driver is one row per source and per pair of sources.
    """
    acc: dict[tuple[str, str], float] = {}
    copy: dict[tuple[str, str, str], float] = {}
    pairs = F.expr("flatten(transform(sources, (x, i) -> transform(slice(sources, i + 2, size(sources)), y -> struct(x as a, y as b))))")
    singles = F.transform("sources", lambda x: F.struct(x.alias("a"), F.lit(None).cast("string").alias("b")))
    for _ in range(rounds):
        seen = (
            posteriors(votes, acc, copy, error_values).select("field", F.explode(F.concat(singles, pairs)).alias("ab"), "p")
            .groupBy("field", "ab.a", "ab.b").agg(F.avg("p").alias("mean"), F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect()
        )
        acc = {(r.field, r.a): min(max(r.mean, 0.05), 0.99) for r in seen if r.b is None}
        copy = {}
        for r in seen:
            if r.b is None:
                continue
            a1, a2 = acc[r.field, r.a], acc[r.field, r.b]
            both_true, both_false = a1 * a2, (1 - a1) * (1 - a2) / error_values
            t = math.log(both_true / (COPIED * a1 + (1 - COPIED) * both_true)) * r.true
            f = math.log(both_false / (COPIED * (1 - a1) + (1 - COPIED) * both_false)) * r.false
            odds = math.log((1 - prior_copy) / prior_copy) + t + f
            copy[r.field, r.a, r.b] = 1 / (1 + math.exp(min(max(odds, -50), 50)))
    return acc, copy


def _table(entries: dict[tuple, float]) -> Column:
    """A map column of a few numbers, folded into a constant by the optimizer."""
    return F.from_json(F.lit(json.dumps({"\u0001".join(k): v for k, v in entries.items()})), "map<string,double>")


def vote_sum(acc: dict[tuple[str, str], float], copy: dict[tuple[str, str, str], float], error_values: int) -> Column:
    """Sum of the votes of ``sources``; each is discounted by the sources before it that it may copy."""
    weights, copies = _table({k: _weight(a, error_values) for k, a in acc.items()}), _table(copy)
    name = lambda *c: F.concat_ws("\u0001", F.col("field"), *c)
    start = F.lit(_weight(0.8, error_values))  # a source without an estimate

    def vote(s: Column, i: Column) -> Column:
        own = F.coalesce(F.try_element_at(weights, name(s)), start)
        return F.aggregate(F.slice("sources", F.lit(1), i), own, lambda w, o: w * (1 - COPIED * F.coalesce(F.try_element_at(copies, name(o, s)), F.lit(0.0))))

    return F.aggregate(F.transform("sources", vote), F.lit(0.0), lambda x, y: x + y)


def posteriors(votes: DataFrame, acc: dict[tuple[str, str], float], copy: dict[tuple[str, str, str], float], error_values: int = 10) -> DataFrame:
    """``votes`` with the vote sum and p, the posterior of each value within its group.

    ``error_values`` unnamed false values without votes are among the values of every group.
    """
    v = votes.withColumn("votes", vote_sum(acc, copy, error_values)).withColumn("e", F.exp(F.least(F.col("votes"), F.lit(700.0))))
    norm = v.groupBy("field", "key").agg((F.sum("e") + float(error_values)).alias("z"))
    return v.join(norm, ["field", "key"]).withColumn("p", F.col("e") / F.col("z")).drop("e", "z")


def grouped_rows(df: DataFrame, key: Column, id_col: str, source: str, at: str, fields: list[str], ranks: DataFrame | None, rank_source: str = "feed", rank_col: str = "trust_rank") -> DataFrame:
    """Rows of groups with two or more rows: (key, id, source, rank, at, fields...)."""
    rows = df.select(key.alias("key"), F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(at).alias("at"), *fields).filter("key is not null and id is not null")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = rows.join(many, "key")
    if ranks is None:
        return rows.withColumn("rank", F.lit(None).cast("int"))
    return rows.join(ranks.select(F.col(rank_source).alias("source"), F.col(rank_col).alias("rank")).dropDuplicates(["source"]), "source", "left")


def standing() -> Column:
    """Rank and time of a row as one number, greater for lower ranks and then for later times.

    Null ranks come last, null times are oldest.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp")).cast("decimal(18,0)") + F.lit(SPAN // 4).cast("decimal(18,0)")
    rank = F.coalesce(F.col("rank").cast("decimal(10,0)"), F.lit(2**31).cast("decimal(10,0)"))
    return (F.coalesce(micros, F.lit(0).cast("decimal(19,0)")) - rank * F.lit(SPAN).cast("decimal(18,0)")).cast("decimal(29,0)")


def fuse(rows: DataFrame, fields: list[str], declared: bool = True, error_values: int = 10) -> DataFrame:
    """(key, <field>_id, <field>_p for each field): the row whose value survives, 0 if none is usable.

    ``rows`` comes from ``grouped_rows``. The row with the greatest log posterior survives;
    ``p`` is the share of its value by votes alone, null for none. All steps aggregate before
    they shuffle, so a group that holds a third of the rows costs one row per task.
    """
    rows = materialize(rows, "groups")
    claims = materialize(_claims(rows, fields), "claims")
    votes = materialize(_votes(claims), "votes")
    acc, copy = estimate(votes, error_values=error_values)
    post = posteriors(votes, acc, copy, error_values).select("field", "key", "val", "votes", "p")
    by_field = {f: sum(abs(_weight(a, error_values)) for (g, _), a in acc.items() if g == f) for f in fields}
    step = math.ceil(2 * max(by_field.values())) + 1 if declared else 0  # more than any two vote sums can differ by
    prior = standing() * F.lit(step).cast("decimal(5,0)")
    score = (prior.cast("decimal(34,0)") + F.round("votes", 3).cast("decimal(20,3)")).cast("decimal(37,3)")
    order = F.struct((-score).alias("score"), (-standing()).alias("standing"), F.col("id"), F.col("p"))
    scored = claims.join(post, ["field", "key", "val"], "left").select("field", "key", F.when(F.col("usable"), order).alias("o"))
    best = scored.groupBy("key").agg(*[F.min(F.when(F.col("field") == f, F.col("o"))).alias(f) for f in fields])
    return best.select("key", *[c for f in fields for c in (F.coalesce(F.col(f)["id"], F.lit(0)).alias(f"{f}_id"), F.col(f)["p"].alias(f"{f}_p"))])
