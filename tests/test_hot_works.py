"""Coupling and disruption with works that very many papers cite."""

import random
from itertools import combinations

from citeloom.operators.citations import disruption
from citeloom.operators.networks import coupling_pairs


def graph(seed, papers=40, works=12):
    rng = random.Random(seed)
    rows = {(p, w) for p in range(papers) for w in range(works) if rng.random() < (0.6 if w < 3 else 0.15)}
    return rows | {(p, 100 + p - 1) for p in range(1, papers, 2)}


def test_coupling_against_brute_force(spark):
    for seed, heavy in ((1, 2), (2, 5), (3, 1000), (4, 0)):
        rows = graph(seed)
        df = spark.createDataFrame([(p, str(w), "x") for p, w in rows] + [(1, None, "x"), (None, "q", "x")] + [(p, str(w), "y") for p, w in list(rows)[:9]], "rec_id long, ref string, a string")
        cited = {p: {w for q, w in rows if q == p} for p, _ in rows}
        want = {(a, b): len(cited[a] & cited[b]) for a, b in combinations(sorted(cited), 2) if len(cited[a] & cited[b]) >= 2}
        assert {(r.a, r.b): r.weight for r in coupling_pairs(df, heavy=heavy).collect()} == want
        assert coupling_pairs(df.limit(0), heavy=heavy).count() == 0


def test_disruption_against_brute_force(spark):
    for seed, heavy in ((1, 2), (2, 5), (3, 1000)):
        rng = random.Random(seed)
        edges = {(rng.randrange(30), rng.choice([0, 0, 1, 2, rng.randrange(30)])) for _ in range(90)}  # some papers cite themselves
        refs = {p: {d for s, d in edges if s == p} for p in range(30)}
        got = {r.rec_id: (r.nd, r.nc, r.na, r.references, r.citers) for r in disruption(spark.range(30).withColumnRenamed("id", "rec_id"), spark.createDataFrame(sorted(edges) * 2, "src long, dst long"), heavy).collect()}
        for p in range(30):
            citers = {s for s, d in edges if d == p}
            near = {o for o in range(30) if refs[o] & refs[p]}
            assert got[p] == (len(citers - near), len(citers & near), len(near - citers - {p}), len(refs[p]), len(citers))


def test_one_work_cited_by_half_of_the_papers(spark):
    """Rows grow with the papers, not with their square: every pair shares the hot work only."""
    n = 30_000
    edges = spark.range(n).selectExpr("id + 10 AS src", "CASE WHEN id % 2 = 0 THEN 1L ELSE id + 1000000 END AS dst")
    papers = spark.range(n + 10).withColumnRenamed("id", "rec_id")
    hot = disruption(papers, edges).filter("na > 0")
    assert {(r.na, r["count"]) for r in hot.groupBy("na").count().collect()} == {(n // 2 - 1, n // 2)}
    assert coupling_pairs(edges.selectExpr("src AS rec_id", "cast(dst AS string) AS ref")).count() == 0
