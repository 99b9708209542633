"""Coupling counted block against block: only results leave the tasks."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import overlaps as O
from citeloom.operators import maps as Y
from citeloom.operators import networks as N
from citeloom.operators import structure as S
from citeloom.sources import reports as P

PAPERS = 3000


def shuffled(spark, run):
    """What ``run`` returns, and the rows written to shuffles meanwhile."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    total = 0
    for i in range(first, sc.dagScheduler().nextStageId()):
        try:
            total += sc.statusStore().lastStageAttempt(i).shuffleWriteRecords()
        except Exception:  # noqa: BLE001 - a skipped stage has no attempt
            pass
    return out, total


@pytest.fixture(scope="module")
def often(spark):
    """Papers that cite two of 12 works, each cited by 500, and a work of their own."""
    p = spark.range(PAPERS).withColumnRenamed("id", "rec_id")
    return p.select("rec_id", F.explode(F.expr("array(rec_id % 12, (rec_id + 1 + rec_id div 12 % 5) % 12, rec_id + 100)")).alias("ref")).withColumn("ref", F.col("ref").cast("string"))


def couples():
    cited = [{p % 12, (p + 1 + p // 12 % 5) % 12} for p in range(PAPERS)]
    return {(a, b): 2 for a, b in combinations(range(PAPERS), 2) if cited[a] == cited[b]}


def strengths(pairs):
    sums = {}
    for ends, n in pairs.items():
        for p in ends:
            sums[p] = sums.get(p, 0) + n
    return sums


def test_pairs_are_not_shuffled(spark, often):
    got, rows = shuffled(spark, lambda: {(r.a, r.b): r.weight for r in N.coupling_pairs(often).collect()})
    assert got == couples() and rows < 20 * 3 * PAPERS  # some 1.4 million pairs share a work


def test_network_without_pairs_of_all(spark, often):
    (nodes, edges), rows = shuffled(spark, lambda: [x.collect() for x in N.coupling_network(often, 10)])
    want = sorted(strengths(couples()).items(), key=lambda x: (-x[1], x[0]))[:10]
    top = {p for p, _ in want}
    assert [(r.rec_id, r.strength) for r in sorted(nodes, key=lambda r: (-r.strength, r.rec_id))] == want
    assert {(r.a, r.b): r.weight for r in edges} == {k: n for k, n in couples().items() if top.issuperset(k)}
    assert rows < 20 * 3 * PAPERS


def test_scenarios_without_pairs_of_all(spark, often):
    (nodes, edges), rows = shuffled(spark, lambda: [x.collect() for x in S.coupling_scenarios(often, [5, 10], [2, 3])])
    want = sorted(strengths(couples()).items(), key=lambda x: (-x[1], x[0]))
    assert {(r.grp, r.rec_id, r.n) for r in nodes} == {(g, *x) for g, n in ((0, 5), (2, 10)) for x in want[:n]}  # none share three
    for g, n in ((0, 5), (2, 10)):
        assert {(r.a, r.b): r.weight for r in edges if r.grp == g} == {k: w for k, w in couples().items() if {p for p, _ in want[:n]}.issuperset(k)}
    assert rows < 20 * 3 * PAPERS


NETWORK = {
    "structural_holes": lambda refs: S.structural_holes(*N.coupling_network(refs, 10), "rec_id", "strength"),
    "brokerage_baselines": lambda refs: S.brokerage_baselines(S.structural_holes(*N.coupling_network(refs, 10), "rec_id", "strength")),
    "hole_summary": lambda refs: Y.hole_summary(S.structural_holes(*N.coupling_network(refs, 10), "rec_id", "strength")),
    "stable_brokers": lambda refs: P.stable_brokers(S.brokerage_robustness(refs, [5, 10], [1, 2]), least=0.25),
}


@pytest.mark.parametrize("name", NETWORK)
def test_tables_of_the_network_without_pairs_of_all(spark, often, name):
    found, rows = shuffled(spark, lambda: NETWORK[name](often).collect())
    assert found and rows < 40 * 3 * PAPERS


def test_small_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 9)
    rng = random.Random(5)
    cited = {f"p{p}": {w for w in range(15) if rng.random() < (0.6 if w < 3 else 0.2)} for p in range(60)}
    df = spark.createDataFrame([(p, str(w)) for p in cited for w in cited[p]], "rec_id string, ref string")
    shared = {(a, b): len(cited[a] & cited[b]) for a, b in combinations(sorted(cited), 2)}
    for least, heavy in ((1, 1), (2, 3), (4, 1000)):
        want = {k: n for k, n in shared.items() if n >= least}
        assert {(r.a, r.b): r.weight for r in N.coupling_pairs(df, min_shared=least, heavy=heavy).collect()} == want
    sums = N.coupling_strengths(N.cited_works(df, "ref", "rec_id"), [3, 2], heavy=3).collect()
    for i, least in ((1, 3), (2, 2)):
        assert {r.rec_id: r[i] for r in sums if r[i]} == strengths({k: n for k, n in shared.items() if n >= least})


def test_counts_beyond_a_byte(monkeypatch):
    monkeypatch.setattr(O, "CELLS", 5)
    rows = [range(700), range(300, 1000), range(1), range(299, 700)]
    block = np.cumsum([0, *map(len, rows)]), np.concatenate([np.array(r) for r in rows])
    for heavy in (0, 2, 9):
        got = {(int(i), int(j)): int(n) for x in O.shared_counts(block, block, 1, heavy, True) for i, j, n in zip(*x)}
        assert got == {(0, 1): 400, (0, 2): 1, (0, 3): 401, (1, 3): 400}


def test_top_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    cited = {f"p{p}": {w for w in range(30) if rng.random() < (0.7 if p < 6 else 0.3 if w < 4 else 0.1)} for p in range(150)}
    cited |= {f"q{p}": cited[f"p{p}"] for p in range(0, 150, 7)}  # ties
    df = spark.createDataFrame([(p, str(w)) for p in cited for w in cited[p]], "rec_id string, ref string")
    shared = {(a, b): len(cited[a] & cited[b]) for a, b in combinations(sorted(cited), 2)}
    want = {least: strengths({k: n for k, n in shared.items() if n >= least}) for least in (1, 2, 3)}
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "PARTS", 4)
    base = N.cited_works(df, "ref", "rec_id")
    for bits, wide, block in ((16, 256, 1 << 17), (5, 256, 9), (16, 8, 20), (5, 8, 20)):
        monkeypatch.setattr(N, "BITS", bits)
        monkeypatch.setattr(N, "WIDE", wide)
        monkeypatch.setattr(N, "BLOCK", block)
        for r in N.strength_bounds(N.coupled_papers(base, "ref", "rec_id", 1), "rec_id", [1, 2, 3]).collect():
            assert all(r[f"b{x}"] >= want[least].get(r.rec_id, 0) for x, least in enumerate((1, 2, 3)))
        for leasts in ([1], [3, 2]):
            got = N.coupling_strengths(base, leasts, top_n=5).collect()
            for x, least in enumerate(leasts):
                found, fifth = {r.rec_id: r[f"s{x}"] for r in got}, sorted(want[least].values())[-5]
                assert all(n == want[least].get(p, 0) for p, n in found.items())
                assert {p for p, n in want[least].items() if n >= fifth} <= set(found)


@pytest.fixture(scope="module")
def uneven(spark):
    """A group of 60 papers, groups of four, two works of each group, and a work that all cite."""
    p = spark.range(PAPERS).withColumnRenamed("id", "rec_id").withColumn("g", F.expr("if(rec_id < 60, 0, rec_id div 4)"))
    return p.select("rec_id", F.explode(F.expr("array(2 * g, 2 * g + 1, -1)")).alias("ref")).withColumn("ref", F.col("ref").cast("string"))


def all_against_all(*_):
    raise AssertionError("all papers are compared with all")


@pytest.mark.parametrize("name", ["brokerage_baselines", "stable_brokers", "structural_holes", "hole_summary"])
def test_top_lists_without_all_against_all(spark, uneven, monkeypatch, name):
    want = NETWORK[name](uneven).collect()
    monkeypatch.setattr(N, "FEW", PAPERS - 1, raising=False)
    monkeypatch.setattr(N, "_blocks_against_blocks", all_against_all)
    assert want and sorted(NETWORK[name](uneven).collect(), key=str) == sorted(want, key=str)
