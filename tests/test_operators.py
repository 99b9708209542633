"""Operators over small tables with known results."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import graph as G
from citeloom.operators import bursts as B
from citeloom.operators import citations as C
from citeloom.operators import frequency as Q
from citeloom.operators import networks as N
from citeloom.operators import records as D
from citeloom.operators import structure as S
from citeloom.operators import temporal as T


def long(spark, lists, label="keyword", start=0):
    rows = [(i + start, x) for i, xs in enumerate(lists) for x in xs]
    return spark.createDataFrame(rows, f"rec_id long, {label} string")


def edges_of(df):
    return {(r.a, r.b): r.weight for r in df.collect()}


def test_pair_counts(spark):
    k = long(spark, [["Network", "Citation", "Network"], ["Network", "Data"], ["Citation", "Data"]])
    assert edges_of(N.pair_counts(k, "keyword")) == {("Citation", "Network"): 1, ("Data", "Network"): 1, ("Citation", "Data"): 1}
    assert N.pair_counts(k.limit(0), "keyword").count() == 0


def test_repeated_authors_pair_with_themselves(spark):
    a = long(spark, [["A", "A", "B"]], "author")
    assert edges_of(N.pair_counts(a, "author", distinct=False)) == {("A", "A"): 1, ("A", "B"): 2}


def test_bipartite(spark):
    k = long(spark, [["Network", "Mapping"], ["Network", "Data"], ["Data", "Visualization"]])
    j = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "rec_id long, journal string")
    got = {(r.keyword, r.journal) for r in N.bipartite_links(k, "keyword", j, "journal", 2, 1).collect()}
    assert got == {("Network", "A"), ("Data", "A")}


def test_coupling(spark):
    r = long(spark, [["S", "L"], ["S", "C"], ["W"]], "ref")
    assert edges_of(N.coupling_pairs(r, min_shared=1)) == {(0, 1): 1}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=6), min_size=2, max_size=12), st.integers(1, 3))
def test_coupling_against_brute_force(spark, lists, t):
    if not any(lists):
        return
    want = {(i, j): len(set(x) & set(y)) for (i, x), (j, y) in itertools.combinations(enumerate(lists), 2) if len(set(x) & set(y)) >= t}
    assert edges_of(N.coupling_pairs(long(spark, lists, "ref"), min_shared=t)) == want


def test_disruption(spark):
    p = spark.createDataFrame([(0,), (1,), (2,)], "rec_id long")
    e = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "src long, dst long")
    got = {r.rec_id: (r.nd, r.nc, r.na, r.di) for r in C.disruption(p, e).collect()}
    assert got[0] == (2, 0, 0, 1.0) and got[1] == (0, 1, 0, -1.0) and got[2] == (0, 0, 1, 0.0)


def test_internal_citations(spark):
    p = spark.createDataFrame(
        [(0, "Smith, J", 2020, "Science", None), (1, "Lee, K", 2021, "Nature", "10.1234/b"), (2, "Wang, H", 2022, "Cell", None)], "rec_id long, authors string, year int, journal string, doi string"
    )
    r = spark.createDataFrame([(1, "SMITH J, 2020, SCIENCE"), (2, "SMITH J, 2020, SCIENCE"), (2, "X Y, 1999, Z, DOI 10.1234/B")], "rec_id long, raw string")
    assert {(x.src, x.dst) for x in C.internal_citations(p, r).collect()} == {(1, 0), (2, 0), (2, 1)}


def test_rpys(spark):
    rows = [(0, 2018, "SMITH"), (0, 2019, "LEE"), (1, 2018, "SMITH"), (1, 2020, "WANG"), (2, 2018, "CHEN")]
    r = spark.createDataFrame(rows, "rec_id long, ref_year int, ref string")
    got = [(x.year, x.n, x.median, x.deviation) for x in C.rpys(r).orderBy("year").collect()]
    assert got[0] == (2018, 3, 1.0, 2.0) and [g[1] for g in got] == [3, 1, 1]
    peak = C.rpys_peaks(r).first()
    assert peak.year == 2018 and peak.top_references == "SMITH (2); CHEN (1)"


def test_citation_trend(spark):
    p = spark.createDataFrame([(2020, 10.0), (2020, 6.0), (2021, 12.0), (2022, 3.0), (2022, 9.0)], "year int, times_cited double")
    got = Q.by_year(p).orderBy("year").collect()
    assert [(r.publications, r.avg_citations) for r in got] == [(2, 8.0), (1, 12.0), (2, 6.0)]


def test_lotka(spark):
    a = long(spark, [["Alice", "Bob"], ["Alice", "Carol"], ["Alice"]], "author")
    got = Q.lotka(a).orderBy("papers").collect()
    assert [(r.papers, r.authors) for r in got] == [(1, 2), (2, 0), (3, 1)]


def test_deduplicate(spark):
    rows = [
        (0, "A study of long titles in maps", "Smith, J", 2020, "10.1/a", "short"), (1, "A study of long titles in maps", "Smith, J", 2020, "10.1/A ", "a much longer abstract"),
        (2, "Another very long title for a test", "Lee, K", 2021, None, None), (3, "Another very long title for a tests", "Lee, K", 2021, None, "kept"), (4, None, None, None, None, None), (5, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "rec_id long, title string, authors string, year int, doi string, abstract string")
    out, report = D.deduplicate(df)
    got = {r.rec_id: r for r in out.collect()}
    assert set(got) == {0, 2, 4, 5} and got[0].abstract == "a much longer abstract" and got[2].abstract == "kept"
    assert tuple(report.first()) == (6, 2, 4)


def test_paper_labels(spark):
    df = spark.createDataFrame([(0, "Smith, J", 2020, "x"), (1, "SMITH, J", 2020, "y"), (2, None, 2021, "A title that is much longer than the limit")], "rec_id long, authors string, year int, title string")
    got = {r.rec_id: r.label for r in D.paper_labels(df).collect()}
    assert got == {0: "Smith, 2020a", 1: "Smith, 2020b", 2: "A title that is much l..., 2021"}


def years(spark, start, n, per=1):
    return spark.createDataFrame([(i * per + k, start + i) for i in range(n) for k in range(per)], "rec_id long, year int")


def test_bursts(spark):
    p = years(spark, 2010, 11, 2)
    rows = [(r.rec_id, "Stable") for r in p.collect() if r.rec_id % 2 == 0] + [(r.rec_id, "Outbreak") for r in p.collect() if 2017 <= r.year <= 2019]
    k = spark.createDataFrame(rows, "rec_id long, keyword string")
    top = B.keyword_bursts(k, p).first()
    assert top.label == "Outbreak" and top.start == 2017 and top.duration == top.end - top.start + 1
    generic = spark.createDataFrame([(r.rec_id, "Infection") for r in p.collect()] + rows, "rec_id long, keyword string")
    assert "Infection" not in {r.label for r in B.keyword_bursts(generic, p).collect()}


def brute_burst(x):
    """The cheapest state path by trying all of them."""
    x = np.asarray(x, float)
    mean = x.mean()
    top = 1
    while mean * 2 ** (top + 1) <= 1.5 * x.max():
        top += 1
    best = None
    for path in itertools.product(range(top + 1), repeat=len(x)):
        c, last = 0.0, 0
        for s, v in zip(path, x):
            rate = mean * 2**s
            c += np.log(top + 1) * abs(s - last) + (v * np.log(v / rate) + rate - v if v > 0 else rate)
            last = s
        if best is None or c < best - 1e-9:
            best = c
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=3, max_size=6))
def test_burst_runs_are_cheapest(x):
    if max(x) == 0:
        assert B.burst_runs(np.array(x)) == []
        return
    runs = B.burst_runs(np.array(x))
    assert all(0 <= i <= j < len(x) and s >= 0 for i, j, _, s in runs)
    path, cost = B.burst_states(np.array(x))
    assert len(path) == len(x) and abs(cost - brute_burst(x)) < 1e-9


def test_selected_share(spark):
    p = spark.createDataFrame([(0, 2020), (1, 2020), (2, 2021), (3, 2021)], "rec_id long, year int")
    k = long(spark, [["Network", "Graph"], ["Network"], ["Graph"], ["Network", "Graph"]])
    got = T.selected_share(k, p, ["Network", "Graph", "Network"]).groupBy("year").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.02 for r in got) and len(got) == 2


def test_forecast(spark):
    p = spark.createDataFrame([(i, y) for i, y in enumerate([2020] * 2 + [2021] * 3 + [2022] * 4 + [2023] * 5)], "rec_id long, year int")
    got = T.publication_forecast(p).orderBy("year").collect()
    assert [(r.year, r.publications) for r in got if r.series == "Forecast"] == [(2024, 6.0), (2025, 7.0), (2026, 8.0), (2027, 9.0)]
    assert T.publication_forecast(p.filter("year < 2022")).count() == 0


def test_leadership_and_opportunities(spark):
    p = years(spark, 2018, 5, 4)
    rows = [(r.rec_id, "China") for r in p.collect() if r.year >= 2021 or r.rec_id % 4 == 0] + [(r.rec_id, "Japan") for r in p.collect() if r.year < 2021]
    c = spark.createDataFrame(rows, "rec_id long, country string")
    got = {r.country: r for r in T.leadership_shift(c, p, "country").collect()}
    assert got["China"].share_shift > 0 > got["Japan"].share_shift
    k = c.withColumnRenamed("country", "keyword")
    assert {r.signal for r in T.opportunity_map(k, p).collect()} <= {"Core Hotspots", "Emerging Signals", "Mature but Cooling", "Niche / Weakening"}


@pytest.mark.parametrize("n,k", [(5, 2), (7, 3), (10, 4), (3, 8)])
def test_year_slices_match_array_split(spark, n, k):
    want = [list(x) for x in np.array_split(np.arange(2000, 2000 + n), max(1, min(max(2, k), n)))]
    got = {}
    for r in T.year_slices(years(spark, 2000, n), k).collect():
        got.setdefault(r.slice, []).append(r.year)
    assert [sorted(got[s]) for s in sorted(got)] == want


def test_graph_measures():
    tri = np.ones((3, 3)) - np.eye(3)
    assert np.allclose(G.clustering_coefficients(tri), 1) and np.allclose(G.betweenness(tri), 0)
    path = G.matrix_of("ABC", [("A", "B", 1), ("B", "C", 1)])
    assert np.allclose(G.betweenness(path), [0, 1, 0])
    assert np.allclose(G.effective_size(path), [1, 2, 1])
    assert np.allclose(G.constraint(path), [1, 0.5, 1])
    two = np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))
    two[0, 4] = two[4, 0] = 0.1
    for find in (G.louvain, G.greedy_modularity):
        assert list(find(two)) == [0] * 4 + [1] * 4
    assert G.modularity(two, np.array([0] * 4 + [1] * 4)) > 0.45


def test_structural_holes_sorted_roles(spark):
    n = spark.createDataFrame([(x, 1.0) for x in "ABCD"], "node string, n double")
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("B", "D", 1.0)], "a string, b string, weight double")
    got = {r.node: r for r in S.structural_holes(n, e, "node").collect()}
    assert got["B"].brokerage_score == max(r.brokerage_score for r in got.values()) and got["B"].brokerage_role == "core_broker"
    empty = S.structural_holes(n.limit(0), e.limit(0), "node")
    assert empty.collect() == []


def test_robustness(spark):
    r = long(spark, [["S", "L", "C"], ["S", "L"], ["S", "C"], ["L", "C"]], "ref")
    got = S.brokerage_robustness(r, [3, 4], [1, 2], (4, 1), 3).collect()
    assert len(got) == 4 and {x.overlap for x in got if (x.top_n, x.min_shared) == (4, 1)} == {1.0}


def test_theme_chains(spark):
    p = years(spark, 2020, 4, 4)
    k = spark.createDataFrame([(r.rec_id, w) for r in p.collect() for w in (["A", "B"] if r.rec_id % 2 else ["C", "D"])], "rec_id long, keyword string")
    topics = S.period_topics(k, p)
    summary, members = S.theme_chains(topics)
    assert {r.label for r in topics.collect()} == {"A / B", "C / D"}
    assert summary.count() == 2 and members.count() == 8


def test_clustering_against_numpy(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.4]
    e = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", 1) for i, j in pairs], "a string, b string, weight long")
    want = G.clustering_coefficients(G.matrix_of(range(12), [(i, j, 1) for i, j in pairs]))
    for r in N.clustering(e).collect():
        assert abs(r.coefficient - want[int(r.node[1:])]) < 1e-4


def test_empty_tables(spark):
    p = spark.createDataFrame([], "rec_id long, year int, journal string, times_cited double, doi string, abstract string")
    k = spark.createDataFrame([], "rec_id long, keyword string")
    for df in (Q.by_year(p), Q.annual_growth(p), N.pair_counts(k, "keyword"), T.keyword_growth(k, p), T.publication_forecast(p), B.keyword_bursts(k, p), S.thematic_map(k), S.cluster_heatmap(k)):
        assert df.collect() == []


def test_category_fallback(spark):
    df = spark.createDataFrame([(None, "A; B"), ("nan", "A")], "first string, second string")
    assert {(r.category, r.n) for r in Q.fallback_frequency(df, "first", "second").collect()} == {("A", 2), ("B", 1)}
    both = spark.createDataFrame([("X", "A")], "first string, second string")
    assert {r.category for r in Q.fallback_frequency(both, "first", "second").collect()} == {"X"}


def test_coverage_and_window(spark):
    df = spark.createDataFrame([("a", 2000), ("NaN", 2005), (None, 2010)], "t string, year int")
    assert [(r.field, r.filled, r.coverage) for r in D.coverage(df, ["t"]).collect()] == [("t", 1, 0.3333)]
    assert [r.year for r in D.year_window(df, 2003, 2050).collect()] == [2005, 2010]
    assert D.year_window(df, 2008, 2003).count() == 0


def test_topic_terms_and_extremes(spark):
    di = spark.createDataFrame([(1, 0.5, 3, 1, 0, "Deep Maps"), (2, -0.25, 0, 0, 0, "x"), (3, 0.0, 5, 0, 2, "maps")], "rec_id long, di double, support long, citers long, references long, title string")
    assert {r.rec_id for r in C.topic_match(di, ["MAPS"], ["title"]).collect()} == {1, 3}
    assert [r.rec_id for r in C.disruption_extremes(di, min_support=3).collect()] == [1, 3]
    assert [r.rec_id for r in C.disruption_extremes(di, min_support=3, min_references=1, mode="all").collect()] == [3]
    assert tuple(C.disruption_summary(di).first()) == (3, 0.0833, 1, 1, 1)
