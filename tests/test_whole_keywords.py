"""Keyword queries count both keyword fields."""

from collections import Counter
from itertools import combinations

import pytest

from citeloom.plans import catalog

ROWS = [
    (1, "Alpha Map; Beta Graph", "ALPHA MAP; DELTA", "t", None), (2, "alpha map | beta graph | Gamma Tree", None, "t", None), (3, '"Alpha Map"; "Beta Graph"', "", "t", None),
    (4, None, "DELTA; ALPHA MAP", "t", None), (5, None, "nan", "Ribosome ribosome ribosome", "ribosome"), (6, "Beta Graph; Gamma Tree", None, "t", None),
]
OWN = {1: {"Alpha Map", "Beta Graph", "Delta"}, 2: {"Alpha Map", "Beta Graph", "Gamma Tree"}, 3: {"Alpha Map", "Beta Graph"}, 4: {"Delta", "Alpha Map"}, 6: {"Beta Graph", "Gamma Tree"}}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("papers"))
    p = spark.createDataFrame(ROWS, "paper_id long, author_keywords string, keywords_plus string, title string, abstract string")
    p.selectExpr(
        "*", "'2020' AS pub_year", "'J' AS journal", "'Article' AS doc_type", "'English' AS lang", "'1' AS times_cited", "'' AS doi", "'A, B' AS authors", "'' AS affiliations"
    ).write.parquet(f"{d}/papers.parquet")
    return d


def test_frequencies_and_pairs(spark, data):
    got = {r.keyword: r.n for r in catalog.queries()["keyword_frequency_all"](spark, data).collect()}
    want = Counter(w for words in OWN.values() for w in words)
    assert {w: got.get(w) for w in want} == dict(want)
    assert "Ribosome" in got  # no keywords at all: terms of title and abstract
    pairs = Counter(x for words in OWN.values() for x in combinations(sorted(words), 2))
    got = {(r.a, r.b): r.weight for r in catalog.queries()["cooccurrence_pairs_all"](spark, data).collect()}
    assert got == {x: n for x, n in pairs.items() if n >= 2}


def test_queries_without_sql(spark, data):
    nodes = {r.node for r in catalog.queries()["louvain_clusters"](spark, data).collect()}
    assert {"Beta Graph", "Gamma Tree", "Alpha Map"} <= nodes  # the first two are author keywords only
