"""Network maps, label rules, parsers and numbering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import keywords as K
from citeloom.functions import text as X
from citeloom.functions.graph import spread_points
from citeloom.operators import maps as Y
from citeloom.operators.frequency import bradford_core, funding_frequency
from citeloom.operators.records import label_suffix, numbered, paper_labels
from citeloom.sources.files import ProjectSession, mapping_rows, rows_mapping, sniff_encoding, spark_encoding


def net(spark):
    nodes = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 2), ("e", 1)], "k string, n long")
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "d", 1)], "a string, b string, weight long")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "k string, cluster string")
    return nodes, edges, groups


def test_maps(spark):
    nodes, edges, groups = net(spark)
    assert {(r.a, r.b): r.weight for r in Y.cluster_graph(edges, groups, "k").collect()} == {("x", "y"): 2, ("y", "z"): 1}
    rows = Y.circular_map(nodes, edges, groups, "k", 4).orderBy("place").collect()
    assert [r.k for r in rows] == ["a", "b", "c", "d"] and (rows[0].x, rows[0].y) == (1.0, 0.0) and (rows[1].x, rows[1].y) == (0.0, 1.0)
    assert {r.k for r in Y.circular_map(nodes, edges, groups, "k", 3).collect()} == {"a", "b", "c"}
    assert {r.k for r in Y.visible_labels(nodes, edges, groups, "k", 3, 1).collect()} == {"a", "c", "d"}
    got = {r.node: r for r in Y.bridge_scores(nodes, edges, "k").collect()}
    assert got["b"].betweenness > got["a"].betweenness == 0 and len(got) == 5
    assert Y.network_positions(nodes, edges, "k").count() == 5
    none = nodes.limit(0), edges.limit(0), groups.limit(0)
    assert Y.circular_map(*none, "k").count() == 0 and Y.visible_labels(*none, "k").count() == 0 and Y.cluster_graph(*none[1:], "k").count() == 0


def test_hole_summary(spark):
    holes = spark.createDataFrame([("p", 0.7, "core_broker"), ("q", 0.7, "core_broker"), ("r", 0.5, "bridge_candidate"), ("s", None, "embedded_node")], "node string, brokerage_score double, brokerage_role string")
    assert tuple(Y.hole_summary(holes).first()) == (4, 0.475, "p", 0.7, 2, 3)
    assert tuple(Y.hole_summary(holes.limit(0)).first()) == (0, 0.0, "", 0.0, 0, 0)


def test_spread_points():
    xy = spread_points(np.array([[0.0, 0.0], [0.0, 0.0], [0.05, 0.0], [3.0, 3.0]]))
    dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)) + 9 * np.eye(4)
    assert dist.min() > 0.2 and spread_points(np.zeros((0, 2))).shape == (0, 2)


def test_label_suffixes(spark):
    got = [r.s for r in spark.range(0, 20_000).orderBy("id").select(label_suffix(F.col("id")).alias("s")).collect()]

    def plain(n):
        out = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out

    assert got == [plain(i) for i in range(20_000)]
    same = spark.range(1, 1001).selectExpr("id AS rec_id", "'Smith, J.; Lee, K.' AS authors", "2020 AS year", "'t' AS title")
    labels = {r.rec_id: r.label for r in paper_labels(same).collect()}
    assert labels[1] == "Smith, 2020a" and labels[703] == "Smith, 2020aaa" and len(set(labels.values())) == 1000


def test_numbering_of_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('g', id % 7) ELSE 'hot' END AS g")
    got = {}
    for r in numbered(df, "g", "id").collect():
        got.setdefault(r.g, []).append((r._pos, r.id, r._n))
    for rows in got.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and [i for _, i, _ in rows] == sorted(i for _, i, _ in rows) and {n for _, _, n in rows} == {len(rows)}
    assert numbered(df.limit(0), "g", "id").count() == 0
    core = bradford_core(spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 15)], "journal string, n long"))
    assert [(r.rank, r.journal, r.cumulative) for r in core.collect()] == [(1, "e", 15)]


def test_rule_texts(spark):
    assert X.rule_entries("a; b\n\n c ;;") == ["a", "b", "c"] and X.rule_entries(None) == []
    assert X.alias_rules("ml => Machine learning; x; => y; a=>b=>c") == [("ml", "Machine learning"), ("a", "b=>c")]
    blocked, aliases = K.rule_tables(spark, "noise term; other", "ml => machine learning\nml => deep learning")
    terms = spark.createDataFrame([(1, 0, "ML"), (1, 1, "Noise Term"), (1, 2, "deep-learning"), (2, 0, None), (2, 1, "x1")], "rec_id long, pos int, term string")
    assert {(r.rec_id, r.pos, r.term) for r in K.governed(terms, "rec_id", blocked, aliases).collect()} == {(1, 0, "Deep Learning"), (2, 1, "X1")}
    got = K.selected_keywords(spark, "citation analysis, Mapping;mapping\nh-index").orderBy("pos").collect()
    assert [r.keyword for r in got] == ["Citation Analysis", "Mapping", "H Index"] and K.selected_keywords(spark, None).count() == 0


@pytest.mark.parametrize(("text", "want"), [("Smith, 2020 [J Inf] [2]", "Smith, 2020"), ("Smith, 2020 (2)", "Smith, 2020"), ("Smith (Jr), N/A (b)", "Smith (Jr), N/A"), ("Plain", "Plain"), (None, None)])
def test_old_suffixes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.without_old_suffixes(F.col("t")).alias("t")).first().t == want


def test_small_texts(spark):
    df = spark.createDataFrame([(None, "x" * 60, "A; B;A"), (" nan ", "short", None)], "a string, b string, funding string")
    rows = df.select(X.safe_text(F.col("a")).alias("a"), X.cut_label(F.col("b")).alias("b")).collect()
    assert [r.a for r in rows] == ["Unknown", "Unknown"] and [len(r.b) for r in rows] == [48, 5] and rows[0].b.endswith("...")
    assert {r.funding: r.n for r in funding_frequency(df).collect()} == {"A": 2, "B": 1}


def test_pattern_terms(spark):
    df = spark.createDataFrame([(1, "A SURVEY of maps", None), (2, None, "open data"), (3, None, None)], "i long, title string, abstract string")
    got = {(r.i, r.term) for r in K.pattern_terms(df, "i", {"S": r"\bsurvey", "O": "open (?:data|access)"}).collect()}
    assert got == {(1, "S"), (2, "O")} and K.pattern_terms(df, "i", {}).count() == 0


def test_session_and_mappings(spark):
    m = {("a", "b"): 1, "c": 2}
    assert rows_mapping(mapping_rows(m)) == m
    s = ProjectSession()
    s.stash({"t": spark.range(2)}, {"k": 5})
    assert not s.active and s.parameters == {}
    s.apply()
    assert s.active and s.parameters == {"k": 5} and s.tables["t"].count() == 2
    s.clear()
    assert not s.active and s.tables == {} and s.parameters == {"k": 5}


@pytest.mark.parametrize("enc", ["utf-8", "gb18030", "cp1252"])
def test_encodings_by_lines(spark, tmp_path, enc):
    text = {"utf-8": "Zürich naïve 中文", "gb18030": "引文分析研究方法", "cp1252": "Zürich naïve – déjà"}[enc]
    path = tmp_path / "f.txt"
    path.write_bytes(("plain\n" * 1000 + text + "\r\nlast").encode(enc))
    assert spark_encoding(spark, str(path)) == sniff_encoding(str(path)) == enc
