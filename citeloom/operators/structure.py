"""Communities, brokerage, themes and heatmaps on bounded networks.

The networks are cut to a top N in Spark. Each is then one group of an Arrow function; several
networks (slices, scenarios) are groups that run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import graph as G
from citeloom.functions import lookups as L
from citeloom.operators.frequency import frequency, top_k
from citeloom.operators.networks import cited_works, coupling_strengths, pair_counts, within
from citeloom.operators.temporal import dated, year_slices
from citeloom.session import materialize


def as_graphs(nodes: DataFrame, edges: DataFrame, label: str, weight: str = "n", group: Column | None = None) -> DataFrame:
    """Rows (grp, kind, a, b, w) of nodes and edges, the input of ``on_graph``."""
    g = (F.lit(0) if group is None else group).cast("int").alias("grp")
    ng = g if group is None or "grp" not in nodes.columns else F.col("grp").cast("int").alias("grp")
    n = nodes.select(ng, F.lit("n").alias("kind"), F.col(label).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col(weight).cast("double").alias("w"))
    eg = g if group is None or "grp" not in edges.columns else F.col("grp").cast("int").alias("grp")
    return n.unionByName(edges.select(eg, F.lit("e").alias("kind"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("weight").cast("double").alias("w")))


def on_graph(graphs: DataFrame, run: Callable[[int, list[str], np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``run(grp, labels, weights, node_weights)`` to each network."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, e = pdf[pdf.kind == "n"], pdf[pdf.kind == "e"]
        weights = dict(zip(n.a, n.w))
        labels = sorted(weights)
        m = G.matrix_of(labels, list(zip(e.a, e.b, e.w)))
        return run(int(pdf.grp.iloc[0]), labels, m, np.array([weights[x] for x in labels]))

    return graphs.groupBy("grp").applyInPandas(one, schema)


def communities(nodes: DataFrame, edges: DataFrame, label: str, method: str = "louvain", weight: str = "n") -> DataFrame:
    """(node, cluster) by ``louvain`` or ``greedy`` modularity."""
    find = G.louvain if method == "louvain" else G.greedy_modularity
    return on_graph(as_graphs(nodes, edges, label, weight), lambda g, names, m, w: pd.DataFrame({"node": names, "cluster": find(m).astype("int32")}), "node string, cluster int")


def network_metrics(nodes: DataFrame, edges: DataFrame, label: str, weight: str = "n") -> DataFrame:
    """(nodes, edges, density, avg_degree, modularity, clusters, avg_clustering)."""

    def run(_g: int, names: list[str], m: np.ndarray, _w: np.ndarray) -> pd.DataFrame:
        n, links = len(names), int((np.triu(m, 1) > 0).sum())
        member = G.louvain(m)
        row = (
            n, links, round(2 * links / (n * (n - 1)), 4) if n > 1 else 0.0, round(2 * links / n, 2) if n else 0.0,
            round(G.modularity(m, member), 4), int(member.max() + 1) if n else 0, round(float(G.clustering_coefficients(m).mean()), 4) if n else 0.0,
        )
        return pd.DataFrame([row], columns=["nodes", "edges", "density", "avg_degree", "modularity", "clusters", "avg_clustering"])

    return on_graph(as_graphs(nodes, edges, label, weight), run, "nodes long, edges long, density double, avg_degree double, modularity double, clusters int, avg_clustering double")


HOLES = "node string, degree int, weighted_degree double, betweenness double, structural_constraint double, effective_size double, brokerage_score double, brokerage_role string"


def _spread(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.round((x - lo) / (hi - lo), 4) if hi > lo else np.full(len(x), 1.0 if hi > 0 else 0.0)


def holes_frame(names: list[str], m: np.ndarray) -> pd.DataFrame:
    """Brokerage of each node from betweenness, effective size and constraint."""
    if not names:
        return pd.DataFrame(columns=[c.split()[0] for c in HOLES.split(", ")])
    b, e = G.betweenness(m), G.effective_size(m)
    c = np.clip(np.nan_to_num(G.constraint(m), nan=1.0), 0, 1)
    score = np.round(0.45 * _spread(b) + 0.35 * _spread(e) + 0.20 * np.round(1 - c, 4), 4)
    role = np.where(score >= 0.65, "core_broker", np.where(score >= 0.4, "bridge_candidate", "embedded_node"))
    return pd.DataFrame(
        {
            "node": names, "degree": (m > 0).sum(axis=1).astype("int32"), "weighted_degree": np.round(m.sum(axis=1), 4), "betweenness": np.round(b, 4),
            "structural_constraint": np.round(c, 4), "effective_size": np.round(e, 4), "brokerage_score": score, "brokerage_role": role,
        }
    )


def structural_holes(nodes: DataFrame, edges: DataFrame, label: str, weight: str = "n") -> DataFrame:
    return on_graph(as_graphs(nodes, edges, label, weight), lambda g, names, m, w: holes_frame(names, m), HOLES)


def coupling_scenarios(refs: DataFrame, top_ns: list[int], min_shareds: list[int], label: str = "ref", key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with grp for every combination of network size and least shared references.

    Shared counts are taken once and summed up for every least number; pairs are formed among the
    nodes of the scenarios only.
    """
    base = cited_works(refs, label, key)
    grid = [(i * len(min_shareds) + j, n, s) for i, n in enumerate(top_ns) for j, s in enumerate(min_shareds)]
    place = {s: f"s{x}" for x, s in enumerate(min_shareds)}
    cases = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).alias("top_n"), F.col(place[s]).alias("strength")) for g, n, s in grid]))
    strength = coupling_strengths(base, min_shareds, label, key, top_n=max(top_ns)).select(key, cases.alias("c")).select("c.*", key).filter("strength > 0")
    # the k best per scenario: one bounded sort per scenario and partition, then a small merge
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), F.col(key).alias("k")))), F.lit(1), F.max("top_n"))
    part = strength.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64))).groupBy("grp", "top_n", "_salt").agg(best.alias("x"))
    nodes = part.select("grp", "top_n", F.explode("x").alias("e")).groupBy("grp", "top_n").agg(F.slice(F.array_sort(F.collect_list("e")), F.lit(1), F.max("top_n")).alias("x"))
    nodes = materialize(nodes.select("grp", F.explode("x").alias("e")).select("grp", F.col("e.k").alias(key), (-F.col("e.s")).alias("n")), "nodes")
    inner = base.join(F.broadcast(nodes.select(key).distinct()), key, "left_semi")  # the nodes of a few scenarios
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(s).alias("min_shared")) for g, _, s in grid]))
    wide = pair_counts(inner, key, label, min_weight=min(min_shareds)).withColumn("c", each).select("c.*", "a", "b", "weight").filter("weight >= min_shared")
    ends = F.broadcast(nodes.select(F.col("grp").alias("_g"), F.col(key).alias("_k")))
    kept = wide.join(ends, (F.col("grp") == F.col("_g")) & (F.col("a") == F.col("_k")), "left_semi").join(ends, (F.col("grp") == F.col("_g")) & (F.col("b") == F.col("_k")), "left_semi")
    return nodes, kept.select("grp", "a", "b", "weight")


def brokerage_robustness(refs: DataFrame, top_ns: list[int], min_shareds: list[int], reference: tuple[int, int] | None = None, top_k_brokers: int = 5, label: str = "ref", key: str = "rec_id") -> DataFrame:
    """(top_n, min_shared, nodes, edges, brokers, overlap): brokers of each scenario against the reference's."""
    nodes, edges = coupling_scenarios(refs, top_ns, min_shareds, label, key)

    def run(g: int, names: list[str], m: np.ndarray, _w: np.ndarray) -> pd.DataFrame:
        f = holes_frame(names, m).sort_values(["brokerage_score", "betweenness", "weighted_degree", "node"], ascending=[False, False, False, True])
        top = list(f.node.head(top_k_brokers))
        return pd.DataFrame([(g, len(names), int((np.triu(m, 1) > 0).sum()), top)], columns=["grp", "nodes", "edges", "brokers"])

    found = on_graph(as_graphs(nodes, edges, key, "n", F.col("grp")), run, "grp int, nodes long, edges long, brokers array<string>")
    ref = reference or (top_ns[0], min_shareds[0])
    at = top_ns.index(ref[0]) * len(min_shareds) + min_shareds.index(ref[1])
    base = found.filter(F.col("grp") == at).select("brokers").scalar()
    size = F.greatest(F.size(base), F.lit(1))
    names = F.create_map(*[F.lit(x) for i, n in enumerate(top_ns) for j, s in enumerate(min_shareds) for x in (i * len(min_shareds) + j, f"{n}|{s}")])
    case = F.split(F.try_element_at(names, F.col("grp")), r"\|")
    return found.select(
        case[0].cast("int").alias("top_n"), case[1].cast("int").alias("min_shared"), "nodes", "edges", F.array_join("brokers", "; ").alias("brokers"),
        F.round(F.size(F.array_intersect("brokers", base)) / size, 4).alias("overlap"),
    )


def brokerage_baselines(holes: DataFrame, top_k_brokers: int = 10) -> DataFrame:
    """(baseline, overlap, overlap_share, mean_rank_shift): brokerage ranks against three single measures.

    ``holes`` is one bounded network, so the rank windows run over its nodes only.
    """
    r = holes
    for name, col in (("own", "brokerage_score"), ("betweenness_rank", "betweenness"), ("degree_rank", "weighted_degree"), ("size_rank", "effective_size")):
        r = r.withColumn(name, F.row_number().over(W.orderBy(F.desc(col), F.asc("node"))))
    top = r.filter(F.col("own") <= top_k_brokers)
    cases = F.explode(F.array(*[F.struct(F.lit(c).alias("baseline"), F.col(k).alias("rank")) for c, k in (("betweenness", "betweenness_rank"), ("weighted_degree", "degree_rank"), ("effective_size", "size_rank"))]))
    long = top.select("own", cases.alias("x")).select("own", "x.*")
    return long.groupBy("baseline").agg(
        F.count_if(F.col("rank") <= top_k_brokers).alias("overlap"), F.round(F.count_if(F.col("rank") <= top_k_brokers) / F.count(F.lit(1)), 4).alias("overlap_share"),
        F.round(F.avg(F.abs(F.col("rank") - F.col("own"))), 4).alias("mean_rank_shift"),
    )


def thematic_map(keywords: DataFrame, top_n: int = 20, min_weight: int = 2, label: str = "keyword") -> DataFrame:
    """(theme, size, frequency, centrality, density, keywords, quadrant) of keyword communities."""
    nodes = top_k(frequency(keywords, label), label, top_n)
    edges = pair_counts(keywords.join(F.broadcast(nodes.select(label)), label, "left_semi"), label, min_weight=min_weight)  # pairs of the top list only

    def run(_g: int, names: list[str], m: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        cols = ["theme", "size", "frequency", "centrality", "density", "keywords", "quadrant"]
        if len(names) < 4 or m.sum() == 0:
            return pd.DataFrame(columns=cols)
        member = G.louvain(m)
        rows = []
        for c in range(member.max() + 1):
            own = np.nonzero(member == c)[0]
            if len(own) < 2:
                continue
            inside = np.triu(m[np.ix_(own, own)], 1).sum()
            outside = m[own].sum() - m[np.ix_(own, own)].sum()
            first = min(own, key=lambda i: (-w[i], names[i]))
            rows.append([names[first], len(own), int(w[own].sum()), max(10 * outside / len(own), 0.05), max(100 * inside / len(own), 0.1), ", ".join(names[i] for i in own)])
        if len(rows) < 2:
            return pd.DataFrame(columns=cols)
        f = pd.DataFrame(rows, columns=cols[:-1])
        far, tight = f.centrality >= f.centrality.median(), f.density >= f.density.median()
        f["quadrant"] = np.select([far & tight, far, tight], ["Motor themes", "Basic themes", "Niche themes"], "Emerging or declining themes")
        return f.round({"centrality": 4, "density": 4})

    return on_graph(as_graphs(nodes, edges, label), run, "theme string, size int, frequency long, centrality double, density double, keywords string, quadrant string")


def cluster_heatmap(keywords: DataFrame, top_n: int = 16, exclude: list[str] | None = None, label: str = "keyword") -> DataFrame:
    """(i, row, j, col, n): co-occurrence of top keywords in the leaf order of their clustering."""
    drop = L.HEATMAP_GENERIC if exclude is None else exclude
    freq = frequency(keywords, label).filter(~F.lower(label).isin(drop)) if drop else frequency(keywords, label)
    nodes = top_k(freq, label, top_n)
    edges = pair_counts(keywords.join(F.broadcast(nodes.select(label)), label, "left_semi"), label)

    def run(_g: int, names: list[str], m: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        start = sorted(range(len(names)), key=lambda i: (-w[i], names[i]))
        p = m[np.ix_(start, start)]
        order = G.average_linkage_order(p) if len(start) >= 3 else list(range(len(start)))
        rows = [(i, names[start[x]], j, names[start[y]], int(p[x, y])) for i, x in enumerate(order) for j, y in enumerate(order)]
        return pd.DataFrame(rows, columns=["i", "row", "j", "col", "n"])

    return on_graph(as_graphs(nodes, edges, label), run, "i int, row string, j int, col string, n long")


TOPICS = "period int, topic int, weight long, label string, keywords array<string>, counts array<long>"


def period_topics(keywords: DataFrame, papers: DataFrame, slices: int = 4, top_n: int = 30, max_topics: int = 5, label_size: int = 3, label: str = "keyword") -> DataFrame:
    """(period, topic, weight, label, keywords, counts): keyword communities of each slice of years."""
    top = F.broadcast(top_k(frequency(keywords, label), label, top_n).select(label))
    parts = F.broadcast(year_slices(papers, slices))
    base = dated(keywords.join(top, label, "left_semi"), papers).join(parts, "year").select("rec_id", label, F.col("slice").alias("grp")).distinct()
    nodes = base.groupBy("grp", label).agg(F.count(F.lit(1)).alias("n"))
    items = base.groupBy("grp", "rec_id").agg(F.array_sort(F.collect_list(label)).alias("x")).filter(F.size("x") > 1)
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    edges = items.select("grp", F.explode(pairs).alias("p")).groupBy("grp", "p.a", "p.b").agg(F.count(F.lit(1)).alias("weight"))

    def run(g: int, names: list[str], m: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        member = G.greedy_modularity(m)
        found = []
        for c in range(member.max() + 1):
            own = sorted(np.nonzero(member == c)[0], key=lambda i: (-w[i], names[i]))
            found.append((int(w[own].sum()), [names[i] for i in own], [int(w[i]) for i in own]))
        found.sort(key=lambda t: (-t[0], sorted(t[1][:label_size])))
        rows = [(g, k, x, " / ".join(ks[:label_size]), ks, cs) for k, (x, ks, cs) in enumerate(found[:max_topics])]
        return pd.DataFrame(rows, columns=["period", "topic", "weight", "label", "keywords", "counts"])

    return on_graph(as_graphs(nodes, edges, label, "n", F.col("grp")), run, TOPICS)


def theme_flow(topics: DataFrame) -> DataFrame:
    """(period, topic, next_topic, weight): shared keyword weight between topics of adjacent periods."""
    x = topics.select("period", "topic", F.explode(F.arrays_zip("keywords", "counts")).alias("k")).select("period", "topic", F.col("k.keywords").alias("kw"), F.col("k.counts").alias("c"))
    nxt = x.select((F.col("period") - 1).alias("period"), F.col("topic").alias("next_topic"), "kw", F.col("c").alias("c2"))
    return x.join(nxt, ["period", "kw"]).groupBy("period", "topic", "next_topic").agg(F.sum(F.least("c", "c2")).alias("weight")).filter("weight > 0")


def theme_chains(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, members): topics linked to their best parent, with growth, trend and signal.

    There are at most slices x topics rows, so the chains are followed in one Arrow group.
    """
    flow = theme_flow(topics).select(F.lit(1).alias("kind"), "period", "topic", "next_topic", "weight", F.lit(None).cast("string").alias("label"))
    rows = topics.select(F.lit(0).alias("kind"), "period", "topic", F.lit(None).cast("int").alias("next_topic"), "weight", "label").unionByName(flow)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.kind == 0].sort_values(["period", "topic"])
        parent: dict[tuple[int, int], tuple[int, float]] = {}
        for r in pdf[pdf.kind == 1].sort_values(["period", "topic", "next_topic"]).itertuples():
            key = (r.period + 1, int(r.next_topic))
            if key not in parent or r.weight > parent[key][1]:
                parent[key] = (int(r.topic), r.weight)
        chain: dict[tuple[int, int], int] = {}
        for r in nodes.itertuples():
            own = (int(r.period), int(r.topic))
            above = parent.get(own)
            chain[own] = chain.get((own[0] - 1, above[0]), 0) if above else 0
            if not chain[own]:
                chain[own] = max(chain.values()) + 1
        return pd.DataFrame([(chain[int(r.period), int(r.topic)], int(r.period), int(r.topic), int(r.weight), r.label) for r in nodes.itertuples()], columns=["chain", "period", "topic", "weight", "label"])

    members = rows.withColumn("grp", F.lit(0)).groupBy("grp").applyInPandas(follow, "chain int, period int, topic int, weight long, label string")
    order = F.array_sort(F.collect_list(F.struct("period", "topic", "weight", "label")))
    s = members.groupBy("chain").agg(order.alias("x"), F.count(F.lit(1)).alias("slices"), F.coalesce(F.regr_slope("weight", "period"), F.lit(0.0)).alias("slope"))
    last, prev = F.element_at("x", -1), F.try_element_at("x", F.lit(-2))
    growth = F.when(F.col("slices") >= 2, (last["weight"] - prev["weight"]) * 100 / F.greatest(prev["weight"].cast("double"), F.lit(1.0))).otherwise(0.0)
    signal = F.when((F.col("slices") <= 2) & (growth > 0), "Emerging Theme").when(growth >= 15, "Rising Hotspot").when(growth < -10, "Cooling Theme").otherwise("Stable Core")
    summary = s.select(
        "chain", last["label"].alias("theme"), last["period"].alias("latest_period"), last["weight"].alias("latest_weight"),
        F.round(F.greatest(F.lit(0.0), last["weight"] + F.col("slope")), 2).alias("projected_next"), F.round(growth, 2).alias("growth"), F.round("slope", 3).alias("trend_slope"), "slices", signal.alias("signal"),
    )
    return summary, members


def network_export(nodes: DataFrame, edges: DataFrame, label: str, weight: str = "n") -> DataFrame:
    """(id, label, x, y, cluster, weight, links, total_link_strength): the map table of a network."""

    def run(_g: int, names: list[str], m: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        f = pd.DataFrame({"label": names, "cluster": G.louvain(m).astype("int32") + 1, "weight": w, "links": (m > 0).sum(axis=1), "total_link_strength": m.sum(axis=1)})
        f[["x", "y"]] = np.round(G.spring_layout(m), 4)
        f = f.sort_values(["cluster", "weight", "label"], ascending=[True, False, True])
        f.insert(0, "id", range(1, len(f) + 1))
        return f[["id", "label", "x", "y", "cluster", "weight", "links", "total_link_strength"]]

    return on_graph(as_graphs(nodes, edges, label, weight), run, "id int, label string, x double, y double, cluster int, weight double, links long, total_link_strength double")


