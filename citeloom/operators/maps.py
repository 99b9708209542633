"""Network maps as tables: circles, clusters of clusters, visible labels, bridge scores.

All work on networks that were cut to a top list before; nodes are (label, n), edges (a, b,
weight), groups (label, cluster).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import graph as G
from citeloom.operators.networks import within
from citeloom.operators.structure import as_graphs, on_graph


def strengths(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``nodes`` with strength, the sum of their edge weights, and degree; 0 for isolated ones."""
    ends = edges.select(F.explode(F.array("a", "b")).alias(label), "weight").groupBy(label).agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, label, "left").fillna(0, ["strength", "degree"])


def top_subgraph(nodes: DataFrame, edges: DataFrame, label: str, top_n: int) -> tuple[DataFrame, DataFrame]:
    """The ``top_n`` heaviest nodes that are linked among themselves, and their edges."""
    top = nodes.orderBy(F.desc("n"), F.asc(label)).limit(max(top_n, 1))
    inner = within(edges, top, label)
    linked = inner.select(F.explode(F.array("a", "b")).alias(label)).distinct()
    return top.join(F.broadcast(linked), label, "left_semi"), inner  # at most top_n rows


def cluster_graph(edges: DataFrame, groups: DataFrame, label: str, cluster: str = "cluster") -> DataFrame:
    """(a, b, weight): summed weights of the edges between two clusters; edges within one or with
    an end in none are left out."""
    ga, gb = groups.select(F.col(label).alias("a"), F.col(cluster).alias("ca")), groups.select(F.col(label).alias("b"), F.col(cluster).alias("cb"))
    named = edges.join(ga, "a").join(gb, "b").filter("ca <> cb")
    return named.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def circular_map(nodes: DataFrame, edges: DataFrame, groups: DataFrame, label: str, top_n: int = 24, cluster: str = "cluster") -> DataFrame:
    """(label, cluster, n, place, x, y): linked top nodes around a circle, cluster by cluster, the
    heaviest first. Nodes without a cluster have a null one and stand at the end."""
    kept, _ = top_subgraph(nodes, edges, label, top_n)
    named = kept.join(groups.select(label, cluster), label, "left")
    w = W.orderBy(F.asc_nulls_last(cluster), F.desc("n"), F.asc(label))  # at most top_n rows
    total = F.count(F.lit(1)).over(W.partitionBy())
    angle = 2 * np.pi * F.col("place") / F.col("_k")
    placed = named.withColumn("place", F.row_number().over(w) - 1).withColumn("_k", total)
    return placed.select(label, cluster, "n", "place", F.round(F.cos(angle), 4).alias("x"), F.round(F.sin(angle), 4).alias("y"))


def visible_labels(nodes: DataFrame, edges: DataFrame, groups: DataFrame, label: str, max_labels: int = 18, per_group: int = 2, cluster: str = "cluster") -> DataFrame:
    """(label, cluster): nodes whose labels are shown.

    Every cluster shows its ``per_group`` first nodes by weight, strength and label, the rest of
    the ``max_labels`` goes to the best of the others.
    """
    best = [F.desc("n"), F.desc("strength"), F.desc(label)]
    ranked = strengths(nodes, edges, label).join(groups.select(label, cluster), label, "left")
    ranked = ranked.withColumn("_g", F.row_number().over(W.partitionBy(cluster).orderBy(*best)))
    first = (F.col("_g") <= per_group) & F.col(cluster).isNotNull()
    order = W.orderBy(F.when(first, 0).otherwise(1), *best)  # a bounded network
    ranked = ranked.withColumn("_r", F.row_number().over(order))
    return ranked.filter(first | (F.col("_r") <= max_labels)).select(label, cluster)


def bridge_scores(nodes: DataFrame, edges: DataFrame, label: str, quantile: float = 0.9) -> DataFrame:
    """(node, betweenness, is_bridge): exact betweenness over weighted paths at every size; bridges
    reach the ``quantile`` of the network."""

    def run(_g: int, names: list[str], m: np.ndarray, _w: np.ndarray) -> pd.DataFrame:
        b = G.betweenness(m)
        least = np.percentile(b, 100 * quantile) if len(b) else 1.0
        return pd.DataFrame({"node": names, "betweenness": np.round(b, 4), "is_bridge": b >= least})

    return on_graph(as_graphs(nodes, edges, label), run, "node string, betweenness double, is_bridge boolean")


def network_positions(nodes: DataFrame, edges: DataFrame, label: str, mode: str = "auto") -> DataFrame:
    """(node, x, y): positions by ``force`` or by ``clustered`` layout; ``auto`` takes clusters where
    there are two or more. Nodes closer than a least distance are pushed apart."""

    def run(_g: int, names: list[str], m: np.ndarray, _w: np.ndarray) -> pd.DataFrame:
        member = G.louvain(m) if mode != "force" and len(names) else np.zeros(len(names), dtype=int)
        split = len(set(member.tolist())) > 1 and mode in ("auto", "clustered")
        xy = G.cluster_layout(m, member) if split else G.spring_layout(m)
        xy = G.spread_points(np.asarray(xy, dtype=float).reshape(-1, 2))
        return pd.DataFrame({"node": names, "x": np.round(xy[:, 0], 4), "y": np.round(xy[:, 1], 4)})

    return on_graph(as_graphs(nodes, edges, label), run, "node string, x double, y double")


def hole_summary(holes: DataFrame) -> DataFrame:
    """(nodes, mean_brokerage, top_broker, top_score, core_brokers, bridge_candidates); zeros without nodes."""
    top = F.min_by(F.struct("node", "brokerage_score"), F.struct((-F.coalesce("brokerage_score", F.lit(0.0))).alias("s"), "node"))
    s = holes.agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.coalesce(F.avg(F.coalesce("brokerage_score", F.lit(0.0))), F.lit(0.0)), 4).alias("mean_brokerage"), top.alias("t"),
        F.count_if(F.col("brokerage_role") == "core_broker").alias("core_brokers"), F.count_if(F.col("brokerage_role").isin("core_broker", "bridge_candidate")).alias("bridge_candidates"),
    )
    return s.select("nodes", "mean_brokerage", F.coalesce("t.node", F.lit("")).alias("top_broker"), F.coalesce(F.round("t.brokerage_score", 4), F.lit(0.0)).alias("top_score"), "core_brokers", "bridge_candidates")
