"""Graph algorithms on bounded networks, in NumPy.

Networks come as edge lists of at most a few hundred nodes (the operators cut to a top N
before). Node order is the order of labels, so results are deterministic.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Sequence

import numpy as np


def matrix_of(nodes: Sequence[Hashable], edges: Sequence[tuple]) -> np.ndarray:
    """Symmetric weights between nodes in the order given."""
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        if a in at and b in at:
            w[at[a], at[b]] += x
            if a != b:
                w[at[b], at[a]] += x
    return w


def modularity(w: np.ndarray, member: np.ndarray) -> float:
    total = w.sum()
    if total == 0:
        return 0.0
    q = 0.0
    for c in np.unique(member):
        own = member == c
        q += w[np.ix_(own, own)].sum() / total - (w[own].sum() / total) ** 2
    return float(q)


def relabel(member: np.ndarray) -> np.ndarray:
    """Communities numbered by their first node."""
    names: dict[int, int] = {}
    return np.array([names.setdefault(int(c), len(names)) for c in member], dtype=int)


def louvain(w: np.ndarray) -> np.ndarray:
    """Communities by local moving and aggregation; nodes in order, strictly positive gains only."""
    n = len(w)
    member = np.arange(n)
    level = w.astype(float).copy()
    if level.sum() == 0:
        return member
    while True:
        size, total = len(level), level.sum()
        degree = level.sum(axis=1)
        own = np.arange(size)
        weight = degree.copy()
        moved = True
        any_move = False
        while moved:
            moved = False
            for i in range(size):
                c = own[i]
                weight[c] -= degree[i]
                links: dict[int, float] = {}
                for j in np.nonzero(level[i])[0]:
                    if j != i:
                        links[int(own[j])] = links.get(int(own[j]), 0.0) + level[i, j]
                stay = links.get(int(c), 0.0) - weight[c] * degree[i] / total
                best, gain = c, stay
                for d in sorted(links):
                    g = links[d] - weight[d] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = d, g
                own[i] = best
                weight[best] += degree[i]
                if best != c:
                    moved = any_move = True
        own = relabel(own)
        member = own[member]
        if not any_move or own.max() + 1 == size:
            return relabel(member)
        fold = np.zeros((size, own.max() + 1))
        fold[np.arange(size), own] = 1
        level = fold.T @ level @ fold


def greedy_modularity(w: np.ndarray) -> np.ndarray:
    """Communities by merging the pair with the greatest gain while there is one; first pair among equals."""
    n = len(w)
    total = w.sum()
    member = np.arange(n)
    if total == 0:
        return member
    e = w / total
    a = e.sum(axis=1)
    alive = list(range(n))
    while len(alive) > 1:
        idx = np.array(alive)
        sub = e[np.ix_(idx, idx)]
        gain = np.where(sub > 0, 2 * (sub - np.outer(a[idx], a[idx])), -np.inf)
        gain[np.tril_indices(len(idx))] = -np.inf
        k = int(gain.argmax())
        i, j = divmod(k, len(idx))
        if gain[i, j] <= 1e-15:
            break
        x, y = int(idx[i]), int(idx[j])
        e[x] += e[y]
        e[:, x] += e[:, y]
        a[x] += a[y]
        member[member == y] = x
        alive.remove(y)
    return relabel(member)


def betweenness(w: np.ndarray) -> np.ndarray:
    """Shortest-path betweenness with weights as distances, scaled to the number of pairs."""
    n = len(w)
    score = np.zeros(n)
    near = [np.nonzero(w[i])[0] for i in range(n)]
    for s in range(n):
        dist = np.full(n, np.inf)
        paths = np.zeros(n)
        before: list[list[int]] = [[] for _ in range(n)]
        dist[s], paths[s] = 0.0, 1.0
        done: list[int] = []
        seen = np.zeros(n, dtype=bool)
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if seen[v]:
                continue
            seen[v] = True
            done.append(v)
            for u in near[v]:
                if u == v:
                    continue
                via = d + w[v, u]
                if via < dist[u] - 1e-12:
                    dist[u], paths[u], before[u] = via, paths[v], [v]
                    heapq.heappush(heap, (via, int(u)))
                elif abs(via - dist[u]) <= 1e-12 and not seen[u]:
                    paths[u] += paths[v]
                    before[u].append(v)
        gain = np.zeros(n)
        for v in reversed(done):
            for p in before[v]:
                gain[p] += paths[p] / paths[v] * (1 + gain[v])
            if v != s:
                score[v] += gain[v]
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def constraint(w: np.ndarray) -> np.ndarray:
    """Burt's constraint; not a number for isolated nodes."""
    out = w.sum(axis=1, keepdims=True)
    p = np.divide(w, out, out=np.zeros_like(w, dtype=float), where=out > 0)
    local = (p + p @ p) ** 2
    c = np.where(w > 0, local, 0).sum(axis=1)
    return np.where(out[:, 0] > 0, c, np.nan)


def effective_size(w: np.ndarray) -> np.ndarray:
    """Burt's effective size; 0 for isolated nodes."""
    out = w.sum(axis=1, keepdims=True)
    top = w.max(axis=1, keepdims=True, initial=0)
    p = np.divide(w, out, out=np.zeros_like(w, dtype=float), where=out > 0)
    m = np.divide(w, top, out=np.zeros_like(w, dtype=float), where=top > 0)
    linked = (w > 0).astype(float)
    redundant = (linked * (p @ m.T)).sum(axis=1)
    return np.where(out[:, 0] > 0, linked.sum(axis=1) - redundant, 0.0)


def clustering_coefficients(w: np.ndarray) -> np.ndarray:
    a = (w > 0).astype(float)
    np.fill_diagonal(a, 0)
    k = a.sum(axis=1)
    tri = np.diag(a @ a @ a) / 2
    return np.divide(2 * tri, k * (k - 1), out=np.zeros(len(w)), where=k > 1)


def average_linkage_order(profile: np.ndarray) -> list[int]:
    """Leaf order of an average-linkage tree over cosine distances of the rows."""
    norm = np.linalg.norm(profile, axis=1)
    sim = profile @ profile.T / np.where(np.outer(norm, norm) > 0, np.outer(norm, norm), 1)
    dist = np.where(np.outer(norm, norm) > 0, 1 - sim, 1.0)
    leaves = {i: [i] for i in range(len(profile))}
    while len(leaves) > 1:
        keys = sorted(leaves)
        best = min(((dist[np.ix_(leaves[x], leaves[y])].mean(), x, y) for i, x in enumerate(keys) for y in keys[i + 1 :]), key=lambda t: (round(t[0], 12), t[1], t[2]))
        _, x, y = best
        leaves[max(keys) + 1] = leaves.pop(x) + leaves.pop(y)
    return next(iter(leaves.values()), [])


def spring_layout(w: np.ndarray, rounds: int = 60, seed: int = 42) -> np.ndarray:
    """Force-directed positions in the unit square."""
    n = len(w)
    rng = np.random.default_rng(seed)
    pos = rng.random((n, 2))
    if n < 2:
        return pos
    k, heat = 1 / np.sqrt(n), 0.1
    for _ in range(rounds):
        delta = pos[:, None] - pos[None]
        gap = np.maximum(np.linalg.norm(delta, axis=2), 0.01)
        force = k * k / gap**2 - w * gap / k
        move = (delta * force[..., None]).sum(axis=1)
        length = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 0.01)
        pos += move / length * np.minimum(length, heat)
        heat *= 0.95
    span = np.ptp(pos, axis=0)
    return (pos - pos.min(axis=0)) / np.where(span > 0, span, 1)


def cluster_layout(w: np.ndarray, member: np.ndarray, seed: int = 42) -> np.ndarray:
    """Positions by cluster: clusters laid out by the weight between them, nodes around each centre."""
    k = int(member.max()) + 1 if len(member) else 0
    fold = np.zeros((len(w), k))
    fold[np.arange(len(w)), member] = 1
    between = fold.T @ w @ fold
    np.fill_diagonal(between, 0)
    centres = spring_layout(between, seed=seed) * max(1.0, np.sqrt(k))
    pos = np.zeros((len(w), 2))
    for c in range(k):
        own = np.nonzero(member == c)[0]
        inner = spring_layout(w[np.ix_(own, own)], seed=seed) - 0.5
        pos[own] = centres[c] + inner * 0.3 * np.sqrt(len(own) / max(1, len(w)))
    return pos


def bipartite_layout(left: Sequence[Hashable], right: Sequence[Hashable], links: Sequence[tuple], gap: float = 2.1) -> dict[Hashable, tuple[float, float]]:
    """Two columns; the right one ordered by the weighted mean rank of its neighbours."""
    rank = {n: i for i, n in enumerate(left)}
    mean = {}
    for n in right:
        own = [(rank[a], x) for a, b, x in links if b == n and a in rank]
        total = sum(x for _, x in own)
        mean[n] = sum(r * x for r, x in own) / total if total else float(len(rank))
    order = sorted(right, key=lambda n: (mean[n], str(n)))
    place = lambda col, x: {n: (x, -(i + 0.5) / max(1, len(col))) for i, n in enumerate(col)}
    return place(list(left), -gap) | place(order, gap)


def spread_points(xy: np.ndarray, least: float = 0.28, rounds: int = 80) -> np.ndarray:
    """Points moved apart until no two are nearer than ``least``; all pairs of a round move at once."""
    out = np.array(xy, dtype=float)
    n = len(out)
    for k in range(rounds):
        delta = out[:, None, :] - out[None, :, :]
        dist = np.sqrt((delta**2).sum(axis=2))
        close = (dist < least) & ~np.eye(n, dtype=bool)
        if not close.any():
            break
        same = close & (dist == 0)
        if same.any():  # points in one place part along directions of their own
            turn = 2 * np.pi * (np.arange(n) + 0.5 * k) / max(n, 1)
            out[same.any(axis=1)] += 0.015 * np.stack([np.cos(turn), np.sin(turn)], axis=1)[same.any(axis=1)]
            continue
        push = np.where(close, (least - dist) / np.where(dist > 0, dist, 1.0), 0.0)
        out += 0.5 * (push[:, :, None] * delta).sum(axis=1) / np.maximum(close.sum(axis=1), 1)[:, None] * 1.02
    return out
