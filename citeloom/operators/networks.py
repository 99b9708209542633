"""Pairs, bipartite links and networks over long tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.overlaps import mixed, pair_slots, shared_counts, slots
from citeloom.operators.frequency import frequency, top_k
from citeloom.session import materialize


def record_pairs(long: DataFrame, label: str, key: str = "rec_id", distinct: bool = True) -> DataFrame:
    """(key, a, b, n_pairs): pairs of labels of one record, a before b.

    Labels are gathered per record, so only pairs within a record arise. With ``distinct``
    off, repeated labels stay and can pair with themselves.
    """
    items = F.array_sort(F.collect_set(label) if distinct else F.collect_list(label))
    grouped = long.groupBy(key).agg(items.alias("x")).filter(F.size("x") > 1)
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return grouped.select(key, (F.size("x") * (F.size("x") - 1) / 2).alias("n_pairs"), F.explode(pairs).alias("p")).select(key, "p.a", "p.b", "n_pairs")


def pair_counts(long: DataFrame, label: str, key: str = "rec_id", min_weight: int = 1, distinct: bool = True, fractional: bool = False) -> DataFrame:
    """(a, b, weight): records in which both stand, or the sum of 1 / pairs of the record."""
    pairs = record_pairs(long, label, key, distinct)
    w = F.sum(1 / F.col("n_pairs")) if fractional else F.count(F.lit(1))
    return pairs.groupBy("a", "b").agg(w.alias("weight")).filter(F.col("weight") >= min_weight)


def within(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Edges with both ends in a bounded set of nodes."""
    n = F.broadcast(nodes.select(F.col(label).alias("_n")))
    return edges.join(n, edges.a == F.col("_n"), "left_semi").join(n, edges.b == F.col("_n"), "left_semi")


def bipartite_links(left: DataFrame, left_label: str, right: DataFrame, right_label: str, top_left: int, top_right: int, key: str = "rec_id") -> DataFrame:
    """(left, right, n) restricted to the most frequent labels of each side."""
    tl = F.broadcast(top_k(frequency(left, left_label), left_label, top_left).select(left_label))
    tr = F.broadcast(top_k(frequency(right, right_label), right_label, top_right).select(right_label))
    pairs = left.join(tl, left_label, "left_semi").join(right.join(tr, right_label, "left_semi"), key)
    return pairs.groupBy(left_label, right_label).agg(F.count(F.lit(1)).alias("n"))


def association_strength(edges: DataFrame, nodes: DataFrame, label: str, weight: str = "n") -> DataFrame:
    """Edges with weight / (node weight * node weight)."""
    a = nodes.select(F.col(label).alias("a"), F.col(weight).cast("double").alias("wa"))
    b = nodes.select(F.col(label).alias("b"), F.col(weight).cast("double").alias("wb"))
    out = edges.join(a, "a").join(b, "b")
    return out.withColumn("association", F.col("weight") / F.greatest(F.col("wa") * F.col("wb"), F.lit(1e-12))).drop("wa", "wb")


def keyword_network(keywords: DataFrame, top_n: int = 30, min_weight: int = 2, max_pairs: int = 500, label: str = "keyword") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the top keywords; only the strongest ``max_pairs`` pairs are considered."""
    freq = frequency(keywords, label)
    nodes = top_k(freq, label, top_n)
    pairs = pair_counts(keywords, label, min_weight=max(2, min_weight)).orderBy(F.desc("weight"), "a", "b").limit(max_pairs)
    return nodes, within(pairs, nodes, label)


def collaboration(long: DataFrame, label: str, key: str = "rec_id", top_n: int = 25, min_links: int = 1, fractional: bool = False, max_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of entities that are distinct within a record."""
    base = long.select(key, label).distinct()
    if fractional:
        sizes = base.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
        freq = base.join(sizes, key).groupBy(label).agg(F.sum(1 / F.col("k")).alias("n"))
    else:
        freq = frequency(base, label)
    nodes = top_k(freq, label, top_n)
    if max_pairs:  # the strongest pairs of all, then those among the nodes
        edges = pair_counts(base, label, key, fractional=fractional).orderBy(F.desc("weight"), "a", "b").limit(max_pairs)
        return nodes, within(edges, nodes, label).filter(F.col("weight") >= min_links)
    top = base.join(F.broadcast(nodes.select(label)), label, "left_semi")  # a top list
    if not fractional:
        return nodes, pair_counts(top, label, key, min_weight=min_links)
    pairs = record_pairs(top, label, key).drop("n_pairs").join(sizes.select(key, (F.col("k") * (F.col("k") - 1) / 2).alias("n_pairs")), key)
    return nodes, pairs.groupBy("a", "b").agg(F.sum(1 / F.col("n_pairs")).alias("weight")).filter(F.col("weight") >= min_links)


def coauthorship(authors: DataFrame, top_n: int = 50, min_papers: int = 2, min_links: float = 1, fractional: bool = False, label: str = "author", key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with edge-first selection of authors.

    Authors need ``min_papers`` papers (or a fractional weight of 1). Eligible edges are ranked
    by weight, then the weaker and the stronger end; authors enter in that order, then by
    strength, then by papers. Isolated nodes are dropped once min(8, top_n) nodes are linked.
    """
    sizes = authors.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    per = authors.join(sizes, key).groupBy(label).agg(F.sum(1 / F.col("k")).alias("n")) if fractional else frequency(authors, label)
    eligible = per.filter(F.col("n") >= (1 - 1e-9 if fractional else min_papers)).withColumn("n", F.round(F.col("n").cast("double"), 9))
    edges = pair_counts(authors, label, key, distinct=False, fractional=fractional).withColumn("weight", F.round(F.col("weight").cast("double"), 9)).filter(F.col("weight") >= min_links)
    ea = eligible.select(F.col(label).alias("a"), F.col("n").alias("na"))
    eb = eligible.select(F.col(label).alias("b"), F.col("n").alias("nb"))
    edges = edges.join(ea, "a").join(eb, "b")
    ends = edges.select(F.explode(F.array("a", "b")).alias(label), "weight")
    strength = ends.groupBy(label).agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("degree"))
    stats = eligible.join(strength, label, "left").fillna(0, ["strength", "degree"])
    # every edge brings at most two authors, so top_n edges that bring a new author suffice
    order = F.struct((-F.col("weight")).alias("o1"), (-F.least("na", "nb")).alias("o2"), (-F.greatest("na", "nb")).alias("o3"), F.lower("a").alias("o4"), F.lower("b").alias("o5"))
    entry = edges.select(order.alias("o"), F.posexplode(F.array("a", "b")).alias("end", label)).groupBy(label).agg(F.min(F.struct("o", "end")).alias("first"))
    ranked = stats.join(entry, label, "left").orderBy(
        F.col("first").isNull(), "first", F.desc("strength"), F.desc("degree"), F.desc("n"), F.lower(label)
    )
    nodes = ranked.limit(top_n).select(label, "n", "strength", "degree")
    inner = within(edges.select("a", "b", "weight"), nodes, label)
    linked = inner.select(F.explode(F.array("a", "b")).alias(label)).distinct()
    enough = linked.agg(F.count(F.lit(1))).scalar() >= min(8, top_n)
    kept = nodes.join(linked.withColumn("_l", F.lit(True)), label, "left").filter(F.col("_l").isNotNull() | ~enough).drop("_l")
    return kept, inner


def cocitation(refs: DataFrame, label: str = "ref", key: str = "rec_id", top_n: int = 20, min_cocite: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node weight counts every mention, a pair counts once per paper; no isolates.

    Pairs are formed among the top nodes only, so a record contributes at most top_n squared.
    """
    nodes = top_k(frequency(refs.filter(F.col(label).isNotNull()), label), label, top_n)
    kept = refs.join(F.broadcast(nodes.select(label)), label, "left_semi").select(key, label).distinct()
    edges = pair_counts(kept, label, key, min_weight=min_cocite)
    linked = edges.select(F.explode(F.array("a", "b")).alias(label)).distinct()
    return nodes.join(linked, label, "left_semi"), edges


def first_seen(refs: DataFrame, nodes: DataFrame, label: str = "ref", key: str = "rec_id", source: str = "ref_source", year: str = "ref_year") -> DataFrame:
    """``nodes`` with the source and year of each work where it is first cited with one."""
    kept = refs.join(F.broadcast(nodes.select(label)), label, "left_semi")  # nodes are a top list
    seen = kept.groupBy(label).agg(
        F.min_by(source, F.when(F.col(source).isNotNull(), F.struct(key, source))).alias("journal"), F.min_by(year, F.when(F.col(year).isNotNull(), F.struct(key, year))).alias("year")
    )
    return nodes.join(seen, label, "left")


#: References of more papers than this are taken together as signatures and never paired one by one.
HEAVY = 1000


def signatures(base: DataFrame, key: str, label: str, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(light, sigs) of distinct (key, label) rows: rows of labels with at most ``heavy`` keys, and
    (key, sig), the sorted array of the other labels of each key that has any."""
    df = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    many = df.filter(F.col("_n") > heavy).select(label)
    few = df.filter(F.col("_n").between(2, heavy)).select(label)
    sigs = base.join(many, label, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(label)).alias("sig"))  # labels of one record
    return base.join(few, label, "left_semi"), sigs


def signature_overlaps(sigs: DataFrame, key: str) -> DataFrame:
    """(sa, sb, shared): ordered pairs of different or equal signatures that share a label."""
    kinds = sigs.select("sig").distinct()
    one = kinds.select(F.col("sig").alias("sa"), F.explode("sig").alias("r"))
    return one.join(one.select(F.col("sa").alias("sb"), "r"), "r").groupBy("sa", "sb").agg(F.count(F.lit(1)).alias("shared"))


#: Papers of a block at most; their shared references are counted block against block.
BLOCK = 1 << 17
#: Up to so many papers all are compared; beyond, those that may be among the strongest.
FEW = 1 << 15
#: Slots (as a power of two) in which pairs of works are counted for the bounds, parts in which they travel; works of a paper whose pairs are counted.
BITS, PARTS, WIDE = 22, 64, 256


def cited_works(refs: DataFrame, label: str, key: str) -> DataFrame:
    """Distinct (key, label) rows without nulls, written once."""
    return materialize(refs.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label).distinct(), "coupled")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of arrays."""
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype("int64"), column.flatten().to_numpy(zero_copy_only=False)


def _against(batches: Iterable[pa.RecordBatch], heavy: int, least: int, tally: Callable, apart: bool = False) -> Iterator[pa.RecordBatch]:
    """``tally(keys, keys, shared counts)`` for the two blocks of papers in the rows of one task."""
    held: dict[bool, list] = {True: [], False: []}
    for batch in batches:
        for side in held:
            held[side].append(batch.filter(batch.column(1) if side else pc.invert(batch.column(1))))
    if not held[True]:
        return
    left = pa.Table.from_batches(held[True]).combine_chunks()
    right = pa.Table.from_batches(held[False]).combine_chunks()
    same = not right.num_rows and not apart  # a block against itself comes once
    sides = [_lists(t.column(2).combine_chunks()) for t in (left, left if same else right)]
    yield from tally(left.column(0), (left if same else right).column(0), shared_counts(*sides, least, heavy, same))


def coupled_papers(base: DataFrame, label: str, key: str, least: int) -> DataFrame:
    """(key, _ks, _u): works of each paper as numbers and the shared references it has with all others, written once.

    Works of one paper and papers with fewer than ``least`` other works share too little and are left out.
    """
    works = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(label, "_n", F.monotonically_increasing_id().alias("_k"))
    lists = base.join(materialize(works, "works"), label).groupBy(key).agg(F.collect_list("_k").alias("_ks"), F.sum(F.col("_n") - 1).alias("_u"))  # a list is one paper
    return materialize(lists.filter(F.size("_ks") >= least), "papers")


def _blocks_against_blocks(papers: DataFrame, key: str, least: int, heavy: int, tally: Callable, schema: T.StructType) -> DataFrame:
    """Rows of ``tally`` for every two blocks of ``coupled_papers``, each pair of blocks in one task.

    A paper is sent once for each block, so what is shuffled is the input times the number of
    blocks, never the pairs.
    """
    n = papers.count()
    blocks = max(1, -(-n // BLOCK), min(math.ceil(math.sqrt(6 * papers.sparkSession.sparkContext.defaultParallelism)), n // 1000))
    own, other = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.col("_o")
    rows = papers.select(key, "_ks", own.alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    low, high = F.least("_g", other), F.greatest("_g", other)
    task = (high * (high + 1) / 2 + low).cast("int")
    sent = rows.select(key, (F.col("_g") <= other).alias("_left"), "_ks", task.alias("_t")).repartitionById(blocks * (blocks + 1) // 2, F.col("_t")).drop("_t")
    return sent.mapInArrow(lambda it: _against(it, heavy, least, tally), schema)


def _pairs_of(left: pa.ChunkedArray, right: pa.ChunkedArray, counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    left, right = left.combine_chunks(), right.combine_chunks()
    for i, j, n in counts:
        for s in range(0, len(n), 1 << 16):
            x = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([left.take(pa.array(i[x])), right.take(pa.array(j[x])), pa.array(n[x])], ["a", "b", "weight"])


def _strengths_of(left: pa.ChunkedArray, right: pa.ChunkedArray, counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], leasts: list[int], apart: bool = False) -> Iterator[pa.RecordBatch]:
    """Sums of the papers of both blocks; with ``apart`` of the left one only."""
    sums = [(np.zeros((len(leasts), len(x)), "int64"), x) for x in ((left,) if apart else (left, right))]
    for i, j, n in counts:
        for s, least in enumerate(leasts):
            w = np.where(n >= least, n, 0)
            for (total, keys), rows in zip(sums, (i, j)):
                total[s] += np.bincount(rows, weights=w, minlength=len(keys)).astype("int64")
    for total, keys in sums:
        some = np.flatnonzero(total[0])  # of the smallest least
        yield pa.RecordBatch.from_arrays([keys.combine_chunks().take(pa.array(some)), *(pa.array(x[some]) for x in total)], ["k", *(f"s{x}" for x in range(len(leasts)))])


def coupling_pairs(refs: DataFrame, label: str = "ref", key: str = "rec_id", min_shared: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(a, b, weight): papers that share at least ``min_shared`` references.

    The papers are cut into blocks; each task counts what two blocks share in NumPy and returns
    only the pairs of the result. References of more than ``heavy`` papers of a block are added
    as whole 0/1 rows.
    """
    base = cited_works(refs, label, key)
    kind = base.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("weight", T.LongType())])
    least = max(1, min_shared)
    found = _blocks_against_blocks(coupled_papers(base, label, key, least), key, least, heavy, _pairs_of, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def _sums_schema(papers: DataFrame, key: str, leasts: list[int]) -> T.StructType:
    return T.StructType([T.StructField("k", papers.schema[key].dataType), *(T.StructField(f"s{x}", T.LongType()) for x in range(len(leasts)))])


def _strengths_of_all(papers: DataFrame, key: str, leasts: list[int], heavy: int) -> DataFrame:
    """(key, s0, s1, ...) for ascending ``leasts``, every paper against every other."""
    parts = _blocks_against_blocks(papers, key, leasts[0], heavy, lambda a, b, c: _strengths_of(a, b, c, leasts), _sums_schema(papers, key, leasts))
    return parts.groupBy(F.col("k").alias(key)).agg(*[F.sum(f"s{x}").alias(f"s{x}") for x in range(len(leasts))])


def _strengths_of_some(some: DataFrame, m: int, papers: DataFrame, n: int, key: str, leasts: list[int], heavy: int) -> DataFrame:
    """The same for ``m`` of the ``n`` papers, each of their blocks against each block of all papers."""
    lefts, rights = -(-m // BLOCK) or 1, max(papers.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK))
    place = lambda blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    one = some.select(key, F.lit(True).alias("_left"), "_ks", place(lefts).alias("_g"), each(rights)).withColumn("_t", F.col("_g") * rights + F.col("_o"))
    two = papers.select(key, F.lit(False).alias("_left"), "_ks", place(rights).alias("_g"), each(lefts)).withColumn("_t", F.col("_o") * rights + F.col("_g"))
    sent = one.unionByName(two).drop("_g", "_o").repartitionById(lefts * rights, F.col("_t")).drop("_t")
    parts = sent.mapInArrow(lambda it: _against(it, heavy, leasts[0], lambda a, b, c: _strengths_of(a, b, c, leasts, True), True), _sums_schema(papers, key, leasts))
    # each paper has met itself once
    own = some.select(F.col(key).alias("k"), *[F.when(F.size("_ks") >= least, -F.size("_ks")).otherwise(0).cast("long").alias(f"s{x}") for x, least in enumerate(leasts)])
    return parts.unionByName(own).groupBy(F.col("k").alias(key)).agg(*[F.sum(f"s{x}").alias(f"s{x}") for x in range(len(leasts))])


def _packed(x: int, counts: np.ndarray) -> pa.RecordBatch:
    small = counts.astype(np.min_scalar_type(counts.max()))
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["part", "counts"])


def _unpacked(counts: bytes, size: int) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) // size}").astype("int64")


def _sketch(batches: Iterable[pa.RecordBatch], bits: int, parts: int, wide: int) -> Iterator[pa.RecordBatch]:
    """(part, counts): how often each slot of a pair of works came, then of each work of papers with more than ``wide``."""
    pairs, alone = np.zeros(1 << bits, "uint32"), np.zeros(1 << bits, "uint32")
    for batch in batches:
        offsets, values = _lists(batch.column(0))
        far = np.repeat(np.diff(offsets) > wide, np.diff(offsets))
        if far.any():
            np.add.at(alone, slots(mixed(values[far]), bits), np.uint32(1))
            offsets, values = np.concatenate(([0], np.cumsum(~far)))[offsets], values[~far]
        for _, at in pair_slots(offsets, values, bits):
            np.add.at(pairs, at, np.uint32(1))
    for x, part in enumerate([*np.split(pairs, parts), *np.split(alone, parts)]):
        if part.any():
            yield _packed(x, part)


def _sum_of_sketches(t: pa.Table, size: int) -> pa.Table:
    return pa.Table.from_batches([_packed(t.column("part")[0].as_py(), sum(_unpacked(x.as_py(), size) for x in t.column("counts")))])


def _bounds(batches: Iterable[pa.RecordBatch], pairs: np.ndarray, alone: np.ndarray, bits: int, wide: int, leasts: list[int]) -> Iterator[pa.RecordBatch]:
    """(key, _ks, b0, b1, ...) for rows (key, _ks, _u)."""
    for batch in batches:
        offsets, values = _lists(batch.column(1))
        all_shared = batch.column(2).to_numpy(zero_copy_only=False)
        far = np.diff(offsets) > wide
        by_far = np.concatenate(([0], np.cumsum(alone[slots(mixed(values), bits)], dtype="int64")))
        by_far = by_far[offsets[1:]] - by_far[offsets[:-1]]
        kept = ~np.repeat(far, np.diff(offsets))
        twos = np.zeros(len(far), "int64")
        for row, at in pair_slots(np.concatenate(([0], np.cumsum(kept)))[offsets], values[kept], bits):
            twos += np.bincount(row, weights=pairs[at] - 1, minlength=len(far)).astype("int64")
        found = [np.where(far, all_shared, np.minimum(all_shared, by_far + 2 * twos // (least - 1))) if least > 1 else all_shared for least in leasts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], ["k", "_ks", *(f"b{x}" for x in range(len(leasts)))])


def strength_bounds(papers: DataFrame, key: str, leasts: list[int]) -> DataFrame:
    """(key, _ks, b0, b1, ...): ``coupled_papers`` with a number that the strength for ``leasts[x]`` does not exceed.

    A paper shares n references with another: over the others, the sum of n is known from the counts of
    its works, the sum of n (n - 1) / 2 from the counts of its pairs of works; where n >= least > 1, n is at
    most n (n - 1) / (least - 1). Pairs are counted by slot, which can only raise the bound. Papers with
    very many works give no pairs: what others share with them is taken from single works.
    """
    bits, wide, parts = BITS, WIDE, PARTS
    size, schema = (1 << bits) // parts, "part int, counts binary"
    counts = papers.select("_ks").mapInArrow(lambda it: _sketch(it, bits, parts, wide), schema).groupBy("part").applyInArrow(lambda t: _sum_of_sketches(t, size), schema)
    tables = np.zeros((2, parts, size), "int64")  # its size is a parameter
    for r in counts.collect():
        tables[divmod(r["part"], parts)] = _unpacked(r["counts"], size)
    sent = papers.sparkSession.sparkContext.broadcast([t.ravel().astype(np.min_scalar_type(t.max())) for t in tables])
    schema = T.StructType([T.StructField("k", papers.schema[key].dataType), papers.schema["_ks"], *(T.StructField(f"b{x}", T.LongType()) for x in range(len(leasts)))])
    return materialize(papers.select(key, "_ks", "_u").mapInArrow(lambda it: _bounds(it, *sent.value, bits, wide, leasts), schema).withColumnRenamed("k", key), "bounds")


def _strengths_of_top(papers: DataFrame, key: str, leasts: list[int], top_n: int, heavy: int) -> DataFrame:
    """(key, s0, s1, ...) of the ``top_n`` papers by each strength, ties included, and of some others.

    The first by bound are compared with all papers; then all whose bound reaches the least of the best
    found so. Where these are most papers, all are compared with all.
    """
    n = papers.count()
    if n <= FEW:
        return _strengths_of_all(papers, key, leasts, heavy)
    bounds = strength_bounds(papers, key, leasts)
    first = [bounds.orderBy(F.desc(f"b{x}"), F.asc(key)).limit(4 * top_n) for x in range(len(leasts))]
    first = materialize(reduce(DataFrame.unionByName, first).dropDuplicates([key]), "first")
    found = _strengths_of_some(first, 4 * top_n * len(leasts), papers, n, key, leasts, heavy).drop(key).collect()  # a few top lists
    low = [max(1, sorted((r[f"s{x}"] for r in found), reverse=True)[top_n - 1 : top_n][0] if len(found) >= top_n else 1) for x in range(len(leasts))]
    some = bounds.filter(reduce(Column.__or__, [F.col(f"b{x}") >= v for x, v in enumerate(low)]))
    m = some.count()
    return _strengths_of_some(some, m, papers, n, key, leasts, heavy) if 2 * m <= n else _strengths_of_all(papers, key, leasts, heavy)


def coupling_strengths(base: DataFrame, min_shareds: list[int], label: str = "ref", key: str = "rec_id", heavy: int = HEAVY, top_n: int | None = None) -> DataFrame:
    """(key, s0, s1, ...): references that a paper of ``cited_works`` shares with the papers with which
    it shares at least ``min_shareds[x]``. The pairs are summed up where they are counted and never leave the task.

    With ``top_n`` only papers that may be among the first ``top_n`` by one of the strengths are sure to come.
    """
    order = sorted({max(1, m) for m in min_shareds})
    papers = coupled_papers(base, label, key, order[0])
    sums = _strengths_of_top(papers, key, order, top_n, heavy) if top_n else _strengths_of_all(papers, key, order, heavy)
    return sums.select(key, *[F.col(f"s{order.index(max(1, m))}").alias(f"s{x}") for x, m in enumerate(min_shareds)])


def coupling_network(refs: DataFrame, top_n: int = 30, min_shared: int = 2, label: str = "ref", key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): papers ranked by shared references, pairs among the first ``top_n``."""
    base = cited_works(refs, label, key)
    strength = coupling_strengths(base, [min_shared], label, key, top_n=top_n).withColumnRenamed("s0", "strength").filter("strength > 0")
    nodes = materialize(strength.orderBy(F.desc("strength"), F.asc(key)).limit(top_n), "nodes")
    inner = base.join(F.broadcast(nodes.select(key)), key, "left_semi")  # a top list
    return nodes, pair_counts(inner, key, label, min_weight=min_shared)


def jaccard(keywords: DataFrame, top_n: int = 15, min_weight: int = 2, label: str = "keyword") -> DataFrame:
    """(row, col, value): w / (fa + fb - w) of the top keywords, lower triangle with the diagonal."""
    nodes = F.broadcast(top_k(frequency(keywords, label), label, top_n))
    r = nodes.withColumn("i", F.row_number().over(W.orderBy(F.desc("n"), F.asc(label))))  # top_n rows
    a = r.select(F.col(label).alias("row"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = r.select(F.col(label).alias("col"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    cells = a.join(F.broadcast(b), F.col("ib") <= F.col("ia"))
    pairs = pair_counts(keywords.join(nodes.select(label), label, "left_semi"), label, min_weight=min_weight)
    joined = cells.join(F.broadcast(pairs), (F.least("row", "col") == F.col("a")) & (F.greatest("row", "col") == F.col("b")), "left")
    w = F.coalesce("weight", F.lit(0))
    value = F.when(F.col("ia") == F.col("ib"), 1.0).otherwise(F.round(w / (F.col("na") + F.col("nb") - w), 4))
    return joined.select("row", "col", value.alias("value"))


def three_field_links(papers: DataFrame, authors: DataFrame, keywords: DataFrame, top_authors: int = 10, top_keywords: int = 15, top_journals: int = 10) -> DataFrame:
    """(side, source, target, n): author - keyword and keyword - journal links of the top labels.

    Records without a journal are left out; a keyword is weighted once per author and keyword.
    """
    p = papers.filter("journal is not null").select("rec_id", "journal")
    au, kw = authors.join(p, "rec_id"), keywords.join(p, "rec_id")
    ak = au.select("rec_id", "author").join(kw.select("rec_id", "keyword"), "rec_id")
    ta = F.broadcast(top_k(frequency(au, "author"), "author", top_authors).select("author"))
    tk = F.broadcast(top_k(frequency(ak, "keyword"), "keyword", top_keywords).select("keyword"))
    tj = F.broadcast(top_k(frequency(p, "journal"), "journal", top_journals).select("journal"))
    left = ak.join(ta, "author", "left_semi").join(tk, "keyword", "left_semi").groupBy("author", "keyword").agg(F.count(F.lit(1)).alias("n"))
    right = kw.join(tk, "keyword", "left_semi").join(tj, "journal", "left_semi").groupBy("keyword", "journal").agg(F.count(F.lit(1)).alias("n"))
    one = left.select(F.lit("author-keyword").alias("side"), F.col("author").alias("source"), F.col("keyword").alias("target"), "n")
    return one.unionByName(right.select(F.lit("keyword-journal").alias("side"), F.col("keyword").alias("source"), F.col("journal").alias("target"), "n"))


def impact_quadrant(countries: DataFrame, papers: DataFrame, top_n: int = 10, fractional: bool = False, label: str = "country") -> DataFrame:
    """Publications and citations per country with the quadrant by the medians of the rounded top."""
    base = countries.select("rec_id", label).distinct()
    k = base.groupBy("rec_id").agg(F.count(F.lit(1)).alias("k")) if fractional else None
    joined = base.join(papers.select("rec_id", "times_cited"), "rec_id")
    share: Column = F.lit(1.0)
    if k is not None:
        joined, share = joined.join(k, "rec_id"), 1.0 / F.col("k")
    agg = joined.groupBy(label).agg(F.sum(share).alias("p"), F.sum(F.col("times_cited") * share).alias("c"))
    frame = agg.select(label, F.round("p", 2).alias("publications"), F.round(F.col("c") / F.col("p"), 2).alias("avg_citations"), F.round("c", 2).alias("total_citations"))
    top = frame.orderBy(F.desc("publications"), F.desc("total_citations"), F.asc(label)).limit(max(top_n, 4))
    mp, mc = top.agg(F.percentile("publications", F.lit(0.5))).scalar(), top.agg(F.percentile("avg_citations", F.lit(0.5))).scalar()
    high, good = F.col("publications") >= mp, F.col("avg_citations") >= mc
    label_of = F.when(high & good, "High output & high impact").when(high, "High-output").when(good, "High-quality").otherwise("Low output & low impact")
    return top.withColumn("quadrant", label_of)


def network_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, avg_degree)."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1))).scalar()
    out = n.withColumn("edges", m)
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return out.select("nodes", "edges", F.round(density, 4).alias("density"), F.round(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0), 2).alias("avg_degree"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient) by joining the edges of each node with the edges.

    Edges point from the lower to the higher degree, so a node starts no more wedges than the
    square root of the number of edges.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node")
    da, db = degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    e = edges.select("a", "b").join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").filter("x < y")
    known = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    tri = wedges.join(known, ["x", "y"], "left_semi")
    per = tri.select(F.explode(F.array("u", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    c = F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degree.join(per, "node", "left").select("node", "degree", t.alias("triangles"), F.round(c, 4).alias("coefficient"))


def bipartite_barycentre(links: DataFrame, left: str, right: str) -> DataFrame:
    """(right, barycentre): weighted mean rank of the neighbours on the other side."""
    size = links.groupBy(left).agg(F.sum("n").alias("s"))
    ranks = size.select(left, F.row_number().over(W.orderBy(F.desc("s"), F.asc(left))).alias("r"))  # bounded by the top lists
    return links.join(F.broadcast(ranks), left).groupBy(right).agg(F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 4).alias("barycentre"))
