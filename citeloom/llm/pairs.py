"""Items that appear together: blocked Gram matrix over binary baskets.

Baskets become rows of sparse 0/1 matrices, one per block of records, and a basket is cut into
item blocks of at most ``WIDE`` items. The product of two item blocks, Xi'Xj, is summed over the
records of a block as (item, item, count); the blocks' sums are added by one aggregation. A
basket of one item block stays one row; a wider one becomes one row per pair of its item blocks,
spread over the tasks, so that no task holds more than ``WIDE`` squared pairs of one record at a
time. Items below the least support cannot be part of a pair and are dropped before (exactly, as
a pair is never more frequent than its items).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize

BLOCK_CELLS = 2_000_000
WIDE = 256


def _flush(keys: list[np.ndarray], items: np.ndarray) -> pa.RecordBatch:
    flat = np.concatenate(keys)
    pair, n = np.unique(flat, return_counts=True)
    u = len(items)
    return pa.RecordBatch.from_arrays([pa.array(items[pair // u]), pa.array(items[pair % u]), pa.array(n)], ["a", "b", "n"])


def _block(values: np.ndarray, offsets: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products for one block of records.

    Row r holds the sorted codes ``values[offsets[r]:offsets[r+1]]``. With ``split[r]`` 0 it is one
    item block, of which the upper triangle counts; otherwise its first ``split[r]`` codes are one
    item block and the rest another, and their rectangle counts.
    """
    items, local = np.unique(values, return_inverse=True)
    u = np.int64(len(items))
    local = local.astype(np.int64)
    lengths = np.diff(offsets)
    keys: list[np.ndarray] = []
    held = 0
    for k, m in sorted(set(zip(lengths.tolist(), split.tolist(), strict=True))):
        if k < 2:
            continue
        starts = offsets[:-1][(lengths == k) & (split == m)]
        if m:
            i, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(m, k), indexing="ij"))
        else:
            i, j = np.triu_indices(int(k), 1)
        step = max(1, BLOCK_CELLS // len(i))
        for s in range(0, len(starts), step):
            rows = local[starts[s : s + step, None] + np.arange(k)]
            keys.append((rows[:, i] * u + rows[:, j]).ravel())
            held += keys[-1].size
            if held > BLOCK_CELLS:
                yield _flush(keys, items)
                keys, held = [], 0
    if keys:
        yield _flush(keys, items)


def _gram(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    vals: list[np.ndarray] = []
    lens: list[np.ndarray] = []
    splits: list[np.ndarray] = []
    held = 0

    def run():
        values, lengths = np.concatenate(vals), np.concatenate(lens)
        yield from _block(values, np.concatenate(([0], np.cumsum(lengths))), np.concatenate(splits))

    for batch in batches:
        col = batch.column(0)
        vals.append(col.flatten().to_numpy(zero_copy_only=False))
        lens.append(np.diff(col.offsets.to_numpy()))
        splits.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += len(vals[-1])
        if held >= block:
            yield from run()
            vals, lens, splits, held = [], [], [], 0
    if held:
        yield from run()


def item_blocks(coded: DataFrame, wide: int = WIDE) -> DataFrame:
    """(ks, split) rows for ``_block`` from (ks): baskets of one item block as they are, wider ones
    as one row for each pair of their item blocks."""
    whole = coded.filter((F.size("ks") > 1) & (F.size("ks") <= wide)).select("ks", F.lit(0).alias("split"))
    last = F.ceil(F.size("ks") / F.lit(wide)).cast("int") - 1
    cut = coded.filter(F.size("ks") > wide).select("ks", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last"))
    cut = cut.select(F.slice("ks", F.col("i") * wide + 1, F.lit(wide)).alias("x"), F.expr(f"transform(sequence(i, last), j -> if(j = i, cast(array() as array<bigint>), slice(ks, j * {wide} + 1, {wide})))").alias("ys"))
    cut = cut.select("x", F.explode("ys").alias("y")).repartition(F.xxhash64("x", "y"))  # one basket's block pairs on many tasks
    return whole.unionByName(cut.select(F.concat("x", "y").alias("ks"), F.when(F.size("y") > 0, F.size("x")).otherwise(0).alias("split")))


def cooccurrence(baskets: DataFrame, id_col: str, item_col: str, min_pairs: int = 5, min_lift: float = 3.0, block: int = 500_000, wide: int = WIDE) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift), item_a < item_b.

    ``baskets`` has one row per record and item; repeated rows count once, nulls are left out.
    Kept are pairs with n_ab >= ``min_pairs`` and n_ab * n >= ``min_lift`` * n_a * n_b, where n
    is the number of records with at least one item. ``block`` is the number of matrix entries
    of a record block, ``wide`` the greatest size of an item block.
    """
    spark = baskets.sparkSession
    rows = baskets.select(F.col(id_col).alias("id"), F.col(item_col).alias("item")).filter("id is not null and item is not null").distinct()
    rows = materialize(rows, "baskets")
    n = rows.select("id").distinct().count()
    vocab = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= min_pairs)
    vocab = materialize(vocab.withColumn("k", F.monotonically_increasing_id()), "vocab")
    coded = materialize(rows.join(vocab.select("item", "k"), "item").groupBy("id").agg(F.sort_array(F.collect_list("k")).alias("ks")), "coded")  # a list is one record
    pairs = (
        item_blocks(coded.select("ks"), wide).mapInArrow(lambda it: _gram(it, block), "a long, b long, n long")
        .groupBy("a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_pairs)
    )
    va = vocab.select(F.col("k").alias("a"), F.col("item").alias("x"), F.col("n_item").alias("nx"))
    vb = vocab.select(F.col("k").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("ny"))
    full = pairs.join(va, "a").join(vb, "b")
    flip = F.col("x") > F.col("y")
    out = full.select(
        F.when(flip, F.col("y")).otherwise(F.col("x")).alias("item_a"),
        F.when(flip, F.col("x")).otherwise(F.col("y")).alias("item_b"),
        "n_ab",
        F.when(flip, F.col("ny")).otherwise(F.col("nx")).alias("n_a"),
        F.when(flip, F.col("nx")).otherwise(F.col("ny")).alias("n_b"),
        F.lit(n).cast("long").alias("n"),
    )
    out = out.filter(F.col("n_ab").cast("double") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
