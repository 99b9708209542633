"""Entries that the rows of two blocks share, counted or bounded in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of the count matrix held at a time, entries added to it at a time, bytes of the dense columns.
CELLS, ENTRIES, DENSE = 1 << 22, 1 << 20, 1 << 26


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], least: int, heavy: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, n) arrays: row i of ``left`` and row j of ``right`` share n >= ``least`` >= 1 entries.

    A block is (offsets, values): row r holds the different values ``values[offsets[r]:offsets[r+1]]``.
    With ``same`` both are one block and only i < j is given. A value of more than ``heavy`` rows of
    ``right`` is added as a whole 0/1 row, the others entry by entry; the counts are the same.
    """
    (lo, lv), (ro, rv) = left, right
    m, lens = len(ro) - 1, np.diff(lo)
    if not m or not len(lv) or not len(rv):
        return
    codes, both = np.unique(np.concatenate((lv, rv)), return_inverse=True)
    mine, theirs = both[: len(lv)], both[len(lv) :]
    holders = np.repeat(np.arange(m), np.diff(ro))[np.argsort(theirs, kind="stable")]
    df = np.bincount(theirs, minlength=len(codes))
    start = np.cumsum(df) - df
    big = np.argsort(-df, kind="stable")[: max(1, DENSE // m)]
    big = big[df[big] > heavy]
    kind = np.dtype("uint8" if lens.max() < 1 << 8 else "uint16" if lens.max() < 1 << 16 else "uint32")
    dense = np.zeros((len(big), m), "uint8")
    place = np.full(len(codes), -1)
    for x, c in enumerate(big):
        dense[x, holders[start[c] : start[c] + df[c]]] = 1
        place[c] = x
    light = np.where(place < 0, df, 0)
    work = np.concatenate(([0], np.cumsum(light[mine])))[lo]  # entries to add before each row
    room = -(-max(CELLS, m) // 8) * 8
    cells, mark = np.empty(room, kind), np.empty(room, bool)  # once: fresh pages cost more than the counting
    s, rows = 0, len(lens)
    while s < rows:
        e = max(s + 1, min(rows, s + CELLS // m, int(np.searchsorted(work, work[s] + ENTRIES, "right")) - 1))
        part, row = mine[lo[s] : lo[e]], np.repeat(np.arange(e - s), lens[s:e])
        size = (e - s) * m
        flat = cells[:size]
        flat.fill(0)
        count = flat.reshape(e - s, m)
        at = place[part]
        for i, x in zip(row[at >= 0].tolist(), at[at >= 0].tolist()):
            np.add(count[i], dense[x], out=count[i])
        n = light[part]
        entry = np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(flat, np.repeat(row * m, n) + holders[entry], kind.type(1))
        np.greater_equal(flat, least, out=mark[:size])
        mark[size : -(-size // 8) * 8] = False
        words = np.flatnonzero(mark[: -(-size // 8) * 8].view(np.uint64))  # most are empty
        inner = np.flatnonzero(mark.reshape(-1, 8)[words])
        hit = words[inner >> 3] * 8 + (inner & 7)
        i = hit // m
        j, i = hit - i * m, i + s
        w = flat[hit]
        if same:
            keep = j > i
            i, j, w = i[keep], j[keep], w[keep]
        yield i, j, w.astype("int64")
        s = e


def mixed(values: np.ndarray) -> np.ndarray:
    """Whole numbers as well mixed 64 bits (splitmix64)."""
    x = values.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(mixed_bits: np.ndarray, bits: int) -> np.ndarray:
    return ((mixed_bits * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype("int64")


def pair_slots(offsets: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) arrays: the slot below 2 ** ``bits`` of every two values of a row, in whichever order they stand."""
    lens, x = np.diff(offsets), mixed(values)
    later = np.repeat(offsets[1:], lens) - np.arange(len(values)) - 1  # values of its row after each
    work = np.concatenate(([0], np.cumsum(later)))[offsets]
    s, rows = 0, len(lens)
    while s < rows:
        e = max(s + 1, min(rows, int(np.searchsorted(work, work[s] + ENTRIES, "right")) - 1))
        n = later[offsets[s] : offsets[e]]
        first = np.repeat(np.arange(offsets[s], offsets[e]), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(s, e), np.diff(work[s : e + 1])), slots(x[first] + x[second], bits)
        s = e
