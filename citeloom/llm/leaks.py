"""Passages of held-out items inside documents: Wu-Manber search over words.

Every run of ``words`` consecutive words of an item is a pattern. The shift table is keyed by
blocks of two words: a block that no pattern holds lets the scan jump ``words - 1`` words, a
block inside patterns jumps to their nearest end. Where the shift is 0 the last ``TAIL`` words
select a suffix bucket, the first ``HEAD`` words of the window a prefix within it, and a direct
comparison of the words confirms each pattern left; so what is compared hardly grows with the
number of items that share a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import spread

WORD = re.compile(r"[^\W_]+")
#: Words of a pattern's end and beginning that select its bucket.
TAIL, HEAD = 4, 2
#: Words of all items in one shipped table; larger item sets are searched table by table.
TABLE_WORDS = 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


class Patterns:
    """Shift table and suffix buckets of all windows of a set of items."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.m = words
        self.items: list[tuple[int, list[str]]] = []
        self.shift: dict[tuple[str, str], int] = {}
        self.tail, self.head = min(TAIL, words), min(HEAD, words)
        self.ends: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for ident, text in items:
            w = words_of(text)
            if len(w) < words:
                continue
            n = len(self.items)
            self.items.append((ident, w))
            for e in range(1, len(w)):
                block = (w[e - 1], w[e])
                if e >= words - 1:
                    self.shift[block] = 0
                    first = e - words + 1
                    bucket = self.ends.setdefault(tuple(w[e - self.tail + 1 : e + 1]), {})
                    bucket.setdefault(tuple(w[first : first + self.head]), []).append((n, e))
                else:
                    self.shift[block] = min(self.shift.get(block, words), words - 1 - e)

    def search(self, text: str) -> set[int]:
        """Ids of the items of which ``text`` repeats a window."""
        w, m = words_of(text), self.m
        found: set[int] = set()
        shift, far, e, n = self.shift, m - 1, m - 1, len(w)
        while e < n:
            block = (w[e - 1], w[e])
            s = shift.get(block, far)
            if s:
                e += s
                continue
            bucket = self.ends.get(tuple(w[e - self.tail + 1 : e + 1]))
            if bucket:
                window = w[e - m + 1 : e + 1]
                for k, end in bucket.get(tuple(window[: self.head]), ()):
                    ident, own = self.items[k]
                    if ident not in found and own[end - m + 1 : end + 1] == window:
                        found.add(ident)
            e += 1
        return found


def _scan(batches: Iterable[pa.RecordBatch], items: list[tuple[int, str]], words: int, item_type) -> Iterator[pa.RecordBatch]:
    patterns = Patterns(items, words)
    for batch in batches:
        at: list[int] = []
        hit: list[int] = []
        for row, text in enumerate(batch.column(1).to_pylist()):
            if text:
                for ident in patterns.search(text):
                    at.append(row)
                    hit.append(ident)
        if at:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hit, item_type)], ["doc", "item"])


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", words: int = 12, table_words: int = TABLE_WORDS
) -> DataFrame:
    """(``doc_id``, ``item_id``), distinct: documents that repeat ``words`` consecutive words of an item.

    Words are runs of letters and digits, case folded; what stands between them is ignored.
    Null or empty texts match nothing, items shorter than ``words`` words neither. Item ids must
    be whole numbers. The item set is shipped in tables of at most ``table_words`` words; a larger
    set is searched in several passes over the documents, so nothing shipped grows unbounded.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    it, dt = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    arrow_item = to_arrow_type(it)
    source = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    tables: list[list[tuple[int, str]]] = []
    held = table_words
    for r in source.toLocalIterator():  # a stated item set, table by table
        n = len(r.t) // 4 + 1
        if held + n > table_words:
            tables.append([])
            held = 0
        tables[-1].append((r.i, r.t))
        held += n
    schema = f"doc {dt.simpleString()}, item {it.simpleString()}"
    cells = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("text is not null"))
    out = spark.createDataFrame([], schema)
    for k, part in enumerate(tables):
        hits = cells.mapInArrow(lambda b, p=part: _scan(b, p, words, arrow_item), schema)
        out = hits if k == 0 else out.unionByName(hits)
    return out.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def leak_report(leaks: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(``item_id``, documents): how many documents contain each leaked item."""
    return leaks.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"))
