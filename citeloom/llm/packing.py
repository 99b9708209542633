"""Texts into containers of fixed token capacity: bounded-space online best-fit.

Each partition packs its own stream with a fixed number of open bins. Bins are kept by free
space; a bitset has a bit for each free space in use, so the tightest bin that still takes a
text is one bit operation. When all bins are open and none fits, the fullest closes first.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import spread

#: Vocabulary of a public tokenizer; the driver reads it and sends it to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizing pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_counter(path: str):
    """A function texts -> token counts for the vocabulary file at ``path``."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


class Packer:
    """Online best-fit with at most ``open_bins`` open containers of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0
        self.filled: dict[int, int] = {}

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        return b

    def place(self, size: int) -> tuple[int, int, int]:
        """(container, place in it, first token) of an item of at most ``capacity`` tokens."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:  # close the fullest
                self.filled.pop(self._take((self.bits & -self.bits).bit_length() - 1))
                self.open -= 1
            b, free = self.made, self.capacity
            self.made += 1
            self.open += 1
            self.filled[b] = 0
        place = self.filled[b] + 1
        left = free - size
        if left:
            self.filled[b] = place
            self.by_free[left].append(b)
            self.bits |= 1 << left
        else:
            del self.filled[b]
            self.open -= 1
        return b, place, self.capacity - free


def _pack(batches: Iterable[pa.RecordBatch], path: str, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    sent = SparkFiles.get(os.path.basename(path))
    count = load_counter(sent if os.path.exists(sent) else path)
    ctx = TaskContext.get()
    base = (ctx.partitionId() if ctx else 0) << 40
    packer = Packer(capacity, open_bins)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at: list[int] = []
        cols: list[list[int]] = [[] for _ in range(6)]
        for row, n in enumerate(count(texts)):
            start, piece = 0, 1
            while True:
                size = min(capacity, n - start)
                b, place, offset = packer.place(size)
                at.append(row)
                for c, v in zip(cols, (piece, start, size, base + b, place, offset)):
                    c.append(v)
                start += size
                piece += 1
                if start >= n:
                    break
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, types)],
            ["id", "piece", "piece_start", "n_tokens", "container_id", "place", "container_offset"],
        )


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, open_bins: int = 128, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``id_col``, piece, piece_start, n_tokens, container_id, place, container_offset).

    Each text goes whole into one container; only a text longer than ``capacity`` tokens is cut
    into pieces of ``capacity`` (the rest is packed like any text). ``place`` counts from 1 in
    the container, ``container_offset`` is the first token there. Null and empty texts have 0
    tokens and get a place too. Repeated rows are packed as often as they occur. No shuffle:
    every partition packs on its own, container ids hold the partition number.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)  # executors need not have the path
    cells = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()
    out = cells.mapInArrow(
        lambda it: _pack(it, tokenizer, capacity, open_bins),
        f"id {kind}, piece int, piece_start long, n_tokens int, container_id long, place int, container_offset int",
    )
    return out.withColumnRenamed("id", id_col)


def packing_summary(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, fewest, fill): containers used, their tokens, the least possible
    number by volume and the share of capacity in use."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    return out.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * capacity), 4).alias("fill")
    )
