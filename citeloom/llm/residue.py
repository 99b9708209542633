"""Template residue, filler, error pages and script notices.

Labelled exemplars of residue (``residue_exemplars.tsv``, or a file of the caller's, and the
messages of the HTTP status codes) are held in an inverted index over the beginnings of their
words. A document is cut into passage windows (lines and sentences). The index retrieves the
exemplars that share words with a window; the TF-IDF containment of the window is the tf-idf
mass of its words that the best ``JOINED`` exemplars of one label hold over its whole mass.
Windows above a containment count as residue, and a document whose main content is mostly
residue is excluded. Inverse document frequencies are counted over all documents; a word that
no exemplar holds weighs as much as the median word of the exemplars.
"""

from __future__ import annotations

import http
import math
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import spread

# Writings of unfilled slots.
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|[$#]\{[^{}\n]*\}|<%[^%\n]*%>|@@\w+@@|\[\[[^\[\]\n]*\]\]|%\w+%|%[sdSD]\b|\{[A-Za-z][A-Za-z_]{2,}\}|__\w+__|<[A-Za-z_]{3,}>|\b(?:XX+|NNN+|xx{3,})\b|\b0\.XX+\b"
)
SLOT_SIGN = re.compile(r"[{@<]|%\w|\[\[|__|XX|NNN|xxx")
# Page furniture that is not main content.
TAGS = re.compile(r"<title>[^<]*</title>|</?(?:html|head|body|p|div|span|br|h\d|title|main|article|script|noscript)\b[^<>]*>", re.I)
FURNITURE = re.compile(
    r"^[\s\d.:*=-]*(?:Home\s*\|.*|©.*|(?:Keywords?|Mots-clés|Schlagwörter|Palabras clave|Palavras-chave)\s*:.*|(?:Abstract|Methods|Results|Discussion|Introduction|Conclusions?|Résumé|Zusammenfassung|Resumen|Resumo)[\s.:*=-]*)$", re.I
)
AUTHORS = re.compile(r"^(?:(?:[^\W\d_]\.[ -]?){1,4}[^\W\d_]\w*(?:, | and |, and |$))+$")
WINDOW = re.compile(r"\n+|(?<=[.!?])\s+")
WORD = re.compile(r"§|[^\W\d_][^\W_]*")
#: Letters of a word that the index compares, so that inflected forms agree.
STEM = 5
#: Exemplars of one label that together may contain a window.
JOINED = 3
CONTAINED = 0.45
COVERED = 0.6
TABLE = os.path.join(os.path.dirname(__file__), "residue_exemplars.tsv")


def window_words(text: str) -> list[str]:
    """Words of a window whose slots were replaced by ``§``; numbers are left out."""
    return WORD.findall(text.casefold())


def marked_slots(text: str) -> str:
    return SLOT.sub(" § ", text) if SLOT_SIGN.search(text) else text


def read_exemplars(path: str = TABLE) -> list[tuple[str, str]]:
    """(label, text) of a table of label, source and text, with the messages of the HTTP status codes."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    status = [("error", f"HTTP error {s.value} {s.phrase}. {s.description}") for s in http.HTTPStatus if s.value >= 400]
    return [(r[0], r[2]) for r in rows] + status


def stems(words: Iterable[str]) -> set[str]:
    return {w[:STEM] for w in words}


def vocabulary(exemplars: list[tuple[str, str]]) -> frozenset[str]:
    return frozenset().union(*(stems(window_words(SLOT.sub(" § ", t))) for _, t in exemplars)) - {"§"}


def _frequencies(batches: Iterable[pa.RecordBatch], known: frozenset[str]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    find = WORD.findall
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n[""] += 1
            n.update(known.intersection(stems(set(find(text.casefold())))))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["word", "n"])


class ResidueIndex:
    """Inverted index of the exemplars with the idf of the words."""

    def __init__(self, df: dict[str, int], exemplars: list[tuple[str, str]] | None = None, contained: float = CONTAINED, covered: float = COVERED):
        self.exemplars = exemplars or read_exemplars()
        self.threshold, self.covered = contained, covered
        total = max(df.get("", 1), 1)
        self.words = [stems(window_words(SLOT.sub(" § ", t))) for _, t in self.exemplars]
        self.idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 0.05 for w in set().union(*self.words)}
        self.idf["§"] = math.log(total + 1) + 0.05
        ranked = sorted(self.idf.values())
        self.other = ranked[len(ranked) // 2]
        self.postings: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            for w in words:
                self.postings.setdefault(w, []).append(k)
        self.weight = lru_cache(maxsize=500_000)(lambda w: self.idf.get(w[:STEM]))

    def containment(self, words: list[str]) -> tuple[float, int]:
        """(greatest containment in exemplars of one label, the number of the first of them)."""
        tf = Counter(w[:STEM] for w in words)
        mass: Counter = Counter()
        total = 0.0
        for w, n in tf.items():
            idf = self.idf.get(w)
            total += n * (self.other if idf is None else idf)
            for k in self.postings.get(w, ()):
                mass[k] += n * idf
        best, first = 0.0, -1
        ranked: dict[str, list[int]] = {}
        for k, _ in sorted(mass.items(), key=lambda x: (-x[1], x[0])):
            ranked.setdefault(self.exemplars[k][0], []).append(k)
        for ks in ranked.values():
            left, held = dict(tf), 0.0
            for k in ks[:1]:
                held += sum(left.pop(w) * self.idf[w] for w in self.words[k] if w in left)
            for _ in range(JOINED - 1):  # the exemplar that adds most
                gain, k = max(((sum(left[w] * self.idf[w] for w in self.words[k] if w in left), -k) for k in ks), default=(0.0, 0))
                if gain <= 0:
                    break
                held += gain
                for w in self.words[-k]:
                    left.pop(w, None)
            if held > best + 1e-12:
                best, first = held, ks[0]
        return (best / total if total else 0.0), first

    def contained(self, words: list[str]) -> int:
        """The exemplar that contains the window, or -1."""
        total = known = 0.0
        find, other = self.weight, self.other
        for w in words:
            idf = find(w)
            if idf is None:
                total += other
            else:
                known += idf
        total += known
        if known < self.threshold * total:  # not even in all exemplars together
            return -1
        score, k = self.containment(words)
        return k if score >= self.threshold else -1

    def label(self, text: str) -> str | None:
        """The residue label of a document, or none if it has content."""
        lines = [x for x in marked_slots(TAGS.sub("\n", text) if "<" in text else text).split("\n") if x.strip()]
        body = [x for x in lines if not FURNITURE.match(x) and not AUTHORS.match(x.strip())]
        if not body:  # headings and furniture only
            body = lines
        total = len(window_words("\n".join(body)))
        first = [window_words(w) for w in WINDOW.split(body[0])] if body else []
        if len(body) > 1 and any(first) and all(self.contained(w) < 0 for w in first if w):  # a heading line above the rest
            total -= sum(map(len, first))
            body = body[1:]
        bare, allowed = 0, (1 - self.covered) * total
        labels: Counter = Counter()
        for line in body:
            for window in WINDOW.split(line):
                words = window_words(window)
                if not words:
                    continue
                k = self.contained(words)
                if k >= 0:
                    labels[self.exemplars[k][0]] += len(words)
                else:
                    bare += len(words)
                    if bare > allowed:
                        return None
        return labels.most_common(1)[0][0] if labels else None


def _find(batches: Iterable[pa.RecordBatch], df: dict[str, int], exemplars: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    index = ResidueIndex(df, exemplars)
    for batch in batches:
        at, labels = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            label = index.label(text)
            if label:
                at.append(row)
                labels.append(label)
        if at:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(labels)], ["id", "label"])


def residue_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", exemplars: str = TABLE) -> DataFrame:
    """(``id_col``, label): documents whose main content is residue.

    ``label`` is placeholder, filler, error or script. ``exemplars`` is the path of the labelled
    table, read once by the driver. Null and blank texts have no content and no residue: they
    are not reported. Repeated rows are reported as often as they occur.
    """
    known = read_exemplars(exemplars)
    words = vocabulary(known)
    kind = docs.schema[id_col].dataType.simpleString()
    cells = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null and trim(text) <> ''"))
    counted = cells.select("text").mapInArrow(lambda it: _frequencies(it, words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r.word: r.n for r in counted.collect()}  # at most one row per exemplar word
    return cells.mapInArrow(lambda it: _find(it, df, known), f"id {kind}, label string").withColumnRenamed("id", id_col)


def without_residue(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus without residue documents, all columns kept."""
    return docs.join(residue_documents(docs, id_col, text).select(id_col).distinct(), id_col, "left_anti")
