"""Text garbled by a wrong character encoding: best-first search for the original.

A cell is cut into stretches of non-ASCII characters (and character references). From a
stretch the search follows encode, decode and unescape steps, cheapest text first, with a set
of visited texts; the cost is low for characters that fit their neighbours and high for
controls, box drawing, lone symbols inside words and letters of a foreign script in a word.
The cheapest reachable text replaces the stretch if it is clearly cheaper.

Text moved between two single-byte code pages leaves no such stretches, only letters and signs
that do not fit their words. For these the search takes every ordered pair of code pages as one
step for all words of the cell, and judges by word context: letter case, signs inside words,
mixed scripts, and how often a letter stands between its neighbours in the whole column.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8-bit and multi-byte encodings that UTF-8 text is commonly misread in.
CODECS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "koi8_r", "gb18030", "big5", "shift_jis"]
#: Encodings as which single-byte Western text is misread.
WESTERN_AS = ["cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1253"]
#: Cells of plain ASCII without a character reference cannot be garbled and stay in the JVM.
SUSPECT = r"[^\x00-\x7F]|&#?\w{2,8};"
STRETCH = re.compile(r"(?:[^\x00-\x7f]|&#?\w{2,8};)+")
COMMON = set("“”‘’–—…°±µ×≥≤βαγδλμσπ√¿¡«»·•„≈≠∞²³½€£§©®™")
#: A lead byte and a continuation byte of UTF-8 as they look in Western code pages.
PAIR = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc]")
#: Characters as which a lead byte of UTF-8 appears in the common encodings.
LEADS = {bytes([b]).decode(c, "ignore") for b in range(0xC2, 0xF5) for c in CODECS[:7]} - {""}
MARGIN = 0.5
LOST = "�"


@lru_cache(maxsize=65_536)
def _group(ch: str) -> str:
    """A coarse kind of a character."""
    if ch < "\x80":
        return "w" if ch.isalpha() else "a"
    o = ord(ch)
    if ch == LOST or 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900:
        return "x"
    if 0x2500 <= o < 0x25A0:
        return "b"
    cat = unicodedata.category(ch)
    if cat[0] == "L" and ch not in "ªºµ":
        if o < 0x180 or 0x1E00 <= o < 0x1F00:
            return "W"
        if 0x370 <= o < 0x400:
            return "G"
        if 0x400 <= o < 0x530:
            return "C"
        if 0x3040 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0:
            return "H"
        return "o"
    if cat[0] == "M" or cat in ("Cf", "Cn", "Co", "Sk"):
        return "m"
    return "p" if ch in COMMON else "s"


def cost(text: str, before: str, after: str) -> float:
    """Cost of ``text`` between the characters ``before`` and ``after``."""
    total = 0.0
    last = before[-1:] or " "
    for i, ch in enumerate(text):
        g = _group(ch)
        nxt = text[i + 1] if i + 1 < len(text) else (after[:1] or " ")
        lg, ng = _group(last), _group(nxt)
        if g in "aw":
            total += 0.0 if ch.isalnum() or ch == " " else 1.5
        elif g == "W":
            total += 1.0
            if ch.isupper() and last.islower():
                total += 1.5
            if o_rare(ch):
                total += 0.5
        elif g == "p":
            total += 1.0
            if ch in "©®™§°±²³½£µ¡¿«" and lg in "wW" and last.isalpha():
                total += 1.5
            if ch in "„“‘–—…•" and lg in "wW" and ng in "wW":
                total += 0.5
        elif g in "GCH":
            total += 1.0
            if lg in "wW" or ng in "wW":
                total += 2.0
        elif g == "s":
            total += 2.0
        elif g == "m":
            total += 3.0
        elif g == "o":
            total += 2.5
        elif g == "b":
            total += 4.0
        else:
            total += 5.0
        last = ch
    return total


def o_rare(ch: str) -> bool:
    return ord(ch) >= 0x180


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257"):
            return None
    out = bytearray()  # bytes without a character in the code page were kept as controls
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if ord(ch) > 0xFF:
                return None
            out.append(ord(ch))
    return bytes(out)


def neighbours(text: str) -> Iterator[tuple[str, float]]:
    """Texts one step away with the step's cost: encode in one character set and decode in
    another, or unescape. Rarer mistakes cost more."""
    if "&" in text:
        t = html.unescape(text)
        if t != text:
            yield t, 0.0
    for k, codec in enumerate(CODECS):
        raw = _encode(text, codec)
        if raw is None:
            continue
        try:
            yield raw.decode("utf-8").replace("\ufeff", ""), 0.02 * k
        except UnicodeDecodeError:
            pass
    if any(_group(ch) in "CGsbp" or ch.isupper() for ch in text):
        for k, codec in enumerate(WESTERN_AS):
            raw = _encode(text, codec)
            if raw is not None and len(raw) == len(text):
                try:
                    yield raw.decode("cp1252"), 0.6 + 0.05 * k
                except UnicodeDecodeError:
                    pass


def search(text: str, before: str, after: str, most: int = 40) -> str:
    """Best-first search from ``text``; ``most`` bounds the texts that are expanded."""
    return _search_cached(text, before, after, most) if len(text) <= 16 else _search(text, before, after, most)


def _search(text: str, before: str, after: str, most: int) -> str:
    start = cost(text, before, after)
    best, best_cost = text, start
    heap = [(start, 0.0, text)]
    seen = {text}
    while heap and most:
        c, steps, t = heapq.heappop(heap)
        most -= 1
        if c < best_cost and c < start - MARGIN:
            best, best_cost = t, c
        for n, step in neighbours(t):
            if n not in seen:
                seen.add(n)
                heapq.heappush(heap, (cost(n, before, after) + steps + step, steps + step, n))
    return best


_search_cached = lru_cache(maxsize=100_000)(_search)


#: Single-byte code pages among which text is taken for one another.
PAGES = ["cp1252", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "koi8_r", "cp1253"]
#: Letters and signs by their use.
WESTERN = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ")
FREQUENT = set("éèàçãõöäüßñóíáúêôåøæ")
CENTRAL = set("ąćčďđęěğıłľĺńňőřŕśšşșťțůűźžżăâîýÿ")
RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
SLAVIC_VOWELS = set("аеёиоуыэюяіїє")
OPENING, CLOSING, JOINING = set("“‘«„‚¿¡‹"), set("”’»“‘…›"), set("’–—‐‑")
NUMBERLIKE = set("°²³¹ªº£€¥¢±×÷≥≤≠≈‰½¼¾µ√∞")
MARKS = set("©®™†‡•§¶")
WORDS = re.compile(r"\S+")
#: Cost above which a cell is looked at, and gain from which a code-page step is taken.
GAIN = 2.0


def _decoded(page: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)  # kept as a control


def _page_steps() -> list[tuple[str, str, dict[int, str]]]:
    """(true page, page it was read in, character table) for every ordered pair of code pages."""
    sets = {p: [_decoded(p, b) for b in range(0x80, 0x100)] for p in PAGES}
    out = []
    for true in PAGES:
        for read in PAGES:
            if true != read:
                out.append((true, read, {ord(r): t for t, r in zip(sets[true], sets[read], strict=True) if t != r}))
    return out


STEPS = _page_steps()
#: Characters that stand for one another in two code pages.
ALIKE: dict[str, set[str]] = {}
for _, _, _chars in STEPS:
    for _r, _t in _chars.items():
        ALIKE.setdefault(chr(_r), set()).add(_t)


def letter_cost(ch: str, a: str, b: str) -> float:
    """Cost of a non-ASCII letter between ``a`` and ``b``."""
    kind = _group(ch)
    low = ch.lower()
    total = 0.0
    if ch.isupper() and a.islower():
        total += 3.0
    elif a.isupper() and (b.islower() if ch.isupper() else b.isupper()):
        total += 1.0
    if kind == "W":
        total += 0.2 if low in FREQUENT else 0.22 if low in WESTERN else 0.3 if low in CENTRAL else 1.0
        if _group(a) == "W" and ord(a) >= 0x80:
            total += 0.2
    elif kind == "C":
        total += 0.1 if low in RUSSIAN else 0.8
    elif kind == "G":
        total += 0.3
    elif kind == "H":
        total += 0.3
    else:
        total += 0.5 if "\ufb00" <= ch <= "\ufb06" else 1.5
    return total


def sign_cost(ch: str, a: str, b: str) -> float:
    """Cost of a non-ASCII sign between ``a`` and ``b``."""
    left, right = a.isalpha(), b.isalpha()
    kind = _group(ch)
    if kind in "xb":
        return 4.0
    if unicodedata.category(ch)[0] == "M":  # a combining mark belongs on a letter
        return 0.1 if left else 2.0
    if ch.isspace():
        return 2.5 if left and right else 0.1
    if "\u3000" <= ch <= "\u303f" or "\uff00" <= ch <= "\uff65":  # full-width punctuation
        return 0.3
    if a >= "\x80" and not left and not a.isspace():  # signs in a row
        return 1.0 + sign_cost(ch, " ", b)
    if left and right:
        return 0.2 if ch in JOINING or ch == "·" and a in "lL" and b in "lL" else 1.0 if ch == "×" else 2.5
    if ch in CLOSING and not right or ch in OPENING and not left:
        return 0.2
    if ch in OPENING or ch in CLOSING:
        return 2.5
    if ch in NUMBERLIKE:
        if left and ch in "°²³¹ªº":
            return 0.2 if ch != "°" or a in "nN" else 2.0
        if ch == "µ":
            return 2.0 if left else 0.2
        return 1.2 if left or right and ch in "£€¥¢½¼¾" else 0.3
    if ch in MARKS:
        return 0.8 if left and ch in "†‡•§¶" else 0.3
    if ch in JOINING:
        return 0.3
    if ch in "¨´¸¯ˆ˜¬¦¤":
        return 2.5 if left or right else 1.0
    return 2.0 if left or right else 0.5


class Context:
    """Judges words; ``seen`` counts (before, letter, after) of non-ASCII letters in the column."""

    def __init__(self, seen: dict[str, int] | None = None):
        self.seen = seen or {}
        self.word = lru_cache(maxsize=200_000)(self._word)
        self.odd = lru_cache(maxsize=200_000)(self._odd)

    def _word(self, w: str) -> float:
        total = 0.0
        foreign = plain = latin = 0
        scripts: Counter = Counter()
        for i, ch in enumerate(w):
            if ch < "\x80":
                plain += ch.isalpha()
                continue
            a, b = w[i - 1] if i else " ", w[i + 1] if i + 1 < len(w) else " "
            kind = _group(ch)
            if kind in "WGCHo":
                foreign += 1
                scripts[kind] += 1
                latin += kind == "W"
                total += letter_cost(ch, a, b)
            else:
                total += sign_cost(ch, a, b)
        if plain + latin and scripts["C"]:
            total += 2.5 * min(scripts["C"], plain + latin)
        if plain + latin and scripts["G"] > 1:
            total += 1.5 * scripts["G"]
        if scripts["C"] > 2 and not SLAVIC_VOWELS & set(w.lower()):
            total += 2.0
        if latin > 2 and 3 * plain < latin:  # hardly any plain letter in a Latin word
            total += 1.0 * latin
        return total

    def usual(self, w: str, t: str) -> float:
        """How much more usual the letters of ``t`` are in their places in the column than those of ``w``.

        Only places at which both have a Latin letter count. Positive only if each new letter is
        well known in its place and the old one hardly ever stands there.
        """
        new, old = dict(places(t)), dict(places(w))
        both = [(self.seen.get(new[i], 0), self.seen.get(old[i], 0)) for i in new.keys() & old.keys() if new[i][1] != old[i][1]]
        diff = sum(math.log((n + 1) / (o + 1)) for n, o in both)
        if both and all(n >= 50 and 30 * o <= n for n, o in both):
            return 0.6 * diff
        return min(0.0, 0.3 * diff)

    def cost(self, cell: str) -> float:
        return sum(self.word(w) for w in marked_words(cell))

    def moved(self, cell: str) -> tuple[str, float]:
        """(text by the best code-page step, gain); the cell itself with gain 0 if none is clear."""
        words = tuple(dict.fromkeys(marked_words(cell)))
        table, gain = self._moved(words)
        if not table:
            return cell, 0.0
        return WORDS.sub(lambda m: table.get(m.group(), m.group()), cell), gain

    def _moved(self, words: tuple[str, ...]) -> tuple[dict[str, str], float]:
        odd = [w for w in words if self.odd(w)]
        if not odd:
            return {}, 0.0
        best: tuple[float, int] = (GAIN, -1)
        for k, (_, _, chars) in enumerate(STEPS):
            gain = sum(max(0.0, self._gain(w, w.translate(chars))) for w in odd) - 0.001 * k
            if gain > best[0]:
                best = (gain, k)
        if best[1] < 0:
            return {}, 0.0
        chars = STEPS[best[1]][2]
        moved = {w: w.translate(chars) for w in words}
        return {w: t for w, t in moved.items() if t != w and self._gain(w, t) > -0.5}, best[0]  # words that fit either way went the same way

    def _gain(self, w: str, t: str) -> float:
        if t == w:
            return 0.0
        g = self.word(w) - self.word(t) - 0.2
        return g + self.usual(w, t) if self.seen and g > -1.0 and len(t) == len(w) else g

    def _odd(self, w: str) -> bool:
        """Whether a word costs more than its letters alone, or a letter beyond the Western ones
        stands where it hardly ever does and another one that it may be taken for is well known."""
        if self.word(w) - 0.3 * sum(ch >= "\x80" for ch in w) >= 0.7:
            return True
        for _, k in places(w) if self.seen else ():
            n = self.seen.get(k, 0)
            if n < 8 and k[1] not in WESTERN and any(self.seen.get(k[0] + x + k[2], 0) >= max(50, 30 * n) for x in ALIKE.get(k[1], ())):
                return True
        return False


def marked_words(cell: str) -> list[str]:
    """Words with a character beyond ASCII."""
    return [w for w in cell.split() if not w.isascii()]


def places(w: str) -> list[tuple[int, str]]:
    """(position, before + letter + after) of each non-ASCII Latin small letter of a word."""
    out = []
    for i, ch in enumerate(w):
        if ch >= "\x80" and ch.islower() and _group(ch) == "W":
            a, b = w[i - 1].lower() if i else " ", w[i + 1].lower() if i + 1 < len(w) else " "
            out.append((i, (a if a.isalpha() else " ") + ch + (b if b.isalpha() else " ")))
    return out


PLAIN = Context()


def repair(cell: str, context: Context = PLAIN) -> tuple[bool, str, bool]:
    """(garbled, text with what could be restored, everything restored)."""
    changed, lost, text = _repair_stretches(cell)
    moved, gain = context.moved(cell)
    if changed and gain:  # both ways lead somewhere: the text that fits better
        if context.cost(moved) < context.cost(text) - 0.3:
            text = moved
    elif gain:
        text, changed = moved, True
        lost = LOST in text or any("\x80" <= ch < "\xa0" for ch in text)
    if not changed:
        return lost, text, False
    rest = any(context.word(w) >= 1.2 for w in marked_words(text))
    return True, text, not lost and not rest


def _repair_stretches(cell: str) -> tuple[bool, bool, str]:
    """(changed, characters lost, text) by searches from each stretch."""
    changed, lost = False, False
    out: list[str] = []
    at = 0
    for m in STRETCH.finditer(cell):
        s = m.group()
        out.append(cell[at : m.start()])
        at = m.end()
        fixed = s
        if len(s) > 1 or _group(s) in "HCGobx":
            fixed = search(s, cell[max(0, m.start() - 1) : m.start()], cell[at : at + 1])
            if fixed == s and len(s) > 2:
                fixed = _parts(s, cell[max(0, m.start() - 1) : m.start()], cell[at : at + 1])
        if fixed != s and fixed != html.unescape(s):  # a character reference alone is no wrong decoding
            changed = True
        if LOST in fixed or any("\x80" <= ch < "\xa0" for ch in fixed):
            lost = True
        out.append(fixed)
    out.append(cell[at:])
    return changed, lost, "".join(out)


def _parts(s: str, before: str, after: str) -> str:
    """A stretch that is garbled in part: the cheapest cover by repaired pieces."""
    n = len(s)
    best = [0.0] + [float("inf")] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - 12), j):
            piece = s[i:j]
            b = s[i - 1] if i else before
            a = s[j] if j < n else after
            options = [piece] if j - i == 1 else []
            if j - i > 1 and piece[0] in LEADS:
                f = search(piece, b, a, 6)
                if f != piece and all(_group(ch) in "Wp" for ch in f):
                    options.append(f)
            for o in options:
                c = best[i] + cost(o, b, a) + (0.3 if o != piece else 0.0)
                if c < best[j]:
                    best[j], back[j] = c, (i, o)
    out, j = [], n
    while j:
        i, o = back[j]
        out.append(o)
        j = i
    fixed = "".join(reversed(out))
    if PAIR.search(fixed):  # what is left looks like the same mistake but cannot be undone
        return s
    return fixed if cost(fixed, before, after) < cost(s, before, after) - 1.0 else s


def _mend(batches: Iterable[pa.RecordBatch], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
    context = Context(seen)
    for batch in batches:
        at, texts, whole = [], [], []
        for row, cell in enumerate(batch.column(2).to_pylist()):
            garbled, text, full = repair(cell, context)
            if garbled:
                at.append(row)
                texts.append(text)
                whole.append(full)
        if at:
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(idx), batch.column(1).take(idx), pa.array(texts), pa.array(whole)], ["id", "field_name", "restored", "complete"]
            )


def letter_places(cells: DataFrame) -> dict[str, int]:
    """How often each non-ASCII Latin letter stands between its neighbours, over all cells.

    Counted in the JVM; at most one row per letter and pair of neighbours comes to the driver.
    """
    plain = F.regexp_replace(F.concat(F.lit(" "), F.lower("cell"), F.lit(" ")), r"[^\p{L}]", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?=(.[\u00df-\u024f&&[^\u00f7]].))."), F.lit(1))
    counted = cells.select(F.explode(found).alias("k")).filter("length(k) = 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return {r.k: r.n for r in counted.collect()}


def garbled_cells(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(``id_col``, field_name, restored, complete): the cells with garbled text.

    ``restored`` has the original where it can be had; ``complete`` is false where characters
    were lost for good or what was restored still holds odd words. Null and plain cells are not
    looked at beyond one pattern. Repeated rows are reported as often as they occur.
    """
    kind = df.schema[id_col].dataType.simpleString()
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])).alias("c"))
    suspect = cells.select("id", "c.field_name", "c.cell").filter(F.col("cell").rlike(SUSPECT))
    seen = letter_places(suspect)
    out = suspect.mapInArrow(lambda it: _mend(it, seen), f"id {kind}, field_name string, restored string, complete boolean")
    return out.withColumnRenamed("id", id_col)
