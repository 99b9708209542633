"""Cells that pack several values: one row per value with its position.

Method: expectation-maximisation segmentation with Viterbi lattices.

A cell is scanned into parts and delimiters. Quoted spans and ``[...]`` spans are atomic.
Strong delimiters (``;`` with white space, ``|``, tab, line break, bullets, full-width
semicolon) are fixed nodes of the lattice; weak ones (comma, ``and``, ``&``, spaced ``/``,
a tight ``;``) are nodes that may be cut or lie inside a value.

Two models are learned by EM from the whole column:

* a chain over part classes (initials, year, capitalised word, ...): start, end and
  continuation probabilities and the use of each delimiter. Its sufficient statistics are
  counts of (class, delimiter, class), a table bounded by the class alphabet, so one
  aggregation over all rows feeds every iteration;
* the frequency of each value. It is looked up by a join, never collected, and only for the
  spans of cells that the first model leaves undecided. Expected counts of these spans are
  added in each round.

Cells that the class chain decides are split in the scan; the others go through the value
lattice, where the Viterbi path maximises the product of the two models.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, term_key
from citeloom.session import materialize, spread

WS = " \t\r\n　"
#: Delimiters: strong ones, the comma, words and signs between spaces, the tight semicolon.
STRONG = rf";(?=[{WS};|]|$)|(?<=[{WS};|]);|[；|\t\r\n]|(?<=[{WS}])[•·](?=[{WS}])"
WEAK = rf"(?P<c>,)|(?P<w>(?<=[{WS}])(?:and|&|/)(?=[{WS}]))|(?P<t>;)"
CUTS = re.compile(STRONG)
RARE_CUT = re.compile(r"[；|\t\r\n•·]")
BRACKET_CUTS = re.compile(rf"\[[^\]]*\]|({STRONG})")
BRACKET_WEAK = re.compile(rf"\[[^\]]*\]|{WEAK}")
#: Cells with more brackets are scanned step by step.
FEW = 200
CUT_SCAN = re.compile(rf'(?P<q>")|(?P<b>\[)|(?P<s>{STRONG})|(?P<w>,|(?<=[{WS}])(?:and|&|/)(?=[{WS}])|;)')
SCAN = re.compile(rf'(?P<q>")|(?P<b>\[)|{WEAK}')
WEAK_CUT = re.compile(WEAK)
WEAK_KINDS = (None, ",", "", "t")  # by group
QUOTED = re.compile(rf'"(?:[^"]|"")*+"(?=[{WS}]*+(?:$|[;；|•·,/]|(?:and|&)[{WS}]))')
QUOTE_WHOLE = re.compile(r'"(?:[^"]|"")*+"')
LETTERS = r"(?:[^\W\d_](?:\.[ -]?|[ -]|$)){1,4}"
INITIALS = re.compile(rf"{LETTERS}|[A-Z]{{2,3}}")
LEADING = re.compile(r"(?:[^\W\d_]\.[ -]?){1,4} ?[^\W\d_]{2,}|(?:[^\W\d_] ){1,3}[^\W\d_]{2,}")
TRAILING = re.compile(rf"[^\W\d_]{{2,}}[^\d]*? {LETTERS}|[^\W\d_]\w*[^\W\d_A-Z]\w* [A-Z]{{2,3}}")
VOLUME = re.compile(r"[VP]\d+")
DECIDED = 1e-4
LONG_PART = 200
#: A value holds at most so many delimiters that the chain leaves undecided.
MAX_OPEN = 12
OWN = 2.0
RARE = 3e-4
FLOOR = 1e-12


def part_class(part: str) -> str:
    """A class from a small fixed alphabet; long parts are classed by their first character."""
    head = part[0]
    if len(part) > LONG_PART and head not in '"[':
        return "L" if head.islower() else "W"
    if head == '"':
        return "Q"
    if head == "[":
        return "B"
    if head.isdigit():
        return "Y" if len(part) == 4 and part.isdigit() else "N"
    if part.startswith("DOI "):
        return "D"
    if VOLUME.fullmatch(part):
        return "V"
    if INITIALS.fullmatch(part):
        return "I"
    if LEADING.fullmatch(part):
        return "G"
    if TRAILING.fullmatch(part):
        return "H"
    if any(ch.isdigit() for ch in part):
        return "M"
    if not head.islower() and " " not in part:
        return "T"
    if part.isupper():
        return "U"
    if head.isupper():
        return "W"
    return "L"


_classes: dict[str, str] = {}


def classed(part: str) -> str:
    if len(part) > LONG_PART:
        return part_class(part)
    c = _classes.get(part)
    if c is None:
        if len(_classes) > 200_000:
            _classes.clear()
        c = _classes[part] = part_class(part)
    return c


def _past_atom(text: str, m: re.Match, start: int, closing: int) -> int:
    """Where to go on after a quotation mark or bracket: behind the atom if it is one."""
    if m.lastgroup == "b":
        return text.find("]", m.start()) + 1 if m.start() < closing else m.end()
    q = None if text[start : m.start()].strip(WS) else QUOTED.match(text, m.start())
    return q.end() if q else m.end()  # else a quotation mark inside a value


def strong_pieces(cell: str) -> list[str]:
    """The cell cut at its strong delimiters, quoted and bracketed spans kept whole."""
    if '"' not in cell:
        if "[" not in cell:
            if RARE_CUT.search(cell):
                return CUTS.split(cell)
            pieces = cell.split("; ")  # the common delimiter first, what is left by pattern
            if cell.count(";") == len(pieces) - 1:
                return pieces
            return [x for p in pieces for x in (CUTS.split(p) if ";" in p else (p,))]
        if cell.count("[") <= FEW:
            out, start = [], 0
            for m in BRACKET_CUTS.finditer(cell):
                if m.lastindex:
                    a, b = m.span()
                    out.append(cell[start:a])
                    start = b
            out.append(cell[start:])
            return out
    out: list[str] = []
    start = part = at = 0
    closing = cell.rfind("]")
    while m := CUT_SCAN.search(cell, at):
        k = m.lastgroup
        if k in "qb":
            at = _past_atom(cell, m, part, closing)
        else:
            part = at = m.end()
            if k == "s":
                out.append(cell[start : m.start()])
                start = at
    out.append(cell[start:])
    return out


Run = tuple[list[str], list[str], list[tuple[int, int]]]


def parse_run(run: str) -> Run:
    """(parts, kinds of the weak delimiters between them, places of the parts)."""
    parts: list[str] = []
    kinds: list[str] = []
    places: list[tuple[int, int]] = []
    if '"' not in run and run.count("[") <= FEW:
        start, pending = 0, ""
        for m in (BRACKET_WEAK if "[" in run else WEAK_CUT).finditer(run):
            if not m.lastindex:
                continue
            a, b = m.span()
            if p := run[start:a].strip(WS):
                if parts:
                    kinds.append(pending)
                pending = ""
                start += run[start:a].index(p[0]) if run[start] != p[0] else 0
                parts.append(p)
                places.append((start, start + len(p)))
            start = b
            if not pending:
                pending = WEAK_KINDS[m.lastindex] or m.group()
        if p := run[start:].strip(WS):
            if parts:
                kinds.append(pending)
            start = run.index(p[0], start)
            parts.append(p)
            places.append((start, start + len(p)))
        return parts, kinds, places
    pending, start, at, closing = "", 0, 0, run.rfind("]")
    while True:
        m = SCAN.search(run, at)
        k = m.lastgroup if m else ""
        if m and k in "qb":
            at = _past_atom(run, m, start, closing)
            continue
        end = m.start() if m else len(run)
        piece = run[start:end]
        p = piece.strip(WS)
        if p:
            if parts:
                kinds.append(pending)
            parts.append(p)
            a = start + len(piece) - len(piece.lstrip(WS))
            places.append((a, a + len(p)))
            pending = ""
        if not m:
            return parts, kinds, places
        pending = pending or ("," if k == "c" else m.group() if k == "w" else "t")
        start = at = m.end()


def run_texts(cell: str) -> tuple[list[str], str]:
    """Runs between strong delimiters, and the mark that kinds carry in a cell without any."""
    pieces = strong_pieces(cell)
    return [p for x in pieces if (p := x.strip(WS))], "" if len(pieces) > 1 else "o"


def runs_of(cell: str) -> list[tuple[str, Run]]:
    """Non-empty runs of a cell with their parts."""
    texts, mark = run_texts(cell)
    out = []
    for t in texts:
        parts, kinds, places = parse_run(t)
        if parts:
            out.append((t, (parts, [k + mark for k in kinds], places)))
    return out


class Memo(dict):
    """A bounded memory of short strings."""

    def keep(self, key, value):
        if len(key[0]) <= LONG_PART:
            if len(self) > 100_000:
                self.clear()
            self[key] = value
        return value


def clean_value(value: str) -> str:
    if len(value) > 1 and value[0] == '"' and value[-1] == '"' and QUOTE_WHOLE.fullmatch(value):
        return value[1:-1].replace('""', '"').strip(WS)
    return value


def learn_chain(stats: dict[tuple[str, str, str, str], int], rounds: int = 30) -> dict[str, dict]:
    """EM over the counts of (class, delimiter, class); ``^`` and ``$`` mark run ends.

    Scores of a delimiter d between classes c and n:
    cut = end(c) use(d | c) next_start(n | c); join = (1 - end(c)) inside(n | c) join_use(d | c).
    Given the classes the hidden cuts are independent, so the E-step is one quotient per entry.
    Continuations start from cells that have a strong delimiter, where weak ones are mostly
    inside values.
    """
    model: dict[str, dict] = {}
    for field in {f for f, *_ in stats}:
        own = {(c, d, e): n for (f, c, d, e), n in stats.items() if f == field}
        inner = {k: n for k, n in own.items() if k[1] not in ("", "s")}
        starts = Counter({e: n for (c, d, e), n in own.items() if c == "^"})
        ends = Counter({c: n for (c, d, e), n in own.items() if e == "$"})
        across = Counter({(c, e): n for (c, d, e), n in own.items() if d == "s"})
        cut = {(c, d, n): 0.1 if d == "," else 0.5 for (c, d, n) in inner}
        first = True
        m: dict = {}
        for _ in range(rounds):
            s, e, u, x = Counter(starts), Counter(ends), Counter(), Counter(across)
            leave, into, ju = Counter(), Counter(), Counter()
            for (c, d, n), q in cut.items():
                w = inner[c, d, n]
                s[n] += w * q
                e[c] += w * q
                u[c, d] += w * q
                x[c, n] += w * q
                if not (first and d.endswith("o")):
                    leave[c] += w * (1 - q)
                    into[c, n] += w * (1 - q)
                ju[c, d] += w * (1 - q)
            first = False
            total = sum(s.values()) or 1
            start = {c: n / total for c, n in s.items()}
            end = {c: n / (n + leave[c]) for c, n in e.items()}
            use = {(c, d): n / e[c] for (c, d), n in u.items() if n}
            joins = Counter()
            for (c, _d), w in ju.items():
                joins[c] += w
            out = Counter()
            for (c, _n), w in x.items():
                out[c] += w
            m = {
                "start": start,
                "end": end,
                "use": use,
                "across": {(c, n): w / out[c] for (c, n), w in x.items()},
                "inside": {(c, n): w / leave[c] for (c, n), w in into.items() if w},
                "join_use": {(c, d): w / joins[c] for (c, d), w in ju.items() if w},
            }
            runs = sum(starts.values()) or 1
            for k in inner:
                a, b = _cut_score(m, *k), _join_score(m, *k)
                if starts[k[2]] < RARE * runs or ends[k[0]] < RARE * runs:  # classes that do not begin or end values
                    a = 0.0
                cut[k] = (a + FLOOR) / (a + b + 2 * FLOOR)
        model[field] = m | {"cut": cut}
    return model


def _cut_score(m: dict, c: str, d: str, n: str) -> float:
    return m["end"].get(c, 0) * m["use"].get((c, d), 0) * (0.99 * m["across"].get((c, n), 0) + 0.01 * m["start"].get(n, 0))


def _join_score(m: dict, c: str, d: str, n: str) -> float:
    return (1 - m["end"].get(c, 0)) * m["inside"].get((c, n), 0) * m["join_use"].get((c, d), 0)


def _shape(run: str, mark: str) -> tuple[tuple[str, str, str], ...]:
    """(class, kind, class) of a run, from ``^`` to ``$``; empty if it has no part."""
    parts, kinds, _ = parse_run(run)
    if not parts:
        return ()
    cls = [classed(p) for p in parts]
    return (("^", "", cls[0]), *((a, k + mark, b) for a, k, b in zip(cls, kinds, cls[1:])), (cls[-1], "", "$"))


def _stats_of(batches: Iterable[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    shapes: Counter = Counter()
    across: Counter = Counter()
    memo = Memo()
    for batch in batches:
        for f in fields:
            for cell in batch.column(f).to_pylist():
                if cell is None:
                    continue
                texts, mark = run_texts(cell)
                last = ""
                for t in texts:
                    key = (t, mark)
                    shape = memo.get(key)
                    if shape is None:
                        shape = memo.keep(key, _shape(t, mark))
                    if shape:
                        shapes[f, shape] += 1
                        if last:
                            across[f, last, "s", shape[0][2]] += 1
                        last = shape[-1][0]
        if len(shapes) > 50_000:
            yield _tally(shapes, across)
            shapes, across = Counter(), Counter()
    if shapes:
        yield _tally(shapes, across)


def _tally(shapes: Counter, across: Counter) -> pa.RecordBatch:
    n = across
    for (f, shape), k in shapes.items():
        for c, d, e in shape:
            n[f, c, d, e] += k
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys]) for i in range(4)] + [pa.array([n[k] for k in keys], pa.int64())], ["f", "c", "d", "e", "n"])


def _decide(model: dict[str, dict], field: str) -> dict[tuple[str, str, str], int]:
    """1: cut, 0: join, 2: left to the value lattice. A quoted span is a whole value."""
    return {
        k: 1 if "Q" in (k[0], k[2]) or q > 1 - DECIDED else 0 if q < DECIDED else 2
        for k, q in model.get(field, {"cut": {}})["cut"].items()
    }


def _values(run: str, mark: str, rule: dict[tuple[str, str, str], int]) -> tuple[str, ...] | str:
    """The values of a run, or ``?`` if the class chain leaves a cut undecided."""
    parts, kinds, places = parse_run(run)
    if not parts:
        return ()
    out: list[str] = []
    last, begin = classed(parts[0]), places[0][0]
    for i, k in enumerate(kinds, 1):
        c = classed(parts[i])
        what = rule.get((last, k + mark, c), 2)
        if what == 2:
            return "?"
        if what == 1:
            out.append(clean_value(run[begin : places[i - 1][1]]))
            begin = places[i][0]
        last = c
    out.append(clean_value(run[begin : places[-1][1]]))
    return tuple(out)


def _segment(batches: Iterable[pa.RecordBatch], fields: list[str], model: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    rules = [_decide(model, f) for f in fields]
    memos = [Memo() for _ in fields]
    ctx = TaskContext.get()
    uid = (ctx.partitionId() if ctx else 0) << 40
    for batch in batches:
        ids = batch.column("id")
        at: list[int] = []
        fs: list[int] = []
        pos: list[int] = []
        items: list[str] = []
        uids: list[int | None] = []
        for fi, f in enumerate(fields):
            rule, memo = rules[fi], memos[fi]
            for row, cell in enumerate(batch.column(f).to_pylist()):
                if cell is None:
                    continue
                values: list[str] = []
                texts, mark = run_texts(cell)
                for t in texts:
                    key = (t, mark)
                    own = memo.get(key)
                    if own is None:
                        own = memo.keep(key, _values(t, mark, rule))
                    if own == "?":
                        break
                    values += own
                else:
                    n = 0
                    for v in values:
                        if v:
                            n += 1
                            items.append(v)
                            pos.append(n)
                    at += [row] * n
                    fs += [fi] * n
                    uids += [None] * n
                    continue
                uid += 1
                at.append(row)
                fs.append(fi)
                pos.append(0)
                items.append(cell)
                uids.append(uid)
        if at:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(fs, pa.int8()), pa.array(pos, pa.int32()), pa.array(items), pa.array(uids, pa.int64())],
                ["id", "f", "pos", "item", "uid"],
            )


def span_text(run: str, places: list[tuple[int, int]], i: int, j: int) -> str:
    return clean_value(run[places[i][0] : places[j][1]])


def allowed_spans(parts: list[str], kinds: list[str], rule: dict) -> Iterator[tuple[int, int]]:
    """Spans that cross no sure cut and end at no sure join.

    Beyond ``MAX_OPEN`` undecided delimiters only the whole stretch between two sure cuts is a
    span, so that a long value is found too while the edges stay in proportion to the cell.
    """
    n = len(parts)
    cls = [classed(p) for p in parts]
    what = [rule.get((cls[k], kinds[k], cls[k + 1]), 2) for k in range(n - 1)]
    for i in range(n):
        if i and what[i - 1] == 0:
            continue
        undecided = 0
        whole = i == 0 or what[i - 1] == 1
        for j in range(i, n):
            if j > i and what[j - 1] == 1:
                break
            undecided += j > i and what[j - 1] == 2
            if undecided > MAX_OPEN and not whole:
                break
            if j < n - 1 and (what[j] == 0 or undecided > MAX_OPEN and what[j] != 1):
                continue
            yield i, j


def _spans(batches: Iterable[pa.RecordBatch], fields: list[str], model: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    rules = {f: _decide(model, f) for f in fields}
    for batch in batches:
        rows: list[tuple] = []
        for uid, fi, cell in zip(*(batch.column(c).to_pylist() for c in ("uid", "f", "item"))):
            f = fields[fi]
            for r, (text, (parts, kinds, places)) in enumerate(runs_of(cell)):
                for i, j in allowed_spans(parts, kinds, rules[f]):
                    rows.append((uid, fi, r, i, j, span_text(text, places, i, j)))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8())] + [pa.array(c, pa.int32()) for c in cols[2:5]] + [pa.array(cols[5])],
                ["uid", "f", "r", "i", "j", "item"],
            )


def _log(p: float) -> float:
    return math.log(max(p, FLOOR))


def lattice(parts: list[str], kinds: list[str], chain: dict, rule: dict, freq: dict[tuple[int, int], float], total: float):
    """Edges of a run's lattice: {(i, j): log P(value) + log P(cut delimiter)}."""
    cls = [classed(p) for p in parts]
    unit = -math.log(max(total, 100.0))
    edges = {}
    for i, j in allowed_spans(parts, kinds, rule):
        base = chain["start"].get(cls[i], 0) if i == 0 else 0.99 * chain["across"].get((cls[i - 1], cls[i]), 0) + 0.01 * chain["start"].get(cls[i], 0)
        logp = _log(base) + _log(chain["end"].get(cls[j], 0)) + (j - i + 1) * unit
        for k in range(i, j):
            logp += _log(_join_score(chain, cls[k], kinds[k], cls[k + 1]))
        seen = freq.get((i, j), 0.0)
        if j > i:  # a longer span must be met elsewhere too, not only here
            seen = max(0.0, seen - OWN)
        if seen:
            known = math.log(seen / max(total, 1.0))
            logp = max(logp, known) + math.log1p(math.exp(-abs(logp - known)))
        if j < len(parts) - 1:
            logp += _log(chain["use"].get((cls[j], kinds[j]), 0))
        edges[i, j] = logp
    return edges


def viterbi(n: int, edges: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    best: list[float] = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for (i, j), w in sorted(edges.items()):
        if best[i] + w > best[j + 1]:
            best[j + 1] = best[i] + w
            back[j + 1] = i
    path, at = [], n
    while at:
        path.append((back[at], at - 1))
        at = back[at]
    return path[::-1]


def posteriors(n: int, edges: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """Forward-backward over the lattice."""
    fwd: list[float] = [0.0] + [-math.inf] * n
    bwd: list[float] = [-math.inf] * n + [0.0]

    def add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        if b == -math.inf:
            return a
        hi, lo = max(a, b), min(a, b)
        return hi + math.log1p(math.exp(lo - hi))

    for (i, j), w in sorted(edges.items()):
        fwd[j + 1] = add(fwd[j + 1], fwd[i] + w)
    for (i, j), w in sorted(edges.items(), reverse=True):
        bwd[i] = add(bwd[i], w + bwd[j + 1])
    return {(i, j): math.exp(fwd[i] + w + bwd[j + 1] - fwd[n]) for (i, j), w in edges.items()}


def _by_cell(batches: Iterable[pa.RecordBatch], fields: list[str], model: dict[str, dict], totals: dict[str, float]):
    """For each undecided cell its runs with the lattice of each."""
    rules = {f: _decide(model, f) for f in fields}
    for batch in batches:
        for uid, ident, fi, cell, seen in zip(*(batch.column(c).to_pylist() for c in ("uid", "id", "f", "item", "seen"))):
            f = fields[fi]
            freq: dict[int, dict] = {}
            for x in seen or []:
                freq.setdefault(x["r"], {})[x["i"], x["j"]] = x["n"]
            runs = runs_of(cell)
            yield ident, fi, [
                (t, p, at, lattice(p, k, model[f], rules[f], freq.get(r, {}), totals.get(f, 1.0))) for r, (t, (p, k, at)) in enumerate(runs)
            ]


def _expect(batches, fields, model, totals):
    n: Counter = Counter()
    for _, fi, runs in _by_cell(batches, fields, model, totals):
        for text, parts, places, edges in runs:
            if len(parts) > 1:
                for (i, j), q in posteriors(len(parts), edges).items():
                    if q > 1e-3:
                        n[fi, span_text(text, places, i, j)] += q
            else:
                n[fi, clean_value(parts[0])] += 1.0
        if len(n) > 50_000:
            yield _counts(n)
            n = Counter()
    if n:
        yield _counts(n)


def _counts(n: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in n], pa.int8()), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.float64())], ["f", "item", "n"]
    )


def _choose(batches, fields, model, totals, id_type):
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], id_type), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.int32()), pa.array(cols[3])], ["id", "f", "pos", "item"]
        )

    for ident, fi, runs in _by_cell(batches, fields, model, totals):
        pos = 0
        for text, parts, places, edges in runs:
            for i, j in viterbi(len(parts), edges):
                v = span_text(text, places, i, j)
                if v:
                    pos += 1
                    out.append((ident, fi, pos, v))
        if len(out) > 20_000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def split_packed(df: DataFrame, id_col: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """One row per packed value: (``id_col``, field_name, pos, item).

    ``rounds`` is the number of EM rounds over the value lattice. Cells that are null, blank or
    the literal ``nan`` give no row; empty pieces count for nothing; ``pos`` counts from 1 within
    the cell. Ids need not be unique: each row's cells are split on their own. An empty table
    gives an empty result. Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    id_field = df.schema[id_col]
    cells = df.select(F.col(id_col).alias("id"), *[F.when(~is_blank(F.col(f)), F.col(f)).alias(f) for f in fields])
    cells = spread(cells)
    texts = cells.select(*fields)
    stats = (
        texts.mapInArrow(lambda it: _stats_of(it, fields), "f string, c string, d string, e string, n long")
        .groupBy("f", "c", "d", "e").agg(F.sum("n").alias("n")).collect()
    )  # bounded: fields x classes x kinds x classes
    model = learn_chain({(r.f, r.c, r.d, r.e): r.n for r in stats})
    if not model:
        return spark.createDataFrame([], f"{id_col} {id_field.dataType.simpleString()}, field_name string, pos int, item string")
    id_type = id_field.dataType.simpleString()
    first = materialize(
        cells.mapInArrow(lambda it: _segment(it, fields, model), f"id {id_type}, f byte, pos int, item string, uid long"), "split"
    )
    sure = first.filter("uid is null").select("id", "f", "pos", "item")
    open_cells = first.filter("uid is not null").select("uid", "id", "f", "item")
    if open_cells.isEmpty():
        out = sure
    else:
        out = sure.unionByName(_resolve(sure, open_cells, fields, model, rounds, id_type))
    names = F.array(*[F.lit(f) for f in fields])
    return out.select(F.col("id").alias(id_col), F.get(names, F.col("f").cast("int")).alias("field_name"), "pos", "item")


def _resolve(sure: DataFrame, open_cells: DataFrame, fields: list[str], model: dict, rounds: int, id_type: str) -> DataFrame:
    """Value lattice for the undecided cells, with value frequencies by join."""
    key = F.xxhash64("f", term_key(F.col("item"))).alias("h")
    spans = materialize(
        open_cells.select("uid", "f", "item")
        .mapInArrow(lambda it: _spans(it, fields, model), "uid long, f byte, r int, i int, j int, item string")
        .select("uid", "f", "r", "i", "j", key),
        "spans",
    )
    present = [r.f for r in open_cells.select("f").distinct().collect()]  # at most one per field
    known = sure.filter(F.col("f").isin(present)).select("f", key).groupBy("f", "h").agg(F.count(F.lit(1)).cast("double").alias("n"))
    known = materialize(known, "known")
    totals0 = {fields[r.f]: r.n for r in known.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_id = to_arrow_type(_parse_datatype_string(id_type))
    counts, totals = known, totals0
    for step in range(rounds):
        # the hot side of this join is the spans; AQE splits hot keys, counts has one row a key
        seen = (
            spans.join(counts.select("h", "n"), "h")
            .groupBy("uid").agg(F.collect_list(F.struct("r", "i", "j", "n")).alias("seen"))
        )  # a list holds the spans of one cell
        cells = open_cells.join(seen, "uid", "left")
        if step == rounds - 1:
            return cells.mapInArrow(lambda it: _choose(it, fields, model, totals, arrow_id), f"id {id_type}, f byte, pos int, item string")
        gained = (
            cells.mapInArrow(lambda it: _expect(it, fields, model, totals0), "f byte, item string, n double")
            .select("f", key, "n")
        )
        counts = materialize(known.unionByName(gained).groupBy("f", "h").agg(F.sum("n").alias("n")), "counts")
        totals = {fields[r.f]: r.n for r in counts.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    raise ValueError("rounds must be at least 1")
