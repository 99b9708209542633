"""Packed cells: round trips, quoting, missing cells, odd tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.operators.multivalue import clean_value, learn_chain, parse_run, posteriors, runs_of, split_packed, strong_pieces, viterbi

NAMES = ["Adler", "Brandt", "Chevalier", "Duarte", "Eriksen", "Fontana", "Grün", "Haas", "Ivanov", "Jansen"]
WORDS = ["citation", "network", "mapping", "retrieval", "water", "policy", "index", "growth", "model", "team"]


def make_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        authors = [f"{rng.choice(NAMES)}{k}, {rng.choice('ABCDE')}. {rng.choice('FGH')}." for k in range(rng.randint(1, 5))]
        style = rng.choice(["; ", ";", " | ", "\t", "\n", "; ", "; ", " & ", '"'])
        cell = ", ".join(f'"{a}"' for a in authors) if style == '"' else style.join(authors)
        terms = [rng.choice(["networks, weighted", "policy, regional", f"{rng.choice(WORDS)} {rng.choice(WORDS)}"]) for _ in range(rng.randint(1, 5))]
        if any("," in t for t in terms):
            kw = "; ".join(terms)
        else:
            kw = rng.choice(["; ", ", ", " • "]).join(terms)
        rows.append((i, cell, kw))
        truth[i] = (authors, terms)
    return rows, truth


def test_round_trip(spark):
    rows, truth = make_rows()
    df = spark.createDataFrame(rows, "rec long, authors string, terms string")
    out = split_packed(df, "rec", ["authors", "terms"]).collect()
    got = {}
    for r in out:
        got.setdefault((r.rec, r.field_name), []).append((r.pos, r.item))
    wrong = 0
    for i, (a, t) in truth.items():
        for field, want in (("authors", a), ("terms", t)):
            have = [x for _, x in sorted(got[i, field])]
            wrong += have != want
    assert wrong <= 0.01 * 2 * len(truth)


def test_quotes_brackets_and_empty_pieces(spark):
    cells = ['"a ""b"" c"; d', "x; ; y;", '"one; two"; three', "[A, B.; C, D.] Univ X, City; [E, F.] Inst Y, Town", " ", "nan", None, ";;"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "rec long, cell string")
    got = {}
    for r in split_packed(df, "rec", ["cell"]).collect():
        got.setdefault(r.rec, []).append((r.pos, r.item))
    assert sorted(got[0]) == [(1, 'a "b" c'), (2, "d")]
    assert sorted(got[1]) == [(1, "x"), (2, "y")]
    assert sorted(got[2]) == [(1, "one; two"), (2, "three")]
    assert [v for _, v in sorted(got[3])] == ["[A, B.; C, D.] Univ X, City", "[E, F.] Inst Y, Town"]
    assert set(got) == {0, 1, 2, 3}


def test_empty_repeated_long_and_clashing(spark):
    empty = spark.createDataFrame([], "rec long, cell string")
    assert split_packed(empty, "rec", ["cell"]).collect() == []
    long_cell = "; ".join(f"value {i}" for i in range(20_000))
    rows = [(1, "a; b", 9, "z"), (1, "a; b", 9, "z"), (2, long_cell, 9, "z")]
    df = spark.createDataFrame(rows, "rec long, cell string, id long, item string")
    out = split_packed(df, "rec", ["cell"])
    assert out.columns == ["rec", "field_name", "pos", "item"]
    counts = {r.rec: r["count"] for r in out.groupBy("rec").count().collect()}
    assert counts == {1: 4, 2: 20_000}


def test_hot_cell_is_not_special(spark):
    rows = [(i, "water, drinking; networks, weighted" if i % 3 else "water, drinking") for i in range(900)]
    out = split_packed(spark.createDataFrame(rows, "rec long, cell string"), "rec", ["cell"])
    assert {r.item for r in out.select("item").distinct().collect()} == {"water, drinking", "networks, weighted"}


def test_rounds_must_be_positive(spark):
    df = spark.createDataFrame([(1, "a b, c d"), (2, "a b; c d"), (3, "x, y; z")], "rec long, cell string")
    with pytest.raises(ValueError):
        split_packed(df, "rec", ["cell"], rounds=0).collect()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet='ab ,;|"[]\t\n/&', max_size=30))
def test_scan_covers_the_cell(cell):
    pieces = strong_pieces(cell)
    rest = cell
    for p in pieces:
        at = rest.index(p)
        assert not rest[:at].strip(";|\t\n ")
        rest = rest[at + len(p) :]
    for text, (parts, kinds, places) in runs_of(cell):
        assert len(parts) == len(kinds) + 1 == len(places) and all(text[a:b] == p and p for p, (a, b) in zip(parts, places))


def test_awkward_long_cells(spark):
    """Long runs of spaces, quotes, brackets and commas stay linear."""
    cells = [" " * 200_000 + "x", "[" * 100_000, '"' * 100_001, "a, b, " * 20_000, "word" * 50_000, ",and " * 30_000, "A" * 100_000 + " BC"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)] + [(100 + i, "networks, weighted; a b") for i in range(20)], "rec long, cell string")
    got = {r.rec: r["count"] for r in split_packed(df, "rec", ["cell"]).groupBy("rec").count().collect()}
    assert set(got) >= {0, 1, 2, 3, 4, 6} and got[100] in (2, 3)


def test_chain_learns_inner_commas():
    stats = {("f", "^", "", "T"): 100, ("f", "T", ",", "I"): 100, ("f", "I", "", "$"): 100, ("f", "I", "s", "T"): 50, ("f", "I", "&o", "T"): 10}
    cut = learn_chain(stats)["f"]["cut"]
    assert cut["T", ",", "I"] < 0.01 and cut["I", "&o", "T"] > 0.9


def test_lattice_paths_agree():
    edges = {(0, 0): -1.0, (1, 1): -1.0, (0, 1): -5.0}
    assert viterbi(2, edges) == [(0, 0), (1, 1)]
    post = posteriors(2, edges)
    assert abs(post[0, 0] + post[0, 1] - 1) < 1e-9 and post[0, 0] > post[0, 1]


def test_clean_value():
    assert clean_value('"a ""b"" c"') == 'a "b" c'
    assert clean_value('"grey" literature') == '"grey" literature'


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", ",", " and ", " & ", ";", "/", " / "]), max_size=12))
def test_plain_and_general_parse_agree(pieces):
    """A bracket far behind forces the general path; the parts before it stay the same."""
    run = "".join(pieces).strip(" ")
    parts, kinds, places = parse_run(run)
    longer = parse_run(f"{run}, [z")
    if parts:
        assert (longer[0][:-1], longer[1][:-1], longer[2][:-1]) == (parts, kinds, places)


def test_long_values_between_sure_cuts():
    """A stretch with more undecided delimiters than MAX_OPEN is a span of its own."""
    from citeloom.operators.multivalue import MAX_OPEN, allowed_spans

    n = MAX_OPEN + 8
    spans = set(allowed_spans([f"p{k}" for k in range(n)], [","] * (n - 1), {}))
    assert (0, n - 1) in spans and (0, n - 2) not in spans and (1, n - 1) not in spans and (1, MAX_OPEN + 1) in spans
    assert len(spans) <= n * (MAX_OPEN + 1) + 1


def test_scratch_is_cleared(spark):
    from citeloom.session import clear_scratch, materialize

    df = materialize(spark.range(3), "scratch-test")
    assert df.count() == 3 and clear_scratch(spark) >= 1 and clear_scratch(spark) == 0
