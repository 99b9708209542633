"""Training-data operators: brute force, round trips, odd tables."""

import itertools
import random
import os
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm.canonical import map_to_canonical
from citeloom.llm.formatting import formatting_duplicates
from citeloom.llm.fusion import bare_doi, estimate, fuse, grouped_rows
from citeloom.llm.leaks import Patterns, find_leaks, leak_report, words_of
from citeloom.llm.mojibake import garbled_cells, repair
from citeloom.llm.packing import Packer, load_counter, pack_texts, packing_summary
from citeloom.llm.pairs import cooccurrence
from citeloom.llm.residue import ResidueIndex, read_exemplars, residue_documents, without_residue
from citeloom.llm.term_counts import TermStore, changed_records, signed_deltas
from citeloom.llm.terms import record_terms

# --- terms ---


def test_record_terms(spark):
    df = spark.createDataFrame([(1, "A b; c  D", "A B; E", 5), (2, None, "nan", 5), (3, "c d", None, 5)], "paper_id long, author_keywords string, keywords_plus string, n long")
    got = {(r.paper_id, r.term): r.n for r in record_terms(df).collect()}
    assert got == {(1, "a b"): 2, (1, "c d"): 1, (1, "e"): 1, (3, "c d"): 1}
    assert record_terms(df.limit(0)).count() == 0


def term_rows(spark, recs):
    rows = [(i, t, n) for i, ts in recs.items() for t, n in Counter(ts).items()]
    return spark.createDataFrame(rows, "id long, term string, n long")


def test_incremental_counts_equal_a_full_count(spark, tmp_path):
    rng = random.Random(1)
    recs = {i: rng.choices("abcdefgh", k=rng.randint(0, 5)) for i in range(60)}
    store = TermStore(spark, f"file://{tmp_path}/store", buckets=4)
    store.apply(signed_deltas(term_rows(spark, recs)), len(recs))
    for _ in range(3):
        new = dict(recs)
        gone = rng.sample(sorted(new), 5)
        for i in gone:
            del new[i]
        changed = rng.sample(sorted(new), 6)
        for i in changed:
            new[i] = rng.choices("abcdefghij", k=3)
        add = {max(new) + 1 + k: rng.choices("xyz", k=2) for k in range(4)}
        new |= add
        plus = {i: new[i] for i in [*changed, *add]}
        minus = {i: recs[i] for i in [*gone, *changed]}
        store.apply(signed_deltas(term_rows(spark, plus), term_rows(spark, minus)), len(add) - len(gone))
        recs = new
    store = TermStore(spark, f"file://{tmp_path}/store", buckets=4)  # read back from the manifest
    got = {r.term: (r.occurrences, r.records) for r in store.counts().collect()}
    want = {t: (sum(x.count(t) for x in recs.values()), sum(t in x for x in recs.values())) for t in set(itertools.chain(*recs.values()))}
    assert got == want and store.total_records == len(recs)
    marks = {r.term: r.mark for r in store.marked(2, 0.08).collect()}
    assert all(marks[t] == ("rare" if n <= 2 else "common" if n > 0.08 * len(recs) else None) for t, (_, n) in want.items())


def test_changed_records(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, k string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "id long, k string")
    new, old = changed_records(a, b, "id", ["k"])
    assert {r.id for r in new.collect()} == {2, 4} and {r.id for r in old.collect()} == {2}


def test_store_layers_and_versions(spark, tmp_path):
    """Batches add layers, full buckets are merged, unused versions and manifests go, a new handle sees all."""
    from citeloom.llm.term_counts import MOST_LAYERS

    path = tmp_path / "layers"
    for i in range(MOST_LAYERS + 3):
        store = TermStore(spark, f"file://{path}", buckets=1)
        store.apply(signed_deltas(term_rows(spark, {i: ["a", f"t{i}"]}), term_rows(spark, {i - 1: ["a", f"t{i - 1}"]}) if i else None), 1 if i == 0 else 0)
    got = {r.term: r.records for r in TermStore(spark, f"file://{path}").counts().collect()}
    assert got == {"a": 1, f"t{MOST_LAYERS + 2}": 1}
    kept = {p.name for p in path.iterdir() if p.name.startswith("v")}
    assert kept == {f"v{v}" for vs in store.live.values() for v in vs} and len(kept) <= MOST_LAYERS
    assert len(list((path / "manifest").glob("v*"))) == 1


def test_empty_store(spark, tmp_path):
    store = TermStore(spark, f"file://{tmp_path}/empty")
    store.apply(signed_deltas(term_rows(spark, {1: "a"}).limit(0)), 0)
    assert store.counts().count() == 0 and store.marked().count() == 0


# --- pairs ---


def brute_pairs(baskets, min_pairs, lift):
    sets = [set(b) - {None} for b in baskets]
    n = sum(bool(s) for s in sets)
    one = Counter(x for s in sets for x in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (k, one[a], one[b], n) for (a, b), k in two.items() if k >= min_pairs and k * n >= lift * one[a] * one[b]}


def basket_rows(spark, baskets):
    return spark.createDataFrame([(i, x, 1) for i, b in enumerate(baskets) for x in b], "rec long, item string, id long")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcdefgh", None]), max_size=8), min_size=1, max_size=30), st.integers(1, 3), st.sampled_from([0.0, 1.0, 1.5]), st.sampled_from([1, 3, 256]))
def test_pairs_against_brute_force(spark, baskets, k, lift, wide):
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrence(basket_rows(spark, baskets), "rec", "item", k, lift, block=7, wide=wide).collect()}
    assert got == brute_pairs(baskets, k, lift)


def test_wide_and_hot_baskets(spark):
    wide = [f"w{i:04d}" for i in range(600)]
    baskets = [wide, wide] + [["hot", f"x{i % 4}"] for i in range(300)]
    got = cooccurrence(basket_rows(spark, baskets), "rec", "item", 2, 0.0)
    assert got.filter("item_a like 'w%'").count() == 600 * 599 // 2
    assert {(r.item_a, r.item_b): r.n_ab for r in got.filter("item_a = 'hot'").collect()} == {("hot", f"x{i}"): 75 for i in range(4)}


# --- canonical list ---

REFS = [(1, "University of Brandau", "Brandau", "UBRA"), (2, "Brandau Polytechnic", "Brandau", "BPOL"), (3, "National Centre for Marine Studies Ostvik", "Ostvik", "NCMO"), (4, "Ostvik Medical University", "Ostvik", "OMUO")]


def test_mapping(spark):
    refs = spark.createDataFrame(REFS, "inst_id long, inst_name string, city string, acronym string")
    typed = [
        (1, "Dept X, Univ Brandau, Germany", 1), (2, "Politécnico de Brandau", 2), (3, "Natl Ctr Marine Stud Ostvik, Norway", 3), (4, "UNIVRESITY OF BRANDAU", 1), (5, "NCMO, Ostvik", 3),
        (6, "BrandauPolytechnic", 2), (7, "Universität Brandau (UBRA)", 1), (8, "Ostvik Technical University", 0), (9, "retired", 0), (10, "[Smith, J.] Ostvik_Medical_University;", 4), (11, "University of Kelmstad", 0),
        (12, "NATIONAL  CENTRE  FOR  MARINE  STUDIES  OSTVIK  Norway", 3), (13, "Ostvik Medicla Univeristy", 4), (14, None, None), (15, "  ", None), (16, "word " * 20_000, 0),
    ]
    df = spark.createDataFrame([(i, v, "z", 7) for i, v, _ in typed], "address_id long, affiliations string, key string, rid long")
    got = {r.address_id: r.inst_id for r in map_to_canonical(df, refs, "address_id", "affiliations", "inst_id", "inst_name", "city", "acronym").collect()}
    assert got == {i: w for i, _, w in typed if w is not None}
    assert map_to_canonical(df.limit(0), refs, "address_id", "affiliations", "inst_id", "inst_name", "city", "acronym").count() == 0
    none = map_to_canonical(df, refs.limit(0), "address_id", "affiliations", "inst_id", "inst_name", "city", "acronym").collect()
    assert {r.inst_id for r in none} == {0}
    bare = {r.address_id: r.inst_id for r in map_to_canonical(df, refs, "address_id", "affiliations", "inst_id", "inst_name", "city", "acronym", words_table={}, short_table={}).collect()}
    assert bare[4] == 1 and bare[13] == 4 and bare[5] == 3 and bare[3] == 0  # without the tables abbreviations find nothing, misspellings still do


def test_pigeonhole_finds_every_near_string(spark):
    """Without shortcuts: all strings within two edits are found."""
    rng = random.Random(4)
    name = "granvikstatecollege"
    rows = []
    for i in range(60):
        s = list(name)
        for _ in range(rng.randint(0, 2)):
            at, op = rng.randrange(len(s)), rng.choice("idr")
            s[at : at + (op != "i")] = [] if op == "d" else [rng.choice("abcxyz")]
        rows.append((i, "".join(s)))
    refs = spark.createDataFrame([(9, "Granvik State College", "Granvik")], "rid long, name string, place string")
    got = map_to_canonical(spark.createDataFrame(rows, "id long, v string"), refs, "id", "v", "rid", "name", "place").collect()
    assert {r.rid for r in got} == {9}


# --- duplicates in another writing ---


def test_formatting_duplicates(spark):
    rows = [
        (5, "Non-linear Growth", "Smith, J. A.; Lee, K.", "2020"), (3, "NON LINEAR  GROWTH.", "K. Lee; J. A. Smith", " 2020.0 "), (7, "Non-linear growth", "Smith J A | Lee K", "2020"),
        (8, "Non-linear growth", "Smith, J.; Lee, K.", "2020"), (9, "Non-linear growth", "Smith, J. A.; Lee, K.", "2021"), (10, "N/A", "Smith, J. A.; Lee, K.", "2020"), (11, "N/A", "Smith, J. A.; Lee, K.", "2020"),
        (12, "Alone", None, "2020"), (13, "Alone", None, "2020"), (14, "Große Maße", "Ü, T.", "1999"), (15, "GROSSE MASSE", "Ü, T", "1999.0"), (16, "Old", "A, B.", "85"), (17, "Old", "A, B.", "85"), (18, None, None, None),
        (3, "NON LINEAR  GROWTH.", "K. Lee; J. A. Smith", " 2020.0 "),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "paper_id long, title string, authors string, pub_year string, id long, root string")
    got = {(r.group_id, r.member_id): r.copies for r in formatting_duplicates(df).collect()}
    assert got == {(3, 3): 3, (3, 5): 3, (3, 7): 3, (14, 14): 2, (14, 15): 2}
    assert formatting_duplicates(df.limit(0)).count() == 0


def test_signs_in_titles(spark):
    rows = [(1, "On √n scaling of C++ tools", "Äp, B.", "2001"), (2, "ON N SCALING OF C TOOLS", "B. Äp", "2001.0"), (3, "On nn scaling of C tools", "Äp, B.", "2001"), (4, "＋＋ ??", "Äp, B.", "2001")]
    got = formatting_duplicates(spark.createDataFrame(rows, "paper_id long, title string, authors string, pub_year string")).collect()
    assert {(r.group_id, r.member_id) for r in got} == {(1, 1), (1, 2)}


def test_hot_group_of_copies(spark):
    rows = [(i, "Same title" if i % 3 else f"title {i}", "Smith, J.", "2020") for i in range(1200)]
    got = formatting_duplicates(spark.createDataFrame(rows, "paper_id long, title string, authors string, pub_year string"))
    assert got.count() == 800 and {r.copies for r in got.select("copies").distinct().collect()} == {800}


# --- best representative ---


def fusion_rows(spark, rows):
    df = spark.createDataFrame(rows, "paper_id long, doi string, title string, abstract string, feed string, at string").withColumn("exported_at", F.to_timestamp("at"))
    feeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "feed string, trust_rank int")
    return grouped_rows(df, bare_doi(F.col("doi")), "paper_id", "feed", "exported_at", ["title", "abstract"], feeds)


def test_survivors(spark):
    rows = [
        (1, "10.1234/x", "A long title of …", "N/A", "a", "2020-01-01"), (2, "DOI 10.1234/X.", "A long title of maps", None, "c", "2020-01-01"), (3, "https://doi.org/10.1234/x", "A LONG TITLE OF MAPS", "text", "b", "2021-01-01"),
        (4, "10.1234/y", "T", "one two three", "b", "2020-01-01"), (5, "10.1234/Y", "T", "one two three", "b", "2022-01-01"), (6, "10.1234/y", "T", "one two", "a", "2020-01-01"),
        (7, "10.", "x", "y", "a", "2020-01-01"), (8, "10.", "x", "y", "a", "2020-01-01"), (9, "10.1234/z", "nan", "", "a", "2020-01-01"), (10, "10.1234/z", None, "Abstract: -", "q", None), (11, None, "x", "y", "a", "2020-01-01"),
    ]
    got = {r.key: (r.title_id, r.abstract_id) for r in fuse(fusion_rows(spark, rows), ["title", "abstract"]).collect()}
    assert got == {"10.1234/x": (3, 3), "10.1234/y": (6, 5), "10.1234/z": (0, 0)}
    assert fuse(fusion_rows(spark, rows).limit(0), ["title"]).count() == 0


def test_copied_votes_are_discounted(spark):
    """Two sources that share false values count for little more than one."""
    rows, i = [], 0
    for g in range(120):
        truth, lie = f"value {g} right", f"value {g} wrong {g % 7}"
        bad = g % 3 == 0
        for feed, v in (("a", truth), ("d", truth), ("b", lie if bad else truth), ("c", lie if bad else truth)):
            i += 1
            rows.append((i, f"10.1234/{g}", v, "t", feed, "2020-01-01"))
    data = fusion_rows(spark, rows)
    from citeloom.llm.fusion import _claims, _votes

    _, copy = estimate(_votes(_claims(data, ["title"])))
    assert copy["title", "b", "c"] > 0.9
    fused = {r.key: r.title_p for r in fuse(data, ["title"], declared=False).collect()}
    assert len(fused) == 120 and all(0 < p <= 1 for p in fused.values())


def test_estimates_decide_between_rows_of_equal_rank_and_time(spark, monkeypatch):
    """Ranks and times level: accuracy and copy discounts choose the row, ranks beat any votes."""
    from citeloom.llm import fusion

    rows, i = [], 0
    for g in range(90):  # d and e agree with a; b and c share lies in a third of the groups
        truth, lie = f"value {g} right", f"value {g} wrong {g % 7}"
        bad = g % 3 == 0
        for feed, v in (("b", lie if bad else truth), ("c", lie if bad else truth), ("d", truth), ("e", truth), ("a", truth)):
            i += 1
            rows.append((i, f"10.1234/{g}", v, "t", feed, "2020-01-01"))
    rows += [(1001, "10.1234/tie", "said by copiers", "t", "b", "2020-01-01"), (1002, "10.1234/tie", "said by copiers", "t", "c", "2020-01-01"), (1003, "10.1234/tie", "said by others", "t", "d", "2020-01-01"), (1004, "10.1234/tie", "said by others", "t", "e", "2020-01-01")]
    rows += [(2001, "10.1234/rank", "said by one", "t", "a", "2020-01-01"), *[(2002 + k, "10.1234/rank", "said by four", "t", f, "2020-01-01") for k, f in enumerate("bcde")]]
    df = spark.createDataFrame(rows, "paper_id long, doi string, title string, abstract string, feed string, at string").withColumn("exported_at", F.to_timestamp("at"))
    feeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 2), ("e", 2)], "feed string, trust_rank int")
    data = grouped_rows(df, bare_doi(F.col("doi")), "paper_id", "feed", "exported_at", ["title", "abstract"], feeds)
    got = {r.key: r.title_id for r in fuse(data, ["title"]).collect()}
    assert got["10.1234/tie"] == 1003 and got["10.1234/rank"] == 2001
    free = {r.key: r.title_id for r in fuse(data, ["title"], declared=False).collect()}
    truths = {r[0]: r[2] for r in rows}
    assert all(truths[free[f"10.1234/{g}"]].endswith("right") for g in range(90))  # accuracy of the free choice
    monkeypatch.setattr(fusion, "estimate", lambda votes, **kw: ({}, {}))
    assert {r.key: r.title_id for r in fuse(data, ["title"]).collect()}["10.1234/tie"] == 1001  # without estimates the smallest id


# --- garbled text ---

SAMPLES = ["Évolution de la región", "Großer Maßstab für Daten", "naïve café – “quoted” text’s", "Škoda Řím Łódź ńam", "5 °C ± 3 µm, β ≥ 2", "produção científica"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "gb18030", "cp1250"])
def test_round_trip_of_wrong_decodings(codec):
    tried = 0
    for s in SAMPLES:
        try:
            bad = s.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        tried += 1
        garbled, text, _ = repair(bad)
        assert garbled and text == s, (codec, bad, text)
    assert tried


def test_twice_garbled_and_lost():
    bad = "Évolution".encode().decode("cp1252").encode().decode("cp1252")
    assert repair(bad)[:2] == (True, "Évolution")
    garbled, _, whole = repair("r�f�rences")
    assert garbled and not whole


@pytest.mark.parametrize("text", [*SAMPLES, "引文分析与合作网络", "Карта и рост наук", "Ανάλυση αναφορών", "計量書誌の試み", "AVALIAÇÃO", "[Ä–Ö–Ü-Skala", "±2 °C, £5 & ½ ×.", "On √n scaling", "Âge des références", "plain", "", "R&amp;D"])
def test_unusual_text_is_no_case(text):
    assert repair(text)[0] is False


def test_garbled_cells(spark):
    df = spark.createDataFrame([(1, "cafÃ©", None, "x"), (2, "plain", "Großer", "y"), (2, "plain", "Großer", "y"), (3, "a" * 100_000 + "Ã©", "", "z")], "pid long, title string, abstract string, cell string")
    got = {(r.pid, r.field_name): (r.restored[-1], r.complete) for r in garbled_cells(df, "pid", ["title", "abstract"]).collect()}
    assert got == {(1, "title"): ("é", True), (3, "title"): ("é", True)}
    assert garbled_cells(df.limit(0), "pid", ["title"]).count() == 0


# --- containers ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.integers(1, 6))
def test_packer_never_overfills(sizes, bins):
    p, used = Packer(20, bins), defaultdict(list)
    for s in sizes:
        b, place, offset = p.place(s)
        assert place == len(used[b]) + 1 and offset == sum(used[b])
        used[b].append(s)
        assert sum(used[b]) <= 20 and p.open <= bins
    assert len(used) <= max(1, len(sizes))


def test_pack_texts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 60))) for _ in range(300)] + ["long " * 900, None, ""]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, place long").coalesce(4)
    packed = pack_texts(df, capacity=128, open_bins=32)
    rows = packed.collect()
    count = load_counter("/opt/tokenizers/byte_bpe_50k.tiktoken")
    want = count([t or "" for t in texts])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.piece_start, r.n_tokens))
    for i, n in enumerate(want):
        ps = sorted(got[i])
        assert sum(x[2] for x in ps) == n and (len(ps) == 1 or n > 128) and [x[0] for x in ps] == list(range(1, len(ps) + 1))
    fill = Counter()
    for r in rows:
        fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 128
    s = packing_summary(packed, 128).first()
    assert s.containers == len(fill) and s.fill > 0.9 and s.fewest <= s.containers
    assert pack_texts(df.limit(0)).count() == 0


# --- leaks ---


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=4), st.integers(2, 5))
def test_search_against_brute_force(doc, items, m):
    grams = lambda w: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    want = {i for i, it in enumerate(items) if grams(it) & grams(doc)}
    assert Patterns([(i, " ".join(it)) for i, it in enumerate(items)], m).search(" ".join(doc)) == want


def test_find_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [
        (1, "intro " + ", ".join(words[5:17]).upper() + " end"), (2, " ".join(words[5:16])), (3, None), (4, ""), (5, "x " * 50_000 + item), (6, " ".join(words[:12]) + " mid " + "_".join(words[20:32])), (6, item),
    ]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, doc long, item long")
    h = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, item_text string")
    want = {(1, 7), (5, 7), (6, 7)}
    for size in (1_000_000, 5):
        got = find_leaks(d, h, table_words=size)
        assert got.count() == 3 and {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leak_report(find_leaks(d, h)).first().documents == 3
    assert find_leaks(d, h.limit(0)).count() == 0 and find_leaks(d.limit(0), h).count() == 0
    assert words_of("Ab-c_d, É1") == ["ab", "c", "d", "é1"]


# --- residue ---

CONTENT = "We retrieved 120 publications on citation networks issued between 1990 and 2004. The share of collaborative papers rose in every window."


def test_residue(spark):
    cases = {
        1: CONTENT, 2: "Please enable JavaScript to view this article. This viewer needs scripts to display the text.", 3: "Mapping of civic growth\n404 Not Found\nThe record you asked for does not exist on this server. Reference 12-abc.",
        4: "{{title}}\n\n${abstract}\n\nKeywords: %keywords%", 5: "Lorem ipsum dolor sit amet. Porta ipsum novus celer verba.", 6: "We examine how often journal sites ask readers to enable JavaScript and find the notice on 18 % of landing pages. " + CONTENT,
        7: "Pages that answered with a 404 Not Found status were dropped from the crawl of Berlin, as were 17 duplicates.", 8: None, 9: "  ", 10: "<html><body><p>This is sample text. It only fills the page so that the layout can be judged.</p></body></html>",
        11: CONTENT * 2_000, 12: "Templates with slots like {{title}} or ${author} were filled from the register by 20 clerks; none stayed empty in the final edition. " + CONTENT,
    }
    filler = [(100 + i, f"{CONTENT} Item {i} of the register lists other works on growth and teams.") for i in range(200)]
    df = spark.createDataFrame([(i, t, "l") for i, t in [*cases.items(), *filler]], "doc_id long, text string, label string")
    got = {r.doc_id: r.label for r in residue_documents(df).collect()}
    assert set(got) == {2, 3, 4, 5, 10} and got[2] == "script" and got[3] == "error" and got[4] == "placeholder" and got[5] == "filler"
    clean = without_residue(df)
    assert clean.columns == df.columns and clean.count() == df.count() - 5
    assert residue_documents(df.limit(0)).count() == 0


def test_containment_in_joined_exemplars():
    index = ResidueIndex({"": 1000})
    score, _ = index.containment(re.findall(r"\w+", "internal server error"))
    assert score == 1.0
    assert index.containment(["unheard", "things"])[0] == 0.0
    own = ResidueIndex({"": 1000}, [("error", "alpha beta"), ("error", "gamma delta"), ("filler", "omega sigma")])
    assert own.containment(["alpha", "gamma"])[0] == 1.0  # two exemplars of one label together
    assert 0 < own.containment(["alpha", "omega"])[0] < 1  # never of two labels
    assert own.containment(["alpha", "alpha", "alpha", "other"])[0] > own.containment(["alpha", "other"])[0]  # repeated words weigh more


def test_held_out_residue(spark):
    """Recall of at least 0.9 on texts that are no exemplars, none of the contrast texts reported."""
    folder = os.path.dirname(__file__)
    rows = [line.rstrip("\n").split("\t") for line in open(f"{folder}/residue_heldout.tsv", encoding="utf-8") if not line.startswith("#")]
    known = {t for _, t in read_exemplars()}
    assert not known & {t for _, t in rows}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id for r in residue_documents(docs.unionByName(more)).collect()}
    residue = {-1 - i for i, (kind, _) in enumerate(rows) if kind != "content"}
    assert len(residue & found) >= 0.9 * len(residue)
    assert not {-1 - i for i, (kind, _) in enumerate(rows) if kind == "content"} & found


def test_exemplars_of_the_caller(spark, tmp_path):
    path = tmp_path / "own.tsv"
    path.write_text("filler\tmine\twibble wobble wubble\n", encoding="utf-8")
    df = spark.createDataFrame([(1, "wibble wobble wubble"), (2, "Mushrooms of the northern forest in autumn")], "doc_id long, text string")
    assert [r.doc_id for r in residue_documents(df, exemplars=str(path)).collect()] == [1]
