"""Text moved between two single-byte code pages."""

import itertools

import pytest

from citeloom.llm.mojibake import Context, garbled_cells, repair

PAGES = ["cp1252", "cp850", "mac_roman", "cp437", "cp1251", "cp1250"]
SAMPLES = [
    "José García", "Müller größer", "São Paulo produção", "Évolution de la région", "naïve café théorie", "Señor Núñez niño", "Ångström Jørgensen", "Größe für Äcker", "élève français où",
    "coração informações", "Škoda Řím Český", "Łódź Gdańsk żółty", "Сети цитирования", "Анализ данных",
]
CLEAN = [*SAMPLES, "“Quoted” text – it’s fine… 5 °C ± 3 µm", "n° 5, 1ª edición, m² and cm³", "Dvořák and Łukasiewicz", "μ-opioid β-carotene α", "MÜLLER, É. ÁLVAREZ", "Mapping global growth", "über Äpfel"]


def moved():
    for text, (true, read) in itertools.product(SAMPLES, itertools.permutations(PAGES, 2)):
        if "cp1252" in (true, read):
            try:
                bad = text.encode(true).decode(read)
            except UnicodeError:
                continue
            if bad != text:
                yield text, bad


def test_both_directions_of_code_pages():
    """At least 85 % come back whole; what does not is never called complete. The rest are
    letters that also fit their words (cp1250 for cp1252) and need the counts of a column."""
    cases = list(moved())
    got = [(text, *repair(bad)) for text, bad in cases]
    assert len(cases) > 60 and sum(restored == text for text, _, restored, _ in got) >= 0.85 * len(cases)
    assert all(restored == text for text, _, restored, complete in got if complete)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_words_stay(text):
    assert repair(text) == (False, text, False)


@pytest.mark.parametrize(("bad", "good"), [("JosÈ", "José"), ("Jos‚", "José"), ("Ñåòè", "Сети"), ("M³ller", "Müller"), ("GarcÌa", "García")])
def test_lone_letters(bad, good):
    assert repair(bad)[1] == good


def test_counts_of_the_column_tell_fitting_letters_apart(spark):
    rows = [(i, "producción de Espańa" if i == 7 else f"la España moderna {i}", "x") for i in range(300)] + [(900, None, "y"), (901, "", "z")]
    df = spark.createDataFrame(rows, "paper_id long, title string, id string")
    got = {r.paper_id: (r.restored, r.complete) for r in garbled_cells(df, "paper_id", ["title"]).collect()}
    assert got == {7: ("producción de España", True)}
    assert Context().moved("Espańa") == ("Espańa", 0.0)
