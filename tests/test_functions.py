"""Scalar functions against the golden inputs."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import affiliations as A
from citeloom.functions import keywords as K
from citeloom.functions import references as R
from citeloom.functions.text import is_blank, split_terms, trim_ws
from citeloom.operators.records import safe_year


def one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("", []), ("Network; Citation Analysis ; Topic Mapping", ["Network", "Citation Analysis", "Topic Mapping"]), (None, []), ("nan", [])])
def test_split(spark, raw, want):
    assert one(spark, split_terms, raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("covid 19", "COVID-19"), ("co-citation", "Co-citation"), ("aedes-aegypti", "Aedes Aegypti"), ("<italic>aedes Aegypti< Italic>", "Aedes Aegypti"), ("rt pcr", "RT-PCR"),
        ("study", None), ("h5n1", "H5N1"), ("mRNA", "mRNA"), ("science of maps", "Science of Maps"), ("dna-based maps", "DNA Based Maps"), (None, None), ("nan", None), ("x1-beta", "X1-BETA"),
    ],
)
def test_normalize_keyword(spark, raw, want):
    assert one(spark, K.normalize_keyword, raw) == want


def test_metadata_terms(spark):
    df = spark.createDataFrame([("citation-analysis; Bibliometrics", "BIBLIOMETRICS; Citation Analysis")], "de string, id string")
    got = df.select(*[K.metadata_terms(F.col("de"), F.col("id"), s).alias(s[:2] + str(i)) for i, s in enumerate(("DE", "ID", "DE+ID"))]).first()
    assert list(got) == [["Citation Analysis", "Bibliometrics"], ["Bibliometrics", "Citation Analysis"], ["Citation Analysis", "Bibliometrics"]]


def test_automatic_terms(spark):
    df = spark.createDataFrame(
        [(1, "Network analysis for cancer diagnosis and survival prediction", "Network analysis improves cancer diagnosis and survival prediction in clinical workflows.")],
        "id long, title string, abstract string",
    )
    terms = [r.term for r in K.automatic_terms(df, "id", max_terms=6).orderBy("pos").collect()]
    assert len(terms) == 6 and "Network Analysis" in terms and ({"Cancer Diagnosis", "Survival Prediction"} & set(terms))


def test_governance(spark):
    t = spark.createDataFrame([(1, 0, "COVID-19"), (1, 1, "Citation Analysis"), (1, 2, "Bibliometrics")], "rec long, pos int, term string")
    blocked = spark.createDataFrame([("Bibliometrics",)], "term string")
    alias = spark.createDataFrame([("citation analysis", "Knowledge Mapping")], "alias string, term string")
    assert [r.term for r in K.governed(t, "rec", blocked, alias).orderBy("pos").collect()] == ["COVID-19", "Knowledge Mapping"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("[Smith J] Univ X, Dept Y, USA; [Lee K] Univ Z, Hong Kong", ["China", "United States"]), ("Viruses-Basel", []),
        ("INST PASTEUR,BANGUI,CENT AFR REPUBL; INST NATL SANTE PUBL,ABIDJAN,COTE IVOIRE", ["Central African Republic", "Cote d'Ivoire"]),
        ("Minist Hlth & Human Serv, Majuro, Marshall Island; Univ X, Santo Domingo, Dominican Rep", ["Dominican Republic", "Marshall Islands"]),
        ("Dept A, Univ A, Boston, U.S.; Dept B, Inst C, Beijing, Peoples R of China; Dept D, Lab E, London, U.K.", ["China", "United Kingdom", "United States"]),
        ("Univ A, China", []), ("Dept, Univ, Nicosia, Cyprus", ["United States"]), (None, []), ("nan", []),
    ],
)
def test_countries(spark, raw, want):
    assert one(spark, A.countries_of, raw) == want


def test_country_word_boundary(spark):
    assert one(spark, lambda c: A.countries_of(c, compat=False), "Dept, Univ, Nicosia, Cyprus") == ["Cyprus"]


def test_institutions(spark):
    cell = "[Alice] Department of Data Science, University of Test, New York, USA; [Bob] Institute of Metrics, Beijing, PR CHINA"
    assert one(spark, A.institutions_of, cell) == ["Institute of Metrics", "University of Test"]
    assert one(spark, A.scored_institutions_of, cell) == ["Institute of Metrics", "University of Test"]


@pytest.mark.parametrize("raw,want", [("SMITH J, 2020, SCIENCE", "SMITH J, 2020"), ("[ANONYMOUS], 2020, REPORT", None), ("12345", None), ("A, 2020", None), ("JONES K, 2020a, X", "JONES K, 2020a")])
def test_short_reference(spark, raw, want):
    assert one(spark, R.short_reference, raw) == want


@pytest.mark.parametrize(
    "raw,want", [("SMITH J, 2020, SCIENCE, V368, P123", "SCIENCE"), ("LEE K, ET AL., 2019, NATURE, V574, P456", "NATURE"), ("Invalid Reference", None), ("12345", None)]
)
def test_reference_journal(spark, raw, want):
    assert one(spark, R.reference_journal, raw) == want


@pytest.mark.parametrize("raw,want", [("LEE K, ET AL., 2019, NATURE", "LEE K"), ("[ANONYMOUS], 2020, REPORT", None)])
def test_reference_author(spark, raw, want):
    assert one(spark, R.reference_author, raw) == want


def test_reference_tokens(spark):
    assert one(spark, R.title_case, "o'neil covid-19 x") == "O'Neil Covid-19 X"
    assert one(spark, R.doi_token, "see 10.1234/Ab.c).") == "10.1234/AB.C"
    assert one(spark, R.author_token, "Smith-Jones, J") == "SMITH-JONES"
    assert one(spark, R.year_token, "2020.0") == "2020"
    assert one(spark, R.journal_token, "j. of maps") == "J"
    assert one(spark, R.upper_reference, "smith j, x, 2019a, nature") == "SMITH J, 2019"


@pytest.mark.parametrize("raw,want", [("2024", 2024), ("2024.0", 2024), ("85", None), ("2200", None), ("bad", None), ("nan", None), (None, None), ("inf", None)])
def test_safe_year(spark, raw, want):
    assert one(spark, lambda c: safe_year(c, 2030), raw) == want


def test_blank_and_trim(spark):
    assert one(spark, trim_ws, "  x\t\n") == "x"
    assert [one(spark, is_blank, v) for v in (None, " \t", "nan", "x")] == [True, True, True, False]
