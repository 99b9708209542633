"""From files to tables."""

from citeloom.operators import bursts as B
from citeloom.operators import corpus as K
from citeloom.sources import export as X
from citeloom.sources import files as S


def test_pipeline(spark, tmp_path):
    head = "PT\tAU\tTI\tSO\tPY\tDE\tID\tAB\tC1\tCR\tTC\tDI\n"
    rows = [
        "J\tSmith, J; Lee, K\tNetwork analysis of citation data\tScience\t2020\tNetwork; Citation\tDATA\tshort\t[Smith, J] Univ A, Boston, USA\tLEE K, 2019, NATURE\t5\t10.1234/a",
        "J\tSmith, J; Lee, K\tNetwork analysis of citation data\tScience\t2020\tNetwork; Citation\tDATA\ta longer abstract\t[Smith, J] Univ A, Boston, USA\tLEE K, 2019, NATURE\t5\t10.1234/A",
        "J\tChen, Q\tA second paper on maps\tNature\t2021.0\t\t\tmaps of science grow\tUniv B, Dept, Paris, France\tSMITH J, 2020, SCIENCE; LEE K, 2019, NATURE\tx\t",
        "J\tWang, H\tA third paper on bridges\tCell\tbad\tbridges\t\t\t\tSMITH J, 2020, SCIENCE\t1\t",
    ]
    (tmp_path / "r.txt").write_text(head + "\n".join(rows) + "\n", encoding="utf-8")
    records = S.read_records(spark, [str(tmp_path / "r.txt")])
    papers, tables, report = K.build(records, 2030, blocked=spark.createDataFrame([("Citation",)], "term string"))
    assert tuple(report.first()) == (4, 1, 3)
    got = {r.title: r for r in papers.collect()}
    assert got["Network analysis of citation data"].abstract == "a longer abstract" and got["A second paper on maps"].year == 2021 and got["A third paper on bridges"].year is None
    first = got["Network analysis of citation data"].rec_id
    kw = {}
    for r in tables["keywords"].collect():
        kw.setdefault(r.rec_id, set()).add(r.keyword)
    assert kw[first] == {"Network"} and kw[got["A second paper on maps"].rec_id]
    assert {r.country for r in tables["countries"].collect()} == {"United States", "France"}
    assert {r.institution for r in tables["institutions"].collect()} == {"Univ A", "Univ B"}
    assert {r.dst for r in tables["citations"].collect()} == {first}
    c = X.Corpus(papers, **tables)
    assert "disruption" in X.available_tables(c)["innovation"]
    assert len(X.export_zip(c, ["people/top_authors"])) > 0


def test_patterns_and_sources(spark):
    rows = [(1, "deep maps", "x", None, None), (2, "t", "a", "kept", None)]
    p = spark.createDataFrame(rows, "rec_id long, title string, abstract string, author_keywords string, keywords_plus string")
    got = {(r.rec_id, r.keyword) for r in K.keyword_table(p, patterns={"Map Science": "maps?"}).collect()}
    assert (1, "Map Science") in got and (2, "Kept") in got
    assert {r.rec_id for r in K.keyword_table(p, "DE").collect()} == {2}


def test_burst_table_function(spark):
    B.register_udtf(spark)
    got = spark.sql("SELECT * FROM kleinberg_bursts(array(2018, 2019, 2020, 2021), array(1, 1, 9, 1))").collect()
    assert len(got) == 1 and got[0].start == 2020
