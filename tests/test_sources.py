"""Files, projects, exports and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from citeloom.sources import export as X
from citeloom.sources import files as S
from citeloom.sources import reports as R
from citeloom.streaming import events as E


def test_read_tagged_and_csv(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_bytes("﻿PT\tAU\tTI\tSO\tPY\tCR\nJ\tSmith, J\tPaper \"A\tJournal A\t2020\tLEE K, 2019, NATURE\nJ\tLee, K\tPaper B\n".encode())
    b = tmp_path / "b.csv"
    b.write_text('Unnamed: 0,Title,Year,Extra\n0,"Paper, C",2021,x\n', encoding="utf-8")
    df = S.read_records(spark, S.default_files(str(tmp_path)))
    rows = df.orderBy("rec_id").collect()
    assert [r.Title for r in rows] == ['Paper "A', "Paper B", "Paper, C"]
    assert rows[0].Journal == "Journal A" and rows[1].Journal is None and rows[2].Extra == "x" and "Unnamed: 0" not in df.columns


def test_encodings(tmp_path):
    for text, enc, want in (("Größe", "utf-8", "utf-8"), ("引文分析", "gb18030", "gb18030")):
        f = tmp_path / f"{enc}.txt"
        f.write_bytes(text.encode(enc))
        assert S.sniff_encoding(str(f)) == want


def test_bad_files(spark, tmp_path):
    assert S.read_records(spark, [str(tmp_path / "missing.csv")], strict=False).count() == 0
    assert S.path_list('"/a b"\n\n/c\n') == ["/a b", "/c"]
    assert S.fingerprint([str(tmp_path / "none")]).endswith("missing")


def test_project_round_trip(spark, tmp_path):
    t = {"papers": spark.createDataFrame([(1, "a")], "rec_id long, title string")}
    S.save_project(t, str(tmp_path / "p"), {"top": 3})
    back, params = S.load_project(spark, str(tmp_path / "p"))
    assert back["papers"].collect() == t["papers"].collect() and params == {"top": 3}


def corpus(spark):
    p = spark.createDataFrame(
        [(i, 2018 + i % 5, f"J{i % 3}", "Article", "English", float(i), f"10.1/{i}", "text") for i in range(20)],
        "rec_id long, year int, journal string, doctype string, language string, times_cited double, doi string, abstract string",
    )
    k = spark.createDataFrame([(i, w) for i in range(20) for w in ("a", "b", f"w{i % 4}")], "rec_id long, keyword string")
    return X.Corpus(p, keywords=k)


def test_exports(spark, tmp_path):
    c = corpus(spark)
    assert "references" not in X.available_tables(c) and "pairs" in X.available_tables(c)["keywords"]
    status = X.export_tables(c, str(tmp_path), ["descriptive/publications_by_year", "keywords/pairs", "references/coupling"])
    assert status == {"descriptive/publications_by_year": "written", "keywords/pairs": "written", "references/coupling": "skipped"}
    z = zipfile.ZipFile(io.BytesIO(X.export_zip(c, ["keywords/top_keywords"])))
    assert set(z.namelist()) == {"keywords/top_keywords.csv", "manifest.json"}
    doc = X.snapshot(c, {"top": 5}, {"top": 3})
    assert doc["records"] == 20 and doc["parameters"][0]["changed"] and "Field coverage" in X.report(doc)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 5} 10:00:00", i % 3, "xy"[i % 2], float(i)) for i in range(50)], "event_id long, t string, user_id long, event_type string, value double")
    rows = rows.withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = E.event_stream(spark, str(tmp_path / "ev"), rows.schema, 10)
    got = E.run_to_end(E.windowed_counts(stream), "counts", str(tmp_path / "cp"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.windowed_counts(rows).collect()))
    assert E.sessions(rows, "1 hour").agg(F.sum("n")).first()[0] == 50


def test_reports(spark):
    c = corpus(spark)
    refs = spark.createDataFrame([(i, f"r{j}") for i in range(20) for j in range(i % 3, i % 3 + 4)], "rec_id long, ref string")
    cites = spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "src long, dst long")
    full = X.Corpus(c.papers, keywords=c.keywords, references=refs, citations=cites)
    z = zipfile.ZipFile(io.BytesIO(R.bundle(full, {"top": {"group": "Network", "value": 5, "default": 3}})))
    assert {"case.md", "innovation.json", "signals.md", "index.json"} <= set(z.namelist())
    assert "Network" in z.read("parameters.md").decode() and "Brokers" in z.read("innovation.md").decode()
    assert R.changed_parameters({"a": {"value": 1, "default": 1}}) == []


def test_codes_and_layouts(spark):
    from citeloom.functions import geo, graph

    df = spark.createDataFrame([("USA",), ("Germany",), ("Nowhere",)], "country string").select("country", geo.iso3(F.col("country")).alias("iso3"))
    got = {r.country: (r.iso3, r.lat) for r in geo.with_positions(df).collect()}
    assert got["USA"][0] == "USA" and got["Germany"][1] is not None and got["Nowhere"] == (None, None)
    w = graph.matrix_of("abcd", [("a", "b", 1), ("c", "d", 1)])
    assert graph.cluster_layout(w, graph.louvain(w)).shape == (4, 2)
    spots = graph.bipartite_layout(["a", "b"], ["x", "y"], [("b", "x", 1), ("a", "y", 1)])
    assert spots["y"][1] > spots["x"][1]
