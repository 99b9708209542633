"""Deduplication of records without a year."""

import pytest

from citeloom.operators import records as D


@pytest.mark.parametrize("kind", ["int", "string"])
def test_records_without_year_are_merged(spark, kind):
    rows = [(0, "A very long title for this test", "Lee, K"), (1, "A very long title for this tests", "Lee, K"), (2, "A very long title for this test", "Lee, K"), (3, "Something else altogether", "Lee, K")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], f"rec_id long, title string, authors string, year {kind}, doi string, abstract string")
    out, report = D.deduplicate(df)
    assert {r.rec_id for r in out.collect()} == {0, 3} and tuple(report.first()) == (4, 2, 2)
    dated = df.filter("rec_id = 1").withColumn("year", D.F.lit(2020).cast(kind))
    assert D.deduplicate(df.filter("rec_id = 0").unionByName(dated))[0].count() == 2  # a year is another block
