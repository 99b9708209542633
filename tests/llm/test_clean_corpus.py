"""The cleaned corpus keeps every column."""

import os

import pytest

from citeloom.llm import queries as L
from citeloom.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_clean_keeps_rows_as_they_were(spark):
    docs, clean = table(spark, DATA, "documents"), L.p10_clean(spark, DATA)
    assert set(clean.columns) == set(docs.columns)
    bad = {r.doc_id for r in L.p10_found(spark, DATA).collect()}
    want = [r for r in docs.collect() if r.doc_id not in bad]
    key = lambda r: repr([r[c] for c in docs.columns])
    assert sorted(map(key, clean.collect())) == sorted(map(key, want))
