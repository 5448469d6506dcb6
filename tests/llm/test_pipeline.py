import os

import pytest

import corpus_pipeline as C
from helixframe.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, odd):
    docs, columns = odd, odd.columns
    kept = []
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
            kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {1, 2, 6, 7, 9, 10, 11, 12} and kept[1] == {2, 6, 7, 9, 10, 11, 12}
    assert kept[2] == kept[1] - {7, 12} == kept[3]
    assert {r["doc_id"] for r in docs.collect()} == kept[3]


def test_empty_table(spark, none):
    docs = none
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample data")
def test_run(spark):
    rows = C.run(spark, DATA).collect()
    assert len({r["doc_id"] for r in rows}) >= 150
