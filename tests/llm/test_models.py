"""Language identification and toxicity: held-out accuracy on the sample data, and odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import language_id as L
from helixframe.llm import toxicity as T

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample data")


@needs_data
def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = L.op10_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = L.learn(docs, L.fold(4) != 2)
    assert L.accepted(docs, model).count() >= 0.99 * docs.count()


def test_language_of_odd_rows(odd, none):
    model = L.learn(odd, F.lit(True))
    rows = L.identified(odd, model).collect()
    assert len(rows) == odd.count()
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == L.UNKNOWN}
    assert unknown == {3, 4, 5, 8} and all(r["score"] == 0 for r in rows if r["doc_id"] in unknown)
    assert L.accepted(odd, model).columns == odd.columns
    assert L.learn(none, F.lit(True)) is None and L.identified(none, None).collect() == []
    assert {r["lang_pred"] for r in L.identified(odd, None).collect()} == {L.UNKNOWN}


def test_parts_lose_no_subword(monkeypatch):
    text = ("wörter und mehr " * 200).encode()
    whole = np.sort(L.subword_buckets(text))
    monkeypatch.setattr(L, "PART", 64)
    assert len(list(L.parts(text))) > 10
    assert np.array_equal(np.sort(np.concatenate([L.subword_buckets(p) for p in L.parts(text)])), whole)


def test_isotonic_is_monotone_and_means_are_kept():
    rng = np.random.default_rng(1)
    z = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * z))).astype(float)
    knots, values = T.isotonic(z, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and values.min() > 0 and values.max() < 1


@needs_data
def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = T.op6_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if not r["toxic"]], [r["score"] for r in rows if r["toxic"]]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.85
    assert sum(s >= T.PREDICT_FROM for s in good) <= 0.02 * len(good)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1)], "doc_id bigint, toxic int")
    model = T.learn(odd, labels, F.lit(True))
    rows = T.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.scored(none, model).collect() == []
    assert T.learn(odd, labels.limit(0), F.lit(True)).trees == []


def test_long_tokens_take_linear_time():
    import time

    start = time.monotonic()
    for text in ("!a" + "1" * 200_000, "a" * 200_000 + "!", "1" * 200_000 + "a", "a1" * 100_000, "!" * 200_000, "a!" * 100_000 + " x"):
        T.features(text, T.Weights({}))
    assert time.monotonic() - start < 5
    assert T.mixed("hello! st0p 5tupid ab1 v2 @x ¡a! b@d_ 42 a_b") == ["st0p", "5tupid", "b@d"]


def test_lexicon_of_repeated_ids_does_not_depend_on_order(spark):
    rows = [(i, f"good day number {i}") for i in range(60)] + [(i, f"vile vile wretch {i}") for i in range(60, 120)] + [(60, "good day again")] * 3
    labels = [(i, int(i >= 60)) for i in range(120)] + [(60, 0)]
    found = []
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], "doc_id bigint, text string")
        model = T.learn(docs, spark.createDataFrame(labels[::order], "doc_id bigint, toxic int"), F.lit(True))
        found.append((model.lexicon, model.start, [t.value for t in model.trees], model.knots.tolist()))
    assert found[0] == found[1] and "vile" in found[0][0] and "good" not in found[0][0]


def test_trees_learn_a_threshold():
    x = np.random.default_rng(2).random((400, 12))
    y = (x[:, 3] > 0.6).astype(float)
    trees, start = T.boost(x, y)
    z = start + sum(t.predict(x) for t in trees)
    assert ((z > 0) == (y > 0)).mean() > 0.98
