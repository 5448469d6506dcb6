import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import importance as K


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, run=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(rows, targets, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) by the definition, row by row."""
    of = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(of(f) for _, x in rows for f in features(x)), Counter(of(f) for x in targets for f in features(x))
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(of(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def got(df):
    return Counter(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()))


@settings(max_examples=200, deadline=None)
@given(st.text("aB1 .é\x00-İx", max_size=60), st.integers(1, 4), st.integers(1, 8))
def test_ring_gives_the_crc_of_each_run(text, run, block):
    K.BLOCK, whole = block, K.BLOCK
    try:
        crc, n = K.crcs(text.encode(), run)
    finally:
        K.BLOCK = whole
    assert n == len(words(text))
    assert sorted(crc.tolist()) == sorted(crc32(f.encode()) for f in features(text, run))


def test_resampled_is_brute_force(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(100 + i, f"alpha beta{i % 7} gamma " * (3 + i % 40)) for i in range(120)] + [(None, "delta " * 30)] * 2 + [(5000, "same words here " * 9)] * 3
    docs = odd.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    targets = ["beta1 gamma alpha", "", None, "Then the cat; the CAT sat"]
    aim = odd.sparkSession.createDataFrame([(x,) for x in targets], "text string")
    assert got(K.resampled(docs, aim)) == brute(rows, targets)


def test_query_is_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    assert got(K.op13_importance_resampling(spark, data)) == brute(rows, targets)


def test_ties_at_the_bound(spark):
    rows = [(1, "one two " * 10)] * 40 + [(2, "one two " * 10)] * 8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    aim = spark.createDataFrame([("one",)], "text string")
    assert got(K.resampled(docs, aim)) == brute(rows, ["one"])


def test_columns_of_any_name_and_empty_tables(odd, none):
    aim = none.select("text")
    docs = odd.withColumnsRenamed({"fp": "rank", "node": "score", "kept": "range", "label": "drawn_id"})
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(K.resampled(docs, aim)) == brute(plain, [])
    drawn = K.sample(docs, aim)
    assert drawn.columns == docs.columns
    ids = {r[0] for r in brute(plain, []) if r[4]}
    assert {r["doc_id"] for r in drawn.collect()} == ids
    assert K.resampled(none, aim).collect() == [] and K.resampled(none, odd).collect() == []


def test_gains_are_floored():
    assert K.gains(np.array([0, 3]), np.array([0, 1])).tolist() == [math.floor(1000 * math.log(1 * 3 / (1 * 5))), math.floor(1000 * math.log(4 * 3 / (2 * 5)))]
