import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import spelling as K


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def is_near(a, b):
    """By the definition, without halves."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) != len(b):
        return min(a, b, key=len) in deletions(max(a, b, key=len))
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1


def brute(rows):
    n = brute_words(rows)
    by = {}
    for w in n:  # words that share a deletion or are one, so that whole tables can be compared
        for d in {w, *deletions(w)}:
            by.setdefault(d, set()).add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a, b in combinations(group, 2):
            if is_near(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9))
def test_one_edit_is_the_definition(a, b):
    assert K.one_edit(a, b) == is_near(a, b)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=7, max_size=12), max_size=60), st.booleans())
def test_a_shard_finds_each_pair_once(words, hot):
    """All halves in one shard; with hot halves each end of the rest is an owner of its own."""
    rows = [(w, i + 2, kind, end) for i, w in enumerate(sorted(words)) for kind in (0, 1) for end in ((0, 1) if hot else (-1,))]
    rows += [(w, None, None, None) for w in words]
    both = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([("word", pa.string()), ("n", pa.int64()), ("kind", pa.int32()), ("end", pa.int32())])})
    found = K._shard(both).to_pylist()
    want = {w: sum(is_near(w, x) for x in words) for w in words}
    assert {r["word"]: r["n_near"] for r in found} == {w: k for w, k in want.items() if k}


def chain_rows():
    """Forms of forms; ties; words of seven letters whose variants are too short; repeats and nulls."""
    rows = []
    for word, n in [("abcdefghij", 3000), ("abcdefghik", 250), ("abcdefghlk", 20), ("abcdefgmlk", 2), ("zzzzzzz", 40), ("zzzzzzy", 40), ("zzzzzzzz", 4), ("cafétéria", 50), ("cafetéria", 3), ("Straßenbahn", 30), ("straßenbahn", 2)]:
        rows += [(len(rows) + i, f"{word} x, {word}1{word.upper()}" if i % 2 else word) for i in range(n)]
    return rows + [(None, "nothing abcdefghij"), (None, None), (5, ""), (5, None)]


def test_variants_are_brute_force(odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + chain_rows()
    docs = odd.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert got(K.variants(docs)) == want
    assert len({x[1] for x in want.values() if x[0]}) > 1


def test_hot_halves_are_dealt_by_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_WORDS", 40)
    monkeypatch.setattr(K, "hot_bound", lambda total: 20)
    letters = "abcdefgh"
    words = [f"common{a}{b}{c}" for a in letters for b in letters for c in letters] + [f"{a}{b}{c}ending" for a in letters for b in letters for c in letters[:3]]
    rows = [(i, f"{w} {w}") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(K.variants(docs)) == brute(rows)


def test_counts_are_handed_on_when_full(spark, monkeypatch):
    rows = chain_rows()[::7]
    monkeypatch.setattr(K, "MOST_WORDS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(K, "ROWS", 10)
    total = Counter()
    parts = list(K._count(iter([batch])))
    for part in parts:
        for r in part.to_pylist():
            total[r["word"]] += r["n"]
    assert len(parts) > 3 and {w: k for w, k in total.items() if k >= 2} == brute_words(rows)


def test_query_is_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got(K.op12_spelling_variants(spark, data)) == brute(rows)


def test_empty_table(none):
    assert K.variants(none).collect() == []
