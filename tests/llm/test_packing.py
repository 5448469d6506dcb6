import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing as K


def slots(runs):
    for r in runs.itertuples():
        for i in range(r.n):
            yield r.length, r.rank + i, r.sequence + i // r.per, r.offset + i % r.per * r.length


def best_fit_decreasing(lengths, limit):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= x]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(limit - x)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_plan_is_gapless_and_complete(counts):
    found = defaultdict(list)
    ranks = defaultdict(set)
    for length, rank, sequence, offset in slots(K.plan(counts, 40)):
        found[sequence].append((offset, length))
        ranks[length].add(rank)
    assert {x: len(r) for x, r in ranks.items()} == counts and all(r == set(range(counts[x])) for x, r in ranks.items())
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert len(found) == best_fit_decreasing([x for x, n in counts.items() for _ in range(n)], 40)


def test_pieces_and_places(odd):
    tokenizer = K.tokenizer(P.path(K.VOCABULARY))
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = defaultdict(list)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, K.END_ID], "<u4")
        for at in range(0, len(ids), K.LIMIT):
            part = ids[at : at + K.LIMIT]
            want[i, at // K.LIMIT].append((at, len(part), zlib.crc32(part.tobytes())))
    got, by = defaultdict(list), defaultdict(list)
    for r in K.pack(odd).collect():
        got[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= K.LIMIT


def test_empty_table(none):
    assert K.pack(none).collect() == []


def test_marks_and_odd_words_are_encoded_alone():
    path = P.path(K.VOCABULARY)
    words = ["it's", "x" + K.MARK, K.MARK, " ", "<|endoftext|>", "a1b2", "ÀÉ"]
    one = [K.tokenizer(path).encode(x, add_special_tokens=False).ids for x in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in K.encoded(words, path)] == one
    plain = [x for x in words if K.MARK not in x]
    assert [np.frombuffer(x, "<u4").tolist() for x in K.encoded(plain, path)] == [o for o, x in zip(one, words, strict=True) if K.MARK not in x]


def test_bare_words_have_the_same_ids():
    path = P.path(K.VOCABULARY)
    words = [f"x{chr(c)}{chr(c)}Y" for c in range(33, 256)] + [chr(c) for c in range(33, 256)]
    got = [np.frombuffer(x, "<u4").tolist() for x in K.encoded(words, path)]
    assert got == [K.tokenizer(path).encode(x, add_special_tokens=False).ids for x in words]


def test_words_made_of_others_have_the_same_ids():
    path = P.path(K.VOCABULARY)
    tokenizer = K.tokenizer(path)
    texts = ["Foo, FOO. foo### x'S, it's... A.B-C. 12.5% é, é: ## a_ <|endoftext|>, h\u0331! H\u0331, 'tis, o' ' '' ,", "K\u0301. \u212a, İ! ſs."]
    got = [np.frombuffer(x, "<u4").tolist()[:-1] for x in K._tokens(path, 1)([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_hot_length_is_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARE", 50)
    df = spark.createDataFrame([(i, "one two") for i in range(700)] + [(1000 + i, "three") for i in range(20)], "doc_id bigint, text string")
    rows = K.pack(df, 10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 720
    assert len({r["sequence_id"] for r in rows}) == best_fit_decreasing([r["length"] for r in rows], 10)
