import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import first_fit as K

PATH = P.path(K.VOCABULARY)


def plain_first_fit(lengths, limit):
    rooms, found = [], []
    for x in lengths:
        at = next((i for i, room in enumerate(rooms) if room >= x), len(rooms))
        if at == len(rooms):
            rooms.append(limit)
        rooms[at] -= x
        found.append(at)
    return found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_tree_finds_the_first_bin_with_room(lengths):
    lengths.sort(reverse=True)
    assert K.first_fit(lengths, 40) == plain_first_fit(lengths, 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_group_is_whole_and_without_padding(lengths):
    lengths.sort(key=lambda n: -(n % 64))
    seen = defaultdict(list)
    for pieces in K.packed_group(lengths, 64):
        total = sum(p[2] for p in pieces)
        assert total == 64 or total < 64 and total & (total - 1) == 0
        for row, start, length in pieces:
            assert length > 0
            seen[row].append((start, length))
    assert sorted(seen) == list(range(len(lengths)))
    for row, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == lengths[row]


def test_documents_that_fit_are_not_cut_without_need():
    assert K.packed_group([60, 50, 14, 4], 64) == [[(0, 0, 60), (3, 0, 4)], [(1, 0, 50), (2, 0, 14)]]


TEXTS = ["", " ", "a", "  a", "a  b", "a \n b", "a\n\nb c", "\n", " \n", "\n ", "a ", "it's we'll x'", "a.b, c... d!?", "12 345a b6 7", "café Über año ¿qué? « x »", "a\xa0b \xa0 c", "x y  ", "日本 語 🙂 a", "a\tb \t c", "a\x1c b \x1cc", "<|endoftext|> x", "a\x85 b", "\u180e x \u180e", "don't' 's 'S", "_a_ b_", "a- -b -- c", "² ³x ½"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(TEXTS), st.text(max_size=40), st.text("ab \n\t.'’é²1\xa0", max_size=30)))
def test_ids_are_the_tokenizer_s(text):
    want = K.tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(K.Encoder(PATH)([text.encode()])[0], "<u2").tolist() == want


def test_known_words_have_the_same_ids():
    encode, found = K.Encoder(PATH), K.tokenizer(PATH)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(TEXTS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(8)))
        assert np.frombuffer(encode([text.encode()])[0], "<u2").tolist() == found.encode(text, add_special_tokens=False).ids


def test_dictionary_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "MOST_WORDS", 5)
    encode = K.Encoder(PATH)
    for i in range(30):
        text = f"one{i} two three{i}."
        assert np.frombuffer(encode([text.encode()])[0], "<u2").tolist() == K.tokenizer(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("group_rows", [4, 1024])
def test_pieces_and_places(odd, group_rows):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()] + [(None, "no id"), (None, "no id")]
    docs = odd.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    want = defaultdict(list)
    for i, text in rows:
        want[i].append([*K.tokenizer(PATH).encode(text, add_special_tokens=False).ids, K.END_ID])
    got, by = defaultdict(list), defaultdict(list)
    for r in K.pack(docs, group_rows=group_rows).collect():
        got[r["doc_id"]].append(r)
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for i, texts in want.items():
        assert sum(r["length"] for r in got[i]) == sum(map(len, texts))
        assert {r["doc_tokens"] for r in got[i]} == set(map(len, texts))
        assert all(any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in texts if len(x) == r["doc_tokens"]) for r in got[i])
        if len(texts) == 1:
            at = 0
            for r in sorted(got[i], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == K.LIMIT or at < K.LIMIT and at & (at - 1) == 0


def test_repeated_rows_are_dealt_over_groups(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 200, "doc_id bigint, text string")
    rows = K.pack(docs, group_rows=20).collect()
    assert sum(r["length"] for r in rows) == 200 * len([*K.tokenizer(PATH).encode("one two three", add_special_tokens=False).ids, 1])
    assert len({r["sequence_id"] >> 32 for r in rows}) > 5


def test_empty_table(none):
    assert K.pack(none).collect() == []
