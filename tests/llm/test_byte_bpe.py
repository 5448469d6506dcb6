import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from helixframe.llm import byte_bpe as B

PATH = P.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.ranks(PATH), special_tokens={})


def test_round_trip_of_odd_rows(spark, odd, reference):
    more = spark.createDataFrame([(50, "it's we'll  \n\n  x\t" * 40), (51, "a" * 300 + "ab" * 300), (52, "   \u0007 é" * 9)], "doc_id bigint, text string")
    rows = odd.select("doc_id", "text").unionByName(more)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = B.round_trip(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode() and r["n_tokens"] == len(r["ids"]) // 4


def test_empty_table(none):
    assert B.round_trip(none).collect() == []


def test_dictionary_restarts(monkeypatch, reference):
    monkeypatch.setattr(B, "MOST_WORDS", 5)
    monkeypatch.setattr(B, "ROWS", 4)
    texts = [f"alpha{i} beta{i % 3} gammadelta{i % 7} zeta {'q' * 300}" for i in range(40)]
    split = list(B._split(PATH, P.PATTERN)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})])))
    assert sum(sum(b.column(2).to_pylist()) for b in split) > 3

    def merge(w):  # the fold, in plain Python
        ids = [x & (1 << B.ID_BITS) - 1 for x in w[1:-1]]
        while True:
            pairs = [(B.pair_ranks(PATH).get(p, B.NO_RANK), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))]
            if not pairs or min(pairs)[0] == B.NO_RANK:
                return [B.EDGE, *ids, B.EDGE]
            rank, i = min(pairs)
            ids[i : i + 2] = [rank]

    done = [b.set_column(3, "w", pa.array([None if w is None else merge(w) for w in b.column(3).to_pylist()], pa.list_(pa.int64()))) for b in split]
    got = {i: np.frombuffer(x, "<u4").tolist() for b in B._assemble(PATH)(iter(done)) for i, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert got == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_heap_equals_the_library(reference):
    rng = np.random.default_rng(5)
    for _ in range(300):
        word = bytes(rng.choice(np.frombuffer("abcinthes é".encode(), np.uint8), rng.integers(1, 60)))
        assert B.merged_by_heap(word, B.ranks(PATH)) == reference._encode_single_piece(word)


def test_pair_map_holds_every_pair():
    rows, entries = (np.array(x.split(","), np.int64) for x in B.displaced(PATH))
    for (a, b), rank in B.pair_ranks(PATH).items():
        assert entries[rows[a] + b] == (a << B.ID_BITS | b) << B.ID_BITS | rank
