import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.sources import packed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", min_size=1, max_size=40).map(lambda s: s * 3), st.booleans()), max_size=6))
def test_round_trip(reads):
    rows = [(s, "".join(chr(33 + (i // 9) % 40) for i in range(len(s))) if q else None) for s, q in reads]
    data = b"".join(packed.pack(*r) for r in rows)
    assert [x[1:] for x in packed.unpack(data)] == rows


def test_long_runs_and_odd_letters():
    seq, qual = "A" * 1000 + "acgt-*", "I" * 700 + "#" * 306
    (name, got, back), = packed.unpack(packed.pack(seq, qual), "/1")
    assert (name, got, back) == ("read_1/1", "A" * 1000 + "ACGTNN", qual)
    assert packed.pack("") == b"" and packed.pack("ACGT", "II")[3] >> 7 == 0


def test_known_bytes():
    # A, C, G, T as symbols 1, 3, 7, 20; their steps 1, 2, 4, 19.
    assert packed.pack("ACGT") == bytes([0, 0, 4, 0, 0, 4, 1, 2, 4, 19])
    assert packed.pack("AAAAAAAA") == bytes([0, 0, 2, 0, 0, 8, 0x61, 0])


@pytest.mark.parametrize("cut", [3, 7, 9])
def test_truncated_data_is_an_error(cut):
    with pytest.raises(ValueError, match="truncated"):
        list(packed.unpack(packed.pack("ACGTACGT", "IIII####")[:cut]))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGT", "IIII"), (2, "GGGG", None)], "n int, seq string, qual string")
    data = b"".join(bytes(r["record"]) for r in packed.packed_records(df, "seq", "qual", ["n"]).collect())
    (tmp_path / "reads.bin").write_bytes(data)
    assert [(r["ord"], r["header"], r["seq"], r["qual"]) for r in packed.read_packed(spark, str(tmp_path / "reads.bin")).orderBy("ord").collect()] == [(0, "read_1", "ACGT", "IIII"), (1, "read_2", "GGGG", None)]
