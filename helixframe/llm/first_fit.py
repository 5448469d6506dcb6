"""First-fit decreasing packing with a tournament tree of bin capacities, independently in random groups of documents.

1. Documents are encoded; their ids (two bytes each) are written with their counts.
2. Each row goes to a group by a hash of its place in that table: some GROUP_ROWS rows a group, whatever ids or texts
   repeat, so that the number of groups grows with the input and their size does not.
3. A group's documents are cut into full sequences and a remainder.  Remainders go in falling order to the first
   sequence that has room, which the tree finds in a logarithmic number of steps.  Then the contents of the emptiest
   sequences fill the gaps of the others, cut where they must be, and what is left of the last one is dealt over
   sequences whose lengths are powers of two, which are not padded.  So a group has no padding at all.

Words are encoded once for each worker that meets them: white space aside, a token never crosses the space between two
words, and that space belongs to the second.

Defined results: a null or empty text is one piece, the end token; documents of any length are cut; of equally long
remainders the smaller doc_id (null first), then the ids decide; rows that repeat a doc_id are packed each for itself; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import fresh_path, in_small_batches, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 2048
END_ID = 1
#: Rows of a group, about.
GROUP_ROWS = 1024
#: Words a worker remembers; then it starts anew.
MOST_WORDS = 600_000
#: Rows of a batch that are encoded at once.
ROWS = 256
#: A space beside other white space; texts without it are words parted by single spaces.
BESIDE = re.compile("[ ][\\s\u180e]|[\\s\u180e][ ]")
SINGLE = re.compile("(?<=[^\\s\u180e])[ ](?=[^\\s\u180e])")
#: Bytes of visible ASCII characters and, with C3 before them, of the letters U+00C0 to U+00FF.
PLAIN = bytes([*range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3])
#: Bytes of which no white space but the space and the newline can be made.
USUAL = bytes(c for c in range(256) if c not in b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(2)
def ranked(path: str):
    """The same vocabulary as ranks, for words of Latin letters; None if ids are not in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # The vocabulary writes bytes as characters: printable ones as themselves, the others from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    if [model["vocab"][x] for x in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(of_char[c] for c in x): i for x, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The ids of texts, two bytes each; the dictionaries of words start anew when they are full."""

    def __init__(self, path: str):
        self.tokenizer, self.ranked = tokenizer(path), ranked(path)
        self.restart()

    def restart(self) -> None:
        self.first: dict[bytes, bytes] = {}  # of words at the begin of a text
        self.words: dict[bytes, bytes] = {}  # of words after a space

    def learn(self, known: dict[bytes, bytes], before: str, fresh: set[bytes]) -> None:
        """Adds the words of fresh.  Plain ones are encoded as one text, parted by newlines, which are one token each
        and stand apart from what is before and after them."""
        plain = [x for x in fresh if x and not x.translate(None, PLAIN)] if self.ranked else []
        if plain:
            ids = self.ranked.encode_to_numpy((before.encode() + f"\n{before}".encode().join(plain)).decode())
            data, cuts = ids.astype("<u2").tobytes(), (2 * np.flatnonzero(ids == self.newline())).tolist()
            if len(cuts) != len(plain) - 1:
                raise AssertionError("words and newlines don't match")
            known.update(zip(plain, [data[a:b] for a, b in zip([0, *(x + 2 for x in cuts)], [*cuts, len(data)], strict=True)], strict=True))
        for word in fresh.difference(plain):
            text = before + word.decode()
            latin = self.ranked and (text.isascii() or max(text) < "\u0100")
            ids = self.ranked.encode_ordinary(text) if latin else self.tokenizer.encode(text, add_special_tokens=False).ids
            known[word] = array("H", ids).tobytes()

    def newline(self) -> int:
        return self.ranked.encode_ordinary("\n")[0]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) + len(self.first) > MOST_WORDS:
            self.restart()
        rows = [words_of(x) for x in texts]
        firsts = [x.pop(0) for x in rows]
        self.learn(self.first, "", {*firsts}.difference(self.first))
        self.learn(self.words, " ", set().union(*rows).difference(self.words))
        known = self.words.__getitem__
        return [self.first[a] + b"".join(map(known, x)) for a, x in zip(firsts, rows, strict=True)]


def words_of(text: bytes) -> list[bytes]:
    """text cut at its single spaces, which are left out."""
    beside = b"  " in text or b" \n" in text or b"\n " in text or text.translate(None, USUAL) and BESIDE.search(text.decode())
    return [x.encode() for x in SINGLE.split(text.decode())] if beside else text.split(b" ")


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _encoded(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), array("H", [end_id]).tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = [x + end for x in encode([x.as_py() or b"" for x in batch.column(1).cast(pa.binary())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "doc_tokens", "ids"])

    return run


def encoded(documents: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, ids (little-endian unsigned 16-bit, the end id last) of each row."""
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoded(path or public_tokenizers.path(VOCABULARY), end_id), "doc_id bigint, doc_tokens bigint, ids binary")


def first_fit(lengths: list[int], limit: int) -> list[int]:
    """The bin of each length: the first that has room.  Node i of the tree has the most room of nodes 2i and 2i + 1."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room, found = [limit] * (2 * leaves), []
    for length in lengths:
        at = 1
        while at < leaves:
            at *= 2
            at += room[at] < length
        found.append(at - leaves)
        room[at] -= length
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return found


Piece = tuple[int, int, int]  # row, start, length


def without_gaps(bins: list[list[Piece]], limit: int) -> list[list[Piece]]:
    """bins, the contents of the emptiest moved to the gaps of the others; the last one's dealt by powers of two."""
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted((i for i in range(len(bins)) if fill[i] < limit), key=lambda i: -fill[i])
    found = [b for b, n in zip(bins, fill, strict=True) if n == limit]
    a, z = 0, len(order) - 1
    while a < z:
        to, source = bins[order[a]], bins[order[z]]
        gap = limit - fill[order[a]]
        row, start, length = source.pop()
        part = min(gap, length)
        to.append((row, start, part))
        fill[order[a]] += part
        if part < length:
            source.append((row, start + part, length - part))
        if fill[order[a]] == limit:
            found.append(to)
            a += 1
        if not source:
            z -= 1
    if a == z:
        pieces = bins[order[a]][::-1]
        for power in (1 << k for k in reversed(range(limit.bit_length()))):
            if sum(p[2] for p in pieces) < power:
                continue
            found.append([])
            while power:
                row, start, length = pieces.pop()
                part = min(power, length)
                found[-1].append((row, start, part))
                power -= part
                if part < length:
                    pieces.append((row, start + part, length - part))
    return found


def packed_group(lengths: list[int], limit: int) -> list[list[Piece]]:
    """The sequences of rows of these lengths, which come in falling order of length % limit."""
    full = [[(row, at, limit)] for row, n in enumerate(lengths) for at in range(0, n - n % limit, limit)]
    rest = [(row, n - n % limit, n % limit) for row, n in enumerate(lengths) if n % limit]
    bins: list[list[Piece]] = []
    for piece, at in zip(rest, first_fit([p[2] for p in rest], limit), strict=True):
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return full + without_gaps(bins, limit)


PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(limit: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "grp")), strict=True))
        rows.sort(key=lambda r: (-(r[1] % limit), r[0] is not None, r[0] or 0, r[1], r[2]))
        out: list[tuple] = []
        for number, pieces in enumerate(packed_group([r[1] for r in rows], limit)):
            at = 0
            for row, start, length in pieces:
                doc_id, tokens, ids, grp = rows[row]
                part = np.frombuffer(ids, "<u2", length, 2 * start).astype("<u4").tobytes()
                out.append((doc_id, start, length, zlib.crc32(part), tokens, grp << 32 | number, at))
                at += length
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names=[x.split()[0] for x in PACKED.split(", ")])

    return run


def pack(documents: DataFrame, limit: int = LIMIT, path: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, at = documents.sparkSession, fresh_path(documents.sparkSession, "ids")
    encoded(documents, path).write.option("compression", "zstd").parquet(at)
    rows = spark.read.schema("doc_id bigint, doc_tokens bigint, ids binary").parquet(at)
    groups = max(1, -(-rows.count() // group_rows))
    group = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(groups))
    return rows.select("doc_id", "doc_tokens", "ids", group.alias("grp")).groupBy("grp").applyInArrow(_packed(limit), PACKED)


def op11_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
