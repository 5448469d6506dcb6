"""Best-fit packing of token sequences by planning on the histogram of lengths.

Documents become pieces of at most LIMIT tokens.  Only counts by length (at most LIMIT numbers) reach the
driver, where best-fit decreasing runs over counts: sequences with the same fill are one class, and a step
moves as many sequences of a class at once as there are pieces of the length.  The plan is a list of runs:
pieces of one length with ranks r..r+n go to consecutive sequences of a class.  Pieces take their slots by
joining on their rank within their length.

A piece's rank is its rank within a share of its length, plus the sizes of earlier shares, so that a length
that a third of all pieces has is still ranked in parallel.

Defined results: a null or empty text is one piece, the end token; a document of over LIMIT tokens alone, however
long, is cut; of pieces of one length the order by share, doc_id, piece and crc decides, and pieces equal in all these
are interchangeable; rows that repeat a doc_id are packed each for itself; an empty table gives an empty result; other
columns are ignored here, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table, written

VOCABULARY = "word_bpe_49k.json"
LIMIT = 4096
END_ID = 1
#: Words a task remembers; then it starts anew.
MOST_WORDS = 500_000
#: Parts words that are encoded together; one token of the vocabulary.
MARK = "\u2665"
#: Rows of a batch that are tokenized at once.
ROWS = 256
#: Pieces in a share of a length, about; see above.
SHARE = 1_000
#: Runs that are broadcast at most (some 40 bytes each); a longer plan is joined by shuffle.
MOST_BROADCAST_RUNS = 200_000


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(2)
def bare_tokenizer(path: str):
    """The tokenizer without its normaliser, for texts that it would only lower-case."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.normalizer = None
    return found


def is_latin(text: str) -> bool:
    """Whether a text has characters below U+0100 alone: composed already, and lower-cased one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: ASCII marks that never stand in one token with a letter or digit before them; ' may, as in it's.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Words(dict):
    """word -> its number among the words of a task.

    `fresh` gets each new word, or the numbers of the words that it is made of: the marks at its end stand alone
    after an ASCII letter or digit, and ASCII letters are the same in either case.
    """

    def __init__(self):
        self.fresh: list[bytes | tuple[int, ...]] = []
        self.next = 0

    def __missing__(self, word: bytes) -> int:
        core = word.rstrip(TAIL)
        low = core.lower() if core.isascii() else core
        if core and len(core) < len(word) and core[-1] in ALNUM:
            new = (self[low], self[word[len(core) :]])
        elif low != core and len(core) == len(word):
            new = (self[low],)
        else:
            new = word
        self[word] = number = self.next
        self.next += 1
        self.fresh.append(new)
        return number


def encoded(words: list[str], path: str) -> Iterator[bytes]:
    """Each word's ids as little-endian bytes.  Many words are encoded as one text, parted by a mark of one token."""
    found = tokenizer(path)
    mark = found.encode(MARK, add_special_tokens=False).ids
    if len(mark) != 1 or any(MARK in x for x in words):
        for x in found.encode_batch_fast(words, add_special_tokens=False):
            yield array("I", x.ids).tobytes()
        return
    for block in (words[at : at + 1000] for at in range(0, len(words), 1000)):
        text, bare = f" {MARK} ".join(block), is_latin("".join(block))
        x = (bare_tokenizer(path) if bare else found).encode_batch_fast([text.lower() if bare else text], add_special_tokens=False)[0]
        ids = np.array(x.ids, "<u4")
        joined, cuts = ids.tobytes(), np.flatnonzero(ids == mark[0])
        if len(cuts) != len(block) - 1:
            raise AssertionError("words and marks don't match")
        for start, end in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(joined)], strict=True):
            yield joined[start:end]


def _tokens(path: str, end_id: int) -> Callable[[list[bytes]], Iterator[bytes]]:
    """A function that gives each text's ids as little-endian bytes, the end id included.

    The vocabulary's rules drop white space and never join what it parts, so that the ids of a text are those
    of its space-parted words; each distinct word is encoded once.
    """
    known, ids = Words(), []
    end = array("I", [end_id]).tobytes()

    def run(texts: list[bytes]) -> Iterator[bytes]:
        nonlocal known, ids
        if len(known) > MOST_WORDS:
            known, ids = Words(), []
        numbers = [[known[x] for x in text.split()] for text in texts]
        plain = encoded([x.decode() for x in known.fresh if isinstance(x, bytes)], path)
        for x in known.fresh:
            ids.append(next(plain) if isinstance(x, bytes) else b"".join([ids[i] for i in x]))
        known.fresh = []
        for at in numbers:
            yield b"".join([ids[x] for x in at]) + end

    return run


def _pieces(path: str, limit: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens(path, end_id)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = []
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens(texts), strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(documents: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_pieces(path or public_tokenizers.path(VOCABULARY), limit, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], limit: int = LIMIT) -> pd.DataFrame:
    """Best-fit decreasing over counts by length: length, rank (of the run's first piece), n (pieces), per (pieces
    that lie side by side in one sequence), sequence (the first), offset (in each sequence).

    `open_` has the classes of sequences by what they have left: (first sequence, number of sequences).
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(limit + 1, bool)  # which of them has any
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            rooms[room] = True

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
            else:
                room, first, n = limit, fresh, -(-left // (limit // length))
                fresh += n
            per = room // length  # best fit goes on with the sequence just filled, as it has the least room
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, limit - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            rest = min(left, per - 1) if full < n else 0
            if rest:
                runs.append((length, rank, rest, rest, first + full, limit - room))
                put(room - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
            put(room, first + full + bool(rest), n - full - bool(rest))
    return pd.DataFrame(runs, columns=["length", "rank", "n", "per", "sequence", "offset"], dtype="int64")


def ranked(found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """found with the column rank: each piece's number, from 0, within its length."""
    # Each length has as many shares as its pieces need; a row for each of `limit` lengths at most.
    shares = found.sparkSession.createDataFrame([(n, max(1, -(-k // SHARE))) for n, k in counts.items()], "length bigint, shares bigint")
    share = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("shares")).cast("int")
    shared = found.join(F.broadcast(shares), "length").withColumn("share", share).drop("shares").select(*found.columns, "share")
    sizes = shared.groupBy("length", "share").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "share", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = shared.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(before, ["length", "share"]).withColumn("rank", F.col("within") + F.col("before")).drop("share", "within", "before")


def packed(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """found (written pieces) with sequence_id and offset."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # limit rows at most
    runs = plan(counts, limit)
    slots = spark.createDataFrame(pa.Table.from_pandas(runs.rename(columns={"length": "of", "rank": "from"}), preserve_index=False)) if len(runs) else spark.createDataFrame([], "of bigint, from bigint, n bigint, per bigint, sequence bigint, offset bigint")
    slots = F.broadcast(slots) if len(runs) <= MOST_BROADCAST_RUNS else slots
    after = F.col("rank") - F.col("from")
    inside = (F.col("length") == F.col("of")) & (after >= 0) & (after < F.col("n"))
    taken = ranked(found, counts).join(slots, inside)
    return taken.select(
        *found.columns,
        (F.col("sequence") + F.floor(after / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("offset") + F.pmod(after, F.col("per")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    return packed(written(pieces(documents, limit=limit), "pieces"), limit)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
