"""Byte-level BPE encoding and decoding.

Words (matches of the public pattern) are encoded once for each task that meets them.  Per task:

1. An Arrow function splits whole texts and numbers the distinct words.  Words that are tokens have their
   token's number; each other one comes out as a row of its own when first met, as the array of its bytes'
   tokens, before the row of its text, which carries its words' numbers.
2. Spark folds ranked merges over these arrays.  The first ROUNDS merges of a word are that many projections,
   which run as compiled code; a higher-order fold does what is left.  Ranks come from a literal map of token
   pairs: two literal arrays (a sparse matrix whose rows are laid over one another), so that a lookup costs the
   same at any vocabulary size.  They are session variables, so that all uses share them.  A merge looks up
   only the two pairs it makes.
3. A second Arrow function, in the same task and order, joins the ids and the decoded pieces of each text's words.

Nothing is shuffled, broadcast or collected.  A task's dictionary restarts when it has MOST_WORDS words, so
its memory is bounded.  Words over LONG_WORD bytes, for which a fold takes time as the square of the length,
have their merges ordered by a heap instead, with the same result.

Defined results: of equally ranked pairs the leftmost is merged first; a null or empty text has no tokens (the hashes are those of no bytes); rows that repeat a
doc_id each come out; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_WORDS = 400_000
LONG_WORD = 256
#: Merges of a word that run as projections; higher-order functions do the rest.
ROUNDS = 10
#: A word in the fold is an array of longs, one for each token: the rank of its pair with the next token, where
#: it starts in the word, its id, from the highest bits to the lowest.  Ids and ranks have ID_BITS, starts START_BITS.
ID_BITS, START_BITS = 20, 14
LOW_BITS = ID_BITS + START_BITS
#: Rank of a pair that the map lacks; an id that no token has, which stands at both ends of a word.
NO_RANK, EDGE = 1 << ID_BITS, (1 << ID_BITS) - 2
#: Rows of a batch that are split at once.
ROWS = 256


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(2)
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """Ranks of pairs of tokens: that of their joined bytes."""
    vocabulary, found = ranks(path), {}
    for piece, rank in vocabulary.items():
        for at in range(1, len(piece)):
            a, b = vocabulary.get(piece[:at]), vocabulary.get(piece[at:])
            if a is not None and b is not None:
                found[a, b] = rank
    return found


@lru_cache(2)
def displaced(path: str) -> tuple[str, str]:
    """The map of pair ranks as two lists: rows by first id, entries (pair << ID_BITS | rank) by row + second id.

    Rows are laid over one another where their entries don't meet, those with most entries first.
    """
    by_row: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pair_ranks(path).items():
        by_row.setdefault(a, []).append((b, (a << ID_BITS | b) << ID_BITS | rank))
    size = len(pair_ranks(path)) * 2 + (1 << 19)
    entries, rows = np.full(size, (1 << 3 * ID_BITS) - 1, np.int64), np.zeros(max(by_row) + 1, np.int64)
    free, begin, power = np.arange(1 << 16, size), 0, 0
    for a in sorted(by_row, key=lambda a: (-len(by_row[a]), a)):
        seconds, values = (np.array(x) for x in zip(*by_row[a], strict=True))
        if len(seconds).bit_length() != power:  # rows half as long can go where longer ones couldn't
            free, begin, power = free[entries[free] == entries[-1]], 0, len(seconds).bit_length()
        for at in range(begin, len(free), 256):
            shift = free[at : at + 256] - seconds[0]
            places = shift[:, None] + seconds
            fits = (places < size - 1).all(axis=1) & (entries[np.minimum(places, size - 1)] == entries[-1]).all(axis=1)
            if fits.any():
                rows[a] = shift[int(fits.argmax())]
                entries[rows[a] + seconds] = values
                begin = at
                break
        else:
            raise ValueError("the rows don't fit")
    used = int(np.flatnonzero(entries != entries[-1])[-1]) + 1
    return ",".join(map(str, rows.tolist())), ",".join(map(str, entries[:used].tolist()))


def rank_map(spark: SparkSession, path: str) -> Callable[[Column, Column], Column]:
    """A function of two ids: the rank of their pair, or NO_RANK."""
    names = [f"bpe_{part}_{hashlib.sha256(path.encode()).hexdigest()[:12]}" for part in ("rows", "entries")]
    for name, values in zip(names, displaced(path), strict=True):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} ARRAY<BIGINT>")
        spark.createDataFrame([(values,)], "x string").createOrReplaceTempView(f"{name}_text")
        spark.sql(f"SET VAR {name} = (SELECT cast(split(x, ',') AS ARRAY<BIGINT>) FROM {name}_text)")
        spark.catalog.dropTempView(f"{name}_text")
    rows, entries = map(F.expr, names)

    def rank(a: Column, b: Column) -> Column:
        entry = F.get(entries, (F.get(rows, a.cast("int")) + b).cast("int"))
        # The entry's pair bits vanish in the xor if it is this pair's, and leave the rank.
        return F.least(entry.bitwiseXOR(F.shiftleft(F.shiftleft(a, ID_BITS).bitwiseOR(b), ID_BITS)), F.lit(NO_RANK).cast("bigint"))

    return rank


def merged(w: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """The word w (see ID_BITS) after its next merge, of the lowest rank and the leftmost of equal ones; w if none is left."""
    one_id = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1))
    low = lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    best = F.array_min(w)
    at = F.array_position(w, best).cast("int")  # from 1: of the token that becomes one with the next
    token, before = F.shiftright(best, LOW_BITS), F.get(w, at - 2)
    start = best.bitwiseAND(F.lit(((1 << START_BITS) - 1) << ID_BITS))
    left = F.shiftleft(rank(one_id(before), token), LOW_BITS).bitwiseOR(low(before))
    right = F.shiftleft(rank(token, one_id(F.get(w, at + 1))), LOW_BITS).bitwiseOR(start).bitwiseOR(token)
    new = F.concat(F.slice(w, F.lit(1), at - 2), F.array(left, right), F.slice(w, at + 2, F.lit(1 << 30)))
    return F.when(is_merged(w), w).otherwise(new)


def is_merged(w: Column) -> Column:
    return F.coalesce(F.array_min(w), F.lit(NO_RANK << LOW_BITS)) >= (NO_RANK << LOW_BITS)


def folded(words: DataFrame, path: str) -> DataFrame:
    """words with its column w after all merges."""
    rank = rank_map(words.sparkSession, path)
    # A higher-order function in a projection keeps it apart from the next: one method for all would be too long to compile.
    apart = F.exists(F.array().cast("array<bigint>"), lambda x: x > 0)
    for _ in range(ROUNDS):
        words = words.withColumn("w", F.when(apart, F.col("w")).otherwise(merged(F.col("w"), rank)))
    rest = F.aggregate(F.sequence(F.lit(3), F.size("w")), F.col("w"), lambda w, _: merged(w, rank))
    return words.withColumn("w", F.when(is_merged(F.col("w")), F.col("w")).otherwise(rest))


def merged_by_heap(word: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """What `encoded` gives, for long words: the lowest rank first, the leftmost of equal ones."""
    if word in vocabulary:
        return [vocabulary[word]]
    end = list(range(1, len(word) + 1))  # of the piece that starts here; 0: no piece starts here
    before = list(range(-1, len(word) - 1))

    def push(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := vocabulary.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    heap: list[tuple[int, int, int]] = []
    for a in range(len(word)):
        push(a)
    while heap:
        _, a, e = heapq.heappop(heap)
        b = end[a]
        if not b or b == len(word) or end[b] != e:
            continue
        end[a], end[b] = e, 0
        if e < len(word):
            before[e] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    found, a = [], 0
    while a < len(word):
        found.append(vocabulary[word[a : end[a]]])
        a = end[a]
    return found


class Numbers(dict):
    """word -> its token, or a number from `first` on; `fresh` gets the words that aren't tokens and are new."""

    def __init__(self, vocabulary: dict[bytes, int], first: int):
        self.vocabulary, self.next = vocabulary, first
        self.fresh: list[bytes] = []

    def __missing__(self, word: str) -> int:
        data = word.encode()
        number = self.vocabulary.get(data)
        if number is None:
            number = self.next
            self.next += 1
            self.fresh.append(data)
        self[word] = number
        return number


def _arrays(words: list[bytes], of_byte: np.ndarray, of_pair: np.ndarray, vocabulary: dict[bytes, int]) -> pa.ListArray:
    """Each word as the fold has it at first; long words as it leaves them."""
    short = [x if len(x) <= LONG_WORD else b"" for x in words]
    lengths = np.fromiter(map(len, short), np.int64, len(short)) + 2
    ends = lengths.cumsum()
    size = int(ends[-1]) if len(ends) else 0
    inner, last = np.ones(size, bool), np.zeros(size, bool)
    inner[ends - 1] = inner[ends - lengths] = False
    last[ends - 2] = True
    chars = np.zeros(size, np.int64)
    chars[inner] = np.frombuffer(b"".join(short), np.uint8)
    pair = np.full(size, NO_RANK)
    within = inner & ~last
    pair[within] = of_pair[chars[within], chars[1:][within[:-1]]]
    starts = np.arange(size) - np.repeat(ends - lengths, lengths)
    values = pair << LOW_BITS | starts << ID_BITS | np.where(inner, of_byte[chars], EDGE)
    if any(len(x) > LONG_WORD for x in words):
        parts = np.split(values, ends[:-1])
        edge = np.array([NO_RANK << LOW_BITS | EDGE])
        parts = [np.concatenate([edge, np.array(merged_by_heap(x, vocabulary), np.int64) | NO_RANK << LOW_BITS, edge]) if len(x) > LONG_WORD else p for x, p in zip(words, parts, strict=True)]
        values, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _split(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, vocabulary = regex.compile(pattern).findall, ranks(path)
        of_byte = np.array([vocabulary[bytes([c])] for c in range(256)], np.int64)
        of_pair = np.array([[vocabulary.get(bytes([a, b]), NO_RANK) for b in range(256)] for a in range(256)], np.int64)
        first = max(vocabulary.values()) + 1
        known = Numbers(vocabulary, first)
        names = ["doc_id", "numbers", "restart", "w"]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            restart = len(known) > MOST_WORDS
            if restart:
                known = Numbers(vocabulary, first)
            numbers = [array("i", [known[x] for x in find(text.as_py() or "")]).tobytes() for text in batch.column(1)]
            fresh, known.fresh = known.fresh, []
            n, m = len(fresh), batch.num_rows
            flags = pa.array([restart, *[False] * (n + m - 1)])
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), flags[:n], _arrays(fresh, of_byte, of_pair, vocabulary)], names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.binary()), flags[n:], pa.nulls(m, pa.list_(pa.int64()))], names=names)

    return run


def _assemble(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, rank in vocabulary.items():
            pieces[rank] = piece
        tokens = len(pieces)
        as_ids = [array("I", [x]).tobytes() for x in range(tokens)]  # by number
        as_bytes = list(pieces)
        for batch in batches:
            numbers, restarts, w = batch.column(1), np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)), batch.column(3)
            flat = w.values.to_numpy(zero_copy_only=False) & ((1 << ID_BITS) - 1)
            joined, flat, at = flat.astype("<u4").tobytes(), flat.tolist(), w.offsets.to_pylist()
            texts = np.asarray(numbers.is_valid())
            stops = np.unique(np.concatenate([[0, batch.num_rows], restarts, np.flatnonzero(np.diff(texts)) + 1]))
            for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                if a in restarts:
                    del as_ids[tokens:], as_bytes[tokens:]
                if not texts[a]:
                    for start, end in zip(at[a:b], at[a + 1 : b + 1], strict=True):  # the word lies between its edges
                        as_ids.append(joined[4 * start + 4 : 4 * end - 4])
                        as_bytes.append(b"".join([pieces[x] for x in flat[start + 1 : end - 1]]))
                    continue
                for low in range(a, b, ROWS):
                    high, ids, decoded = min(low + ROWS, b), [], []
                    for x in numbers.slice(low, high - low).to_pylist():
                        of = array("i", x)
                        ids.append(b"".join([as_ids[i] for i in of]))
                        decoded.append(b"".join([as_bytes[i] for i in of]))
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def round_trip(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes) of each row's text."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    split = rows.mapInArrow(_split(path, pattern or public_tokenizers.PATTERN), "doc_id bigint, numbers binary, restart boolean, w array<bigint>")
    return folded(split, path).mapInArrow(_assemble(path), "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
