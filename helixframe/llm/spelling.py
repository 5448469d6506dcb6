"""Grouping of spelling variants: words one edit apart, found by automaton shards over the halves of words.

1. Words are counted within tasks, then over the corpus; the vocabulary (words long and frequent enough) is written.
2. Two words one edit apart share a half of either: its first half at the begin, or its second half at the end.  So
   each word puts its two halves in shards, by a hash of the half, and each word is sent to the shards where halves
   that it may have would be.  A shard builds an Aho-Corasick automaton of its halves and scans its words; a hit counts
   if the half lies at the begin or the end, as it does in its owner, and the lengths differ by one at most.  Owners of
   one half are looked up by the halves of what is left, as one of these must be equal again; then the distance is
   verified.  Each pair comes from the first half alone if both are shared.
3. Halves of very many words are hot: their owners and words are dealt by the halves of what is left too, so that no
   shard grows with them.
4. A word's form is its most frequent near word, if that is frequent enough; chains of forms are followed by pointer
   doubling, in as many rounds as the logarithm of their length.

Defined results: a null or empty text has no words; texts of any length are read whole; rows that repeat a doc_id count
each; a null doc_id stands for the empty string in the checksum; of near words with equal n the smallest in code-point order
is the form; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import hot_bound, in_small_batches, table, written

#: Letters of a word and occurrences at least; by how much a form is more frequent; the share of occurrences that lose a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, ONE_OF = 7, 2, 10, 31
#: Words a task counts at once; then it hands them on.
MOST_WORDS = 300_000
#: Words of the vocabulary for each shard, and shards at least.
SHARD_WORDS, LEAST_SHARDS = 10_000, 32
#: Rows of a batch that are read at once.
ROWS = 256
#: Latin-1 bytes of letters, A-Z as a-z; all others part words.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The runs of letters of text, A-Z lower-cased, in UTF-8."""
    return text.encode("latin-1", "replace").translate(LETTERS).decode("latin-1").encode().split()


def shortened(word: bytes, h: int) -> bytes:
    """word without its code point h % length."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        rows = [(w, n) for w, n in counts.items() if n and len(w.decode()) >= LEAST_LETTERS]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py() or "")
            h = np.fromiter(map(crc32, words, repeat(crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())))), np.uint32, len(words))
            counts.update(words)
            for at in np.flatnonzero(h % ONE_OF == 0).tolist():
                counts[words[at]] -= 1
                counts[shortened(words[at], int(h[at]))] += 1
        if len(counts) > MOST_WORDS:
            yield flushed()
    yield flushed()


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: the distinct words with LEAST_LETTERS code points and LEAST_COUNT occurrences."""
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


# A word w of length L has the half w[:L // 2] (kind 0) and the half w[L // 2:] (kind 1).  What is left of it, `rest`, has
# itself two halves, and a word near w that shares the half has at least one of these at the same end of its own rest.


def _half(word: Column, size: Column, kind: Column) -> Column:
    return F.when(kind == 0, F.substring(word, F.lit(1), size)).otherwise(F.right(word, size))


def _rest(word: Column, size: Column, kind: Column) -> Column:
    left = F.char_length(word) - size
    return F.when(kind == 0, F.right(word, left)).otherwise(F.substring(word, F.lit(1), left))


def _keys(words: DataFrame, lengths: Column) -> DataFrame:
    """word, n, kind, half, and `rest` with the size of the near word's rest, for near words of these lengths."""
    kinds = F.array(F.lit(0), F.lit(1))
    each = words.select("word", "n", F.explode(lengths).alias("of")).where(F.col("of") >= LEAST_LETTERS).select("*", F.explode(kinds).alias("kind"))
    size = F.when(F.col("kind") == 0, F.floor(F.col("of") / 2)).otherwise(F.col("of") - F.floor(F.col("of") / 2)).cast("int")
    each = each.withColumn("size", size).where(F.char_length("word") >= F.col("size"))
    return each.select("word", "n", "kind", _half(F.col("word"), F.col("size"), F.col("kind")).alias("half"), _rest(F.col("word"), F.col("size"), F.col("kind")).alias("rest"), (F.col("of") - F.col("size")).cast("int").alias("left"))


def _quarters() -> Column:
    """Of the rest (of `left` code points in the near word): its first half at its begin, its second half at its end."""
    first = F.floor(F.col("left") / 2).cast("int")
    return F.array(
        F.struct(F.lit(0).alias("end"), F.substring(F.col("rest"), F.lit(1), first).alias("part")),
        F.struct(F.lit(1).alias("end"), F.right(F.col("rest"), F.col("left") - first).alias("part")),
    )


def _dealt(keys: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """word, n, kind, end, shard: of hot halves a row for each half of the rest; end is -1 for others."""
    marked = keys.join(F.broadcast(hot), ["kind", "half"], "left")
    whole = F.array(F.struct(F.lit(-1).alias("end"), F.lit("").alias("part")))
    each = marked.select("word", "n", "kind", "half", F.explode(F.when(F.col("hot"), _quarters()).otherwise(whole)).alias("q"))
    shard = F.pmod(F.xxhash64("kind", "half", "q.end", "q.part"), F.lit(shards)).cast("int")
    return each.select("word", "n", "kind", F.col("q.end").alias("end"), shard.alias("shard"))


FOUND = "word string, n_near bigint, form_n bigint, form string"


def _shard(rows: pa.Table) -> pa.Table:
    """Of each scanned word: the number of owners near it that this shard is to report, and the best of them.

    A row is an owner of a half, or a word to scan if its kind is null.
    """
    import ahocorasick

    columns = [rows.column(c).to_pylist() for c in ("word", "n", "kind", "end")]
    automaton, by_half, scanned = ahocorasick.Automaton(), {}, set()
    for word, n, kind, end in zip(*columns, strict=True):
        if kind is None:
            scanned.add(word)
            continue
        cut = len(word) // 2
        half, rest = (word[:cut], word[cut:]) if kind == 0 else (word[cut:], word[:cut])
        if half not in by_half:
            by_half[half] = defaultdict(list)
            automaton.add_word(half, half)
        first = len(rest) // 2
        for e, part in ((0, rest[:first]), (1, rest[first:])):
            if end in (-1, e):
                by_half[half][kind, e, len(rest), part].append((word, n, end))
    out: list[tuple[str, int, int, str]] = []
    if by_half:
        automaton.make_automaton()
        for word in scanned:
            near: dict[str, int] = {}
            for last, half in automaton.iter(word):
                size = len(half)
                for kind, fits in ((0, last == size - 1), (1, last == len(word) - 1)):
                    if fits:
                        rest = word[size:] if kind == 0 else word[: len(word) - size]
                        _look(word, rest, kind, by_half[half], near)
            if near:
                n, form = min((-n, w) for w, n in near.items())
                out.append((word, len(near), -n, form))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "form_n", "form"])


def _look(word: str, rest: str, kind: int, owners: dict, near: dict[str, int]) -> None:
    """Adds to near the owners of one half, which word shares, that are one edit from word."""
    for left in (len(rest) - 1, len(rest), len(rest) + 1):
        first = left // 2
        for e, part in ((0, rest[:first]), (1, rest[max(0, len(rest) - left + first) :])):
            for w, n, end in owners.get((kind, e, left, part), ()):
                # Shared first halves report a pair before second ones do; within hot halves likewise.
                cut = len(w) // 2
                if w in near or kind == 1 and word.startswith(w[:cut]):
                    continue
                if end == 1 and rest.startswith((w[cut:] if kind == 0 else w[:cut])[:first]):
                    continue
                if one_edit(word, w):
                    near[w] = n


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of each row of words (written: word, n) that has a near word: their number, and the most frequent."""
    length = F.char_length("word")
    total = words.count()
    shards = max(LEAST_SHARDS, -(-total // SHARD_WORDS))
    own, others = _keys(words, F.array(length)), _keys(words, F.array(length - 1, length, length + 1))
    bound = hot_bound(2 * total)
    hot = own.groupBy("kind", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(bound, SHARD_WORDS // 2)).select("kind", "half", F.lit(True).alias("hot"))
    hot = written(hot, "hot-halves")
    scanned = _dealt(others, hot, shards).withColumns({"n": F.lit(None).cast("bigint"), "kind": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    found = _dealt(own, hot, shards).unionByName(scanned).groupBy("shard").applyInArrow(_shard, FOUND)
    # Code-point order is that of the UTF-8 bytes, by which Spark orders strings.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (written: word, form): where following forms ends.

    Each round doubles what a pointer has passed.  Chains have no circles, as each form is more frequent.
    """
    pointers = forms.select("word", F.col("form").alias("root"))
    while True:
        on = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(pointers.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        pointers = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return pointers


def variants(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary."""
    words = written(vocabulary(documents), "vocabulary")
    near = near_words(words)
    is_form = F.col("form_n") >= TIMES * F.col("n")
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    own = written(own, "forms")
    ends = roots(written(own.where("form IS NOT NULL").select("word", "form"), "chains"))
    return own.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
