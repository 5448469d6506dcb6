"""Importance resampling towards a target: hashed word runs, a gain for each bucket, a weighted draw without replacement.

1. One scan of each text by a ring of CRC states: for the last n starts the running CRC-32 of the words from there on.
   A word extends each state by a space and itself, and starts one more; every state so made is a feature's CRC, and
   its remainder a bucket.  No run of words is ever put together.  A text's words are taken in blocks, between which
   the ring goes on, so that very long texts need no more memory.  Buckets are written, two bytes each, and each task
   writes the counts of its buckets, which Spark adds up.
2. The gain of a bucket compares its share of the target with its share of the documents.  Only these sums, one row a
   bucket, are collected.
3. A document's weight is the floored mean of its features' gains; its score adds noise drawn by doc_id, so that the
   highest scores are a draw without replacement in proportion to the weights.
4. Scores are whole numbers of a bounded range, so their histogram is small and gives the lowest drawn score.  Rows
   from there on are range-partitioned by score and numbered with the counts of the partitions before.

Defined results: a null or empty text has no words, no features and weight 0; texts of any length are read whole; of equal
scores the smaller doc_id comes first (null before all, and as the empty string in the noise), then the fewer features; rows
that repeat a doc_id are scored and ranked each for itself; empty tables of documents or targets are allowed; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table, written

#: Words of a feature at most; buckets; percent of the documents to draw; words that a document must have; noise seed.
RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text whose words are in memory at once.
BLOCK = 1 << 20
#: Rows of a batch that are scanned at once.
ROWS = 256
#: Bytes of words: ASCII letters, as lower-case ones, digits, and whatever is beyond ASCII; all others part words.
WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of text, BLOCK bytes at a time."""
    text, at = text.translate(WORDS), 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end


def extended(words: list[bytes], ring: list[int | None]) -> list[list[int]]:
    """CRCs of the runs of 1 word, of 2 words, ... that end in `words`, a list for each length.

    ring holds the states of the runs of 1 word, 2 words, ... that ended just before, None where there was none yet,
    and is moved on.
    """
    spaced = [b" " + x for x in words]
    found = [list(map(crc32, words))]
    for before in ring:
        states = found[-1] if before is None else [before, *found[-1]]
        # The state of a start is extended by the word after its last one.
        states = states[:-1]
        found.append(list(map(crc32, spaced[len(spaced) - len(states) :], states)))
    for k in range(len(ring)):
        if found[k]:
            ring[k] = found[k][-1]
    return found


def crcs(text: bytes, run: int) -> tuple[np.ndarray, int]:
    """(CRC-32 of each run of 1 to `run` consecutive words of text, number of words)."""
    ring: list[int | None] = [None] * (run - 1)
    found, n = [np.empty(0, np.uint32)], 0
    for words in blocks(text):
        n += len(words)
        if words:
            found += [np.array(x, np.uint32) for x in extended(words, ring)]
    return np.concatenate(found), n


def _scan(run: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_words", "buckets", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            words, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                crc, n = crcs(text.as_py() or b"", run)
                bucket = (crc % buckets).astype("<u2")
                counts += np.bincount(bucket, minlength=buckets)
                words.append(n)
                found.append(bucket.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return scan


def scanned(documents: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets (little-endian unsigned 16-bit) of each row; and a row of counts for each task."""
    if not 0 < buckets <= 1 << 16 or run < 1:
        raise ValueError("from 1 to 65536 buckets and runs of a word at least")
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(run, buckets), "doc_id bigint, n_words bigint, buckets binary, counts binary")


def bucket_counts(scan: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a written scan by bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.frombuffer(x.as_py(), np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"])

    parts = scan.where("counts IS NOT NULL").select("counts").mapInArrow(add, "bucket int, n bigint")
    found = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        found[r["bucket"]] = r["n"]
    return found


def gains(of_target: np.ndarray, of_documents: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share of the target over that of the documents, floored."""
    n = len(of_target)
    total, target = float(of_documents.sum()), float(of_target.sum())
    ratio = (of_target + 1.0) * (total + n) / ((of_documents + 1.0) * (target + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for x in batch.column(2):
                bucket = np.frombuffer(x.as_py(), "<u2")
                n.append(len(bucket))
                weight.append(int(gain[bucket].sum()) // max(len(bucket), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel number drawn by doc_id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """scored (written, with n_words) with rank: 1 to `most` by falling score, then doc_id; null for all that follow.

    Rows below the least drawn score are not sorted.  The others are dealt by ranges of the order; a row's rank is its
    place in its range plus the sizes of the ranges before.
    """
    fit = F.col("fit")
    counts = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # some 100,000 scores at most
    least, left = None, most
    for r in sorted(counts, key=lambda r: -r["score"]):
        if left <= 0:
            break
        least, left = r["score"], left - r["n"]
    drawn = fit & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if least is None:
        return rest
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")]
    top = written(scored.where(drawn).select(columns).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "drawn")
    sizes = {r["range"]: r["n"] for r in top.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, rows = 0, []
    for number in sorted(sizes):
        rows.append((number, before))
        before += sizes[number]
    offsets = F.broadcast(top.sparkSession.createDataFrame(rows, "range int, before bigint"))
    placed = top.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(offsets, "range")
    rank = (F.col("place") + F.col("before")).cast("bigint")
    return rest.unionByName(placed.select(*columns, F.when(rank <= most, rank).alias("rank")))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Each row's doc_id, n_features, weight, score, and its rank among those drawn; null if it is not.

    target has a text column.  Of the documents with least_words words or more, `percent` of 100 are drawn.
    """
    own = written(scanned(documents, run, buckets), "features")
    aim = written(scanned(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), run, buckets), "target")
    gain = gains(bucket_counts(aim, buckets), bucket_counts(own, buckets))
    weighed = own.where("counts IS NULL").select("doc_id", "n_words", "buckets").mapInArrow(_weigh(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("fit")), "scored")
    return ranked(scored, percent * scored.where("fit").count() // 100)


def sample(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents drawn, all columns; of a doc_id drawn all rows."""
    drawn = resampled(documents, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    inside = F.struct(*documents.columns).alias("row")
    rows = documents.select(F.col("doc_id").alias("own_id"), inside).join(drawn, F.col("own_id").eqNullSafe(F.col("drawn_id")), "left_semi")
    return rows.select("row.*")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
