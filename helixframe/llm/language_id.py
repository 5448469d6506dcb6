"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 3- and 4-byte windows of its UTF-8 form that lie within a word, its edges included
(A-Z lower-cased, other ASCII than letters a word boundary).  Each hashes to a bucket with an embedding; their
average goes through a linear softmax.  Both are trained by stochastic gradient descent in numpy on at most
SAMPLE labelled rows, taken in the order of a hash of doc_id; a fifth of them calibrates: a temperature for the
softmax, and the confidence below which a text is rejected.

For prediction the embedding times the softmax weights is one table (bucket, language), so that whole texts
are scored by vectorised look-ups, in parts of PART bytes.

Defined results: of equally likely languages the first by name is given; texts of any length are read in parts; a null text, one without a letter, or a table without labelled rows gives `und` with score 0;
a text with letters but without subwords (one or two bytes) gets the prior's best language; rows that
repeat a doc_id each come out; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table

UNKNOWN = "und"
SAMPLE = 2048
BUCKETS = 1 << 13
DIMENSION = 16
EPOCHS, BATCH, RATE = 30, 64, 4.0
#: Bytes of text whose subwords are looked up at once.
PART = 1 << 18
#: A text is rejected below the confidence that this share of right calibration rows doesn't reach, MOST_REJECT at most.
REJECT_SHARE, MOST_REJECT = 0.001, 0.4

#: By byte: A-Z as a-z, other ASCII than letters as a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
MIX = np.uint32(2654435761)


def subword_buckets(text: bytes) -> np.ndarray:
    """The buckets of a text's subwords, repeats included."""
    b = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    gap = b == 32
    found = []
    for n in (3, 4):
        if len(b) < n:
            continue
        size = len(b) - n + 1
        code, ok = np.full(size, n, np.uint32), np.ones(size, bool)
        for j in range(n):
            code = (code ^ b[j : j + size]) * MIX
            code ^= code >> np.uint32(15)
            if 0 < j < n - 1:
                ok &= ~gap[j : j + size]
        found.append((code >> np.uint32(9))[ok] % np.uint32(BUCKETS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at a space where there is one in reach, so that no subword is lost or made."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(b" ", at, at + PART)
        cut = at + PART if cut <= at else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (bucket, language)
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in parts(text):
            found = subword_buckets(part)
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        z = (total / max(n, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], names: list[str], seed: int = 7) -> Model:
    """bags: (buckets, counts) of each row; names: its language."""
    languages = sorted(set(names))
    y = np.array([languages.index(x) for x in names])
    x = np.zeros((len(bags), BUCKETS), np.float32)
    for row, (at, n) in zip(x, bags, strict=True):
        row[at] = n / max(n.sum(), 1)
    rng = np.random.default_rng(seed)
    hold = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~hold)
    embed = rng.normal(0, 1, (BUCKETS, DIMENSION)).astype(np.float32)
    weight = np.zeros((DIMENSION, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            mean = x[rows] @ embed
            g = softmax(mean @ weight + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            step = x[rows].T @ (g @ weight.T)
            weight -= rate * mean.T @ g
            bias -= rate * 0.1 * g.sum(axis=0)
            embed -= rate * 100 * step  # a row's weight is spread over hundreds of buckets
    scores = x @ embed @ weight + bias
    held = np.flatnonzero(hold) if hold.any() else fit
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(scores[held] / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(scores[held] / temperature)
    right = sure.max(axis=1)[sure.argmax(axis=1) == y[held]]
    reject = min(MOST_REJECT, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return Model(languages, (embed @ weight).astype(np.float32), bias.astype(np.float64), temperature, reject)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2).cast(pa.binary()):
            total = np.zeros(BUCKETS, np.int64)
            for part in parts(text.as_py()):
                total += np.bincount(subword_buckets(part), minlength=BUCKETS)
            at = np.flatnonzero(total)
            rows.append((at.astype("<u2").tobytes(), np.minimum(total[at], 2**32 - 1).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["doc_id", "lang", "at", "n"])


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def learn(documents: DataFrame, usable: Column) -> Model | None:
    """A model from at most SAMPLE of the rows for which `usable` holds."""
    order = F.xxhash64(F.col("doc_id").cast("bigint"))
    may = documents.where(F.coalesce(usable, F.lit(False)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # First ids alone, then the texts of at most SAMPLE ids.
    picked = [r[0] for r in may.select(F.col("doc_id").cast("bigint").alias("doc_id")).orderBy(order, "doc_id").limit(SAMPLE).collect()]
    rows = in_small_batches(may).where(F.col("doc_id").isin(picked) & has_letter()).select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    bags = rows.mapInArrow(_bags, "doc_id bigint, lang string, at binary, n binary").limit(2 * SAMPLE).collect() if picked else []
    bags.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 2**32, r["doc_id"], r["lang"], bytes(r["at"])))
    if not bags:
        return None
    return train([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.float64)) for r in bags], [r["lang"] for r in bags])


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text, letter in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                if letter:
                    p = model.probabilities(text.as_py())
                    langs.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.select("doc_id", "text", has_letter().alias("letter")).mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double")


def accepted(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text the model doesn't reject; all of them without a model."""
    if model is None:
        return documents.where(has_letter())
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            keep = []
            for text in batch.column(at).cast(pa.binary()):
                keep.append(text.as_py() is not None and float(model.probabilities(text.as_py()).max()) >= model.reject_below)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_small_batches(documents).where(has_letter()).mapInArrow(run, documents.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identified(documents, learn(documents, fold(4) != 2))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
