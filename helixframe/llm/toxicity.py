"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training reads at most SAMPLE label rows, in the order of a hash of doc_id.  Half of their texts give a lexicon of
MOST_UNITS units at most: whole words and word beginnings (of FIRST..LAST letters, with more letters after them) that
toxic texts have far more often.  The other half trains the trees, on features that see this lexicon as new texts do,
and the isotonic calibration.  Texts stay in their tasks: the driver gets the units that pass and rows of features.
Features: densities of lexicon hits, second-person words close to hits, capitals, punctuation and obfuscation rates,
length.

Defined results: a null or empty text has the features of no words and the score of such; a text of any length takes
time linear in it, long tokens too; without labelled rows of both kinds each score is the share of toxic labels (0.5
without labels); rows that repeat a doc_id each come out; for training each counts for the lexicon with each label row
of its id, and the one with the least features for the trees; units and scores that tie are ordered by name; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table
from helixframe.llm.language_id import fold

SAMPLE = 8192
FIRST, LAST = 3, 7
#: A unit enters the lexicon with so many toxic texts at least and a log ratio of document rates beyond this.
LEAST_TEXTS, LEAST_RATIO = 4, 1.5
MOST_UNITS = 4096
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 8
PREDICT_FROM = 0.7
#: Words a task remembers the weights of; then it starts anew.
MOST_WORDS = 200_000

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tuyo usted ustedes vosotros su".split())
#: Characters that stand for letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"\w+")
#: Runs of letters, digits and what may stand for letters; possessive, so that each character is read once.
RUN = re.compile(r"(?<![\w@$!|*])[\w@$!|*]++")
NOT_FIRST, NOT_LAST = "@$!|*", "0123456789@$!|*_"
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[^\w\s]")
SHOUTS = re.compile(r"[!?]")


def units(word: str) -> Iterator[str]:
    """The word, and its beginnings as `beginning-`."""
    yield word
    for n in range(FIRST, min(LAST, len(word) - 1) + 1):
        yield f"{word[:n]}-"


def mixed(text: str) -> list[str]:
    """Tokens in which digits or marks stand among letters, before one at least."""
    if not any(c in text for c in "0123456789@$!|*"):
        return []
    found = (x.strip(NOT_FIRST).rstrip(NOT_LAST) for x in RUN.findall(text) if not x.isalpha())
    return [x for x in found if not x.isalpha() and any(c in x for c in "0123456789@$!|*")]


class Weights(dict):
    """word -> its greatest log ratio in the lexicon, or 0; remembers what it was asked."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = value = max((self.lexicon.get(x, 0.0) for x in units(word)), default=0.0)
        return value


def features(text: str, weights: Weights) -> list[float]:
    low = WORD.findall(text.lower())
    n, chars = max(len(low), 1), max(len(text), 1)
    scores = [weights[x] for x in low]
    hits = [i for i, x in enumerate(scores) if x]
    near = sum(any(x in SECOND_PERSON for x in low[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    tokens = mixed(text)
    hidden = sum(weights[x.lower().translate(DISGUISE)] > 0 and not weights[x.lower()] for x in tokens)
    return [
        len(hits) / n,
        float(len(hits)),
        sum(scores) / n,
        max(scores, default=0.0),
        float(len({low[i] for i in hits})),
        near / n,
        len(CAPITALS.findall(text)) / chars,
        len(MARKS.findall(text)) / chars,
        len(SHOUTS.findall(text)) / n,
        len(tokens) / n,
        float(hidden),
        log(1 + len(low)),
    ]


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            at = np.where(inner, np.where(x[rows, feature[at]] <= cut[at], left[at], right[at]), at)
        return np.array(self.value)[at]


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
    """A regression tree on gradients g and curvatures h, its splits at bin borders."""
    tree = Tree()

    def node(rows: np.ndarray, depth: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = tree.add(float(-RATE * total_g / (total_h + 1.0)))
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return here
        best, choice = 1e-6, None
        for j, borders in enumerate(cuts):
            if not len(borders):
                continue
            sums = [np.bincount(binned[rows, j], w, len(borders) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None)]
            inside = (sums[2] >= LEAST_LEAF) & (len(rows) - sums[2] >= LEAST_LEAF)
            gain = np.where(inside, sums[0] ** 2 / (sums[1] + 1) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1) - total_g**2 / (total_h + 1), 0)
            if gain.max() > best:
                best, choice = gain.max(), (j, int(gain.argmax()))
        if choice:
            j, b = choice
            goes = binned[rows, j] <= b
            tree.feature[here], tree.cut[here] = j, float(cuts[j][b])
            tree.left[here] = node(rows[goes], depth + 1)
            tree.right[here] = node(rows[~goes], depth + 1)
        return here

    node(np.arange(len(x)), 0)
    return tree


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y to z (pool adjacent violators), for linear interpolation."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, least z, greatest z
    for at, value in zip(z[order], y[order], strict=True):
        if blocks and blocks[-1][3] == at:
            blocks[-1][0] += value
            blocks[-1][1] += 1
        else:
            blocks.append([float(value), 1.0, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, top = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = top
    knots, values = [], []
    for s, w, low, top in blocks:
        share = (s + 0.5 * y.mean()) / (w + 0.5)  # a block of few rows is not quite sure
        knots += [low, top] if top > low else [low]
        values += [share, share] if top > low else [share]
    return np.array(knots), np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: list[Tree]
    start: float
    knots: np.ndarray
    values: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.margins(x)
        if not len(self.knots):
            return 1 / (1 + np.exp(-z))
        # A hundredth of the uncalibrated probability keeps the order within flat steps.
        return 0.99 * np.interp(z, self.knots, self.values) + 0.01 / (1 + np.exp(-z))


def text_units(text: str) -> set[str]:
    return {u for w in set(WORD.findall(text.lower())) for u in units(w)}


def lexicon(counts: Iterable[tuple[str, int, int]], n: tuple[int, int]) -> dict[str, float]:
    """The units that toxic texts have far more often; counts: unit, texts of kind 0 and of kind 1; n: texts of each kind."""
    found = {}
    for unit, clean, toxic in counts:
        if toxic >= LEAST_TEXTS:
            ratio = log((toxic + 0.1) / (n[1] + 0.2)) - log((clean + 0.5) / (n[0] + 1))
            if ratio > LEAST_RATIO:
                found[unit] = round(ratio, 6), toxic
    best = sorted(found.items(), key=lambda x: (-x[1][0] * x[1][1], x[0]))[:MOST_UNITS]
    return {unit: ratio for unit, (ratio, _) in best}


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[Tree], float]:
    cuts = [np.unique(np.quantile(c[c > c.min()], np.linspace(0, 1, BINS)[:-1], method="lower")) if (c > c.min()).any() else c[:0] for c in x.T]
    cuts = [np.unique(np.concatenate([[c.min()], b])) if len(b) else b for c, b in zip(x.T, cuts, strict=True)]
    binned = np.stack([np.searchsorted(b, c, "left") for c, b in zip(x.T, cuts, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6)))
        z = z + trees[-1].predict(x)
    return trees, start


def train(words: dict[str, float], x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Trees on two thirds of the rows of features x with labels y, calibration on every third; share: of toxic labels."""
    hold = np.arange(len(y)) % 3 == 2
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        return Model({}, [], float(np.log(share / (1 - share))), np.zeros(0), np.zeros(0))
    trees, start = boost(x[~hold], y[~hold])
    model = Model(words, trees, start, np.zeros(0), np.zeros(0))
    model.knots, model.values = isotonic(model.margins(x[hold]), y[hold])
    return model


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, clean, toxic: counts of texts with a unit, summed within the task up to MOST_WORDS units."""

    def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(counts.keys(), pa.string()), *(pa.array([x[i] for x in counts.values()], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "clean", "toxic"])

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            for unit in text_units(text.as_py() or ""):
                counts.setdefault(unit, [0, 0])[toxic] += 1
            if len(counts) > MOST_WORDS:
                yield out(counts)
                counts = {}
    yield out(counts)


def _features(words: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(words)
        for batch in batches:
            x = pa.array([features(t.as_py() or "", weights) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["doc_id", "toxic", "x"])

    return run


def learn(documents: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from at most SAMPLE label rows for which `usable` (of doc_id) holds, and the texts of their ids."""
    spark = documents.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    picked = spark.createDataFrame(marks.collect(), marks.schema)  # ids and labels, SAMPLE at most
    texts = in_small_batches(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    half = F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit(1)), 7), F.lit(2)) == 0
    totals = {r["toxic"]: r["n"] for r in rows.where(half).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.where(half).mapInArrow(_count_units, "unit string, clean bigint, toxic bigint").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # A bound that lexicon() has too: units whose log ratio passes have this share of toxic texts at least.
    kinds = totals.get(0, 0), totals.get(1, 0)
    passes = (F.col("toxic") + 0.1) / (kinds[1] + 0.2) > exp(LEAST_RATIO) * (F.col("clean") + 0.5) / (kinds[0] + 1)
    best = (F.log((F.col("toxic") + 0.1) / (kinds[1] + 0.2)) - F.log((F.col("clean") + 0.5) / (kinds[0] + 1))) * F.col("toxic")
    top = counts.where((F.col("toxic") >= LEAST_TEXTS) & passes).orderBy(best.desc(), "unit").limit(MOST_UNITS)
    words = lexicon(((r["unit"], r["clean"], r["toxic"]) for r in top.collect()), kinds)
    made = rows.where(~half).mapInArrow(_features(words), "doc_id bigint, toxic int, x array<double>")
    # Of rows that repeat an id one, so that there are SAMPLE rows at most.
    found = made.groupBy("doc_id", "toxic").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id", "toxic").collect()
    y = np.array([r["toxic"] for r in found], float)
    share = picked.agg(F.avg("toxic")).first()[0]
    return train(words, np.array([r["x"] for r in found]).reshape(-1, 12), y, 0.5 if share is None else share)


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py() or "", weights) for t in batch.column(1)]).reshape(-1, 12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    return run


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row."""
    return in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_score(model), "doc_id bigint, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scored(documents, learn(documents, labels, fold(3) != 1))
    held = F.coalesce(fold(3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
