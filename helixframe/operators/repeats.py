"""Repeats: balanced read catalogs, seeds, fragment extension, group assignment, curation and annotation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import cos, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.alignment import reverse_complement

#: Seeds of a catalog; beam, branch ratio, least edge and length of an extended fragment.
MOST_SEEDS, BEAM, BRANCH_RATIO, LEAST_EDGE, MOST_LENGTH = 2000, 8, 1.5, 3, 800
#: Fixed values of the annotation decision list.
SIMPLE_PERIOD, FOLDBACK, LIBRARY_IDENTITY, LIBRARY_COVERAGE, LIBRARY_DELTA, LEAST_SUPPORT = 20, 0.85, 0.8, 0.6, 0.1, 3


def repeat_seeds(counts: DataFrame, least: int, most: int = MOST_SEEDS) -> DataFrame:
    """The `most` k-mers of greatest depth, at least `least`; equal ones by k-mer."""
    return counts.where(F.col("depth") >= least).orderBy(F.desc("depth"), "kmer").limit(most)


def canonical_text(word: str) -> str:
    return min(word, reverse_complement(word))


def extend_fragment(seed: str, counts: Counter, k: int, beam: int = BEAM, ratio: float = BRANCH_RATIO, least: int = LEAST_EDGE, most: int = MOST_LENGTH) -> str:
    """A seed extended both ways through canonical k-mer counts.

    Up to `beam` paths grow base by base; a base is followed if its count is at least `least` and the best base's
    count is at most `ratio` times its own.  The path with the greatest sum of counts, then the least text, wins.
    """

    def one_way(start: str) -> str:
        paths, done = [(0, start, frozenset({canonical_text(start[-k:])}))], []
        while paths:
            grown = []
            for total, text, seen in paths:
                options = [(counts.get(canonical_text(text[-(k - 1) :] + b), 0), b) for b in "ACGT"]
                top = max(n for n, _ in options)
                options = [(n, b) for n, b in options if n >= least and top <= ratio * n and canonical_text(text[-(k - 1) :] + b) not in seen]
                if not options or len(text) >= most:
                    done.append((total, text))
                grown += [(total + n, text + b, seen | {canonical_text(text[-(k - 1) :] + b)}) for n, b in options if len(text) < most]
            paths = sorted(grown, key=lambda p: (-p[0], p[1]))[:beam]
        return max(done, key=lambda p: (p[0], [-ord(c) for c in p[1]]))[1]

    right = one_way(seed)
    return canonical_text(reverse_complement(one_way(reverse_complement(right))) if len(right) < most else right)


class Depths:
    """Depths by the text of a k-mer, kept as sorted numbers."""

    def __init__(self, kmers: np.ndarray, depths: np.ndarray):
        order = np.argsort(kmers)
        self.kmers, self.depths = kmers[order], depths[order]

    def get(self, word: str, other: int = 0) -> int:
        value = int(word.translate(DIGITS), 4)
        at = int(np.searchsorted(self.kmers, value))
        return int(self.depths[at]) if at < len(self.kmers) and self.kmers[at] == value else other


DIGITS = str.maketrans("ACGT", "0123")


def text_of(value: int, k: int) -> str:
    return "".join("ACGT"[value >> 2 * i & 3] for i in reversed(range(k)))


def extend_fragments(counts: DataFrame, group: str, kmer: str, depth: str, k: int, seeds: int = 1) -> DataFrame:
    """group, fragment, length, seed: the deepest k-mers of each group, extended through its counts (canonical; texts, or
    numbers of two bits a base)."""
    if dict(counts.dtypes)[kmer] == "bigint":
        return _extend_numbers(counts, group, kmer, depth, k, seeds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([depth, kmer], ascending=[False, True], kind="stable")
        table = Counter(dict(zip(pdf[kmer], pdf[depth].astype(int), strict=True)))
        found = [(s, extend_fragment(s, table, k)) for s in pdf[kmer].head(seeds)]
        return pd.DataFrame({group: pdf[group].iloc[0], "fragment": [f for _, f in found], "length": [len(f) for _, f in found], "seed": [s for s, _ in found]}).drop_duplicates("fragment")

    kind = dict(counts.dtypes)[group]
    return counts.select(group, kmer, depth).groupBy(group).applyInPandas(run, f"`{group}` {kind}, fragment string, length bigint, seed string")


def _extend_numbers(counts: DataFrame, group: str, kmer: str, depth: str, k: int, seeds: int) -> DataFrame:
    """extend_fragments of k-mers as numbers: a task holds those of a group that a path may follow, in arrays."""
    kind = dict(counts.dtypes)[group]

    def run(rows: pa.Table) -> pa.Table:
        kmers, depths = rows.column(kmer).to_numpy(), rows.column(depth).to_numpy()
        best = np.lexsort((kmers, -depths))[:seeds] if seeds > 1 else [np.flatnonzero(depths == depths.max())[np.argmin(kmers[depths == depths.max()])]]
        words, table = [text_of(int(kmers[i]), k) for i in best], Depths(kmers, depths)
        found = {}
        for word in words:
            found.setdefault(extend_fragment(word, table, k), word)
        return pa.table({group: rows.column(group).slice(0, 1).take(pa.array([0] * len(found))), "fragment": list(found), "length": pa.array([len(f) for f in found], pa.int64()), "seed": list(found.values())})

    # Paths go over k-mers of LEAST_EDGE at least, and others rule none of these out; a seed may have fewer.
    top = counts.groupBy(group).agg(F.max(depth).alias("__top"))
    needed = counts.select(group, kmer, F.col(depth).cast("int").alias(depth))
    needed = needed.where(F.col(depth) >= LEAST_EDGE) if seeds == 1 else needed
    if seeds == 1:
        shallow = counts.join(F.broadcast(top.where(F.col("__top") < LEAST_EDGE)), group).where(F.col(depth) == F.col("__top"))
        needed = needed.unionByName(shallow.groupBy(group).agg(F.min(kmer).alias(kmer), F.first(depth).cast("int").alias(depth)))
    return needed.groupBy(group).applyInArrow(run, f"`{group}` {kind}, fragment string, length bigint, seed string")


def assign_groups(hits: DataFrame, read: str, group: str) -> DataFrame:
    """read, group, state: reads (both mates' hits together) of one group are specific, of more ambiguous in each."""
    sets = hits.select(read, group).distinct()
    return sets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(read))).select(read, group, F.when(F.col("n") == 1, "specific").otherwise("ambiguous").alias("state"))


def audit(assigned: DataFrame, group: str) -> DataFrame:
    """group, specific_pairs, ambiguous_pairs, specific_fraction."""
    found = assigned.groupBy(group).agg(F.sum((F.col("state") == "specific").cast("bigint")).alias("specific_pairs"), F.sum((F.col("state") == "ambiguous").cast("bigint")).alias("ambiguous_pairs"))
    return found.withColumn("specific_fraction", F.col("specific_pairs") / (F.col("specific_pairs") + F.col("ambiguous_pairs")))


def divergence_bins(alignments: DataFrame, group: str, identity: str, bins: int = 21) -> DataFrame:
    """group, bin (percent of divergence, the last for all beyond), reads."""
    bin_ = F.least(F.floor((1 - F.col(identity)) * 100), F.lit(bins - 1)).cast("int")
    return alignments.groupBy(group, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def curate(atoms: DataFrame, group: str, key: str) -> DataFrame:
    """Equivalence classes of atoms with one sequence key: the greatest support of the members, not their sum."""
    found = atoms.groupBy(key).agg(F.min(group).alias("equivalence_id"), F.count(F.lit(1)).alias("atomic_count"), F.max("specific_pairs").alias("specific_pairs_total"), F.max("ambiguous_pairs").alias("ambiguous_pairs_total"))
    share = F.col("specific_pairs_total") / (F.col("specific_pairs_total") + F.col("ambiguous_pairs_total"))
    confidence = F.when(F.col("specific_pairs_total") < LEAST_SUPPORT, "low").when(share >= 0.7, "high").otherwise("medium")
    return found.withColumn("confidence", confidence).withColumn("decision", F.when(F.col("confidence") == "low", "review").otherwise("keep"))


def annotation(period: Column, foldback: Column, support: Column, identity: Column, coverage: Column, delta: Column, library_class: Column) -> Column:
    """The final class: the first rule that holds."""
    return (
        F.when(period.between(1, SIMPLE_PERIOD), "simple_repeat")
        .when(period > SIMPLE_PERIOD, "satellite")
        .when((identity >= LIBRARY_IDENTITY) & (coverage >= LIBRARY_COVERAGE) & (delta >= LIBRARY_DELTA), library_class)
        .when((foldback >= FOLDBACK) & (support >= LEAST_SUPPORT), "foldback")
        .when(support >= LEAST_SUPPORT, "unknown")
        .otherwise("unsupported")
    )


def bootstrap_interval(specific: int, effective: int, rounds: int = 1000, seed: int = 1) -> tuple[float, float]:
    """2.5 and 97.5 % of reads per million by a parametric bootstrap of the share of reads.

    Normal draws by Box and Muller from a 64-bit xorshift generator, so that a seed gives the same figures everywhere.
    """
    if effective <= 0:
        return 0.0, 0.0
    share = specific / effective
    spread = sqrt(share * (1 - share) / effective)
    uniform = xorshift(seed)
    draws = sorted(1e6 * min(max(share + spread * sqrt(-2 * log(max(next(uniform), TINY))) * cos(2 * pi * next(uniform)), 0.0), 1.0) for _ in range(rounds))
    return draws[(rounds - 1) * 25 // 1000], draws[(rounds - 1) * 975 // 1000]


#: Shifts (left, right, left) of the xorshift generator, and the least positive normal number.
SHIFTS = (13, 7, 17)
TINY = 2.2250738585072014e-308


def xorshift(seed: int) -> Iterator[float]:
    """Numbers from 0 up to 1, of 53 bits."""
    a, b, c = SHIFTS
    state = max(seed, 1)
    while True:
        state ^= state << a & (1 << 64) - 1
        state ^= state >> b
        state ^= state << c & (1 << 64) - 1
        yield (state >> 11) / (1 << 53)
