"""Alignment kernels in numpy, for grouped and Arrow functions.

Local alignments fill a matrix row by row; a row's horizontal gaps are a running maximum, so that rows are
vectorised.  Ties go to the diagonal, then to a gap in the query, then to one in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scores:
    match: int = 2
    mismatch: int = -3
    opening: int = -5  # of a gap's first base
    extending: int = -1  # of each further one


AFFINE, LINEAR, SHORT = Scores(), Scores(2, -3, -4, -4), Scores(2, -2, -3, -3)


@dataclass(frozen=True)
class Local:
    score: int
    query_start: int
    query_end: int
    reference_start: int
    reference_end: int
    matches: int
    mismatches: int
    gaps: int

    @property
    def columns(self) -> int:
        return self.matches + self.mismatches + self.gaps

    @property
    def identity(self) -> float:
        return self.matches / self.columns if self.columns else 0.0


NONE = Local(0, 0, 0, 0, 0, 0, 0, 0)


def local_align(query: str, reference: str, s: Scores = AFFINE) -> Local:
    q, r = (np.frombuffer(x.upper().encode(), np.uint8) for x in (query, reference))
    n, m = len(q), len(r)
    if not n or not m:
        return NONE
    h, up = np.zeros((n + 1, m + 1), np.int32), np.full(m + 1, -(10**6), np.int64)
    from_up, from_left = np.zeros((n + 1, m + 1), bool), np.zeros((n + 1, m + 1), bool)
    ramp = np.arange(m + 1) * s.extending
    for i in range(1, n + 1):
        up = np.maximum(h[i - 1] + s.opening, up + s.extending)
        diagonal = np.zeros(m + 1, np.int64)
        diagonal[1:] = h[i - 1, :-1] + np.where(r == q[i - 1], s.match, s.mismatch)
        diagonal[0] = 0
        best = np.maximum(np.maximum(diagonal, up), 0)
        best[0] = 0
        # A horizontal gap that starts after column j scores best[j] + opening + (length - 1) * extending.
        left = np.full(m + 1, -(10**6), np.int64)
        left[1:] = np.maximum.accumulate(best - ramp)[:-1] + ramp[1:] + s.opening - s.extending
        row = np.maximum(best, left)
        row[0] = 0
        h[i] = row
        from_up[i], from_left[i] = (row > 0) & (row != diagonal) & (row == up), (row > 0) & (row != diagonal) & (row != up)
    score = int(h.max())
    if not score:
        return NONE
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    end_q, end_r, matches, mismatches, gaps = i, j, 0, 0, 0
    while h[i, j] > 0:
        if from_up[i, j]:
            length = next(k for k in range(1, i + 1) if h[i - k, j] + s.opening + (k - 1) * s.extending == h[i, j])
            i, gaps = i - length, gaps + length
        elif from_left[i, j]:
            length = next(k for k in range(1, j + 1) if h[i, j - k] + s.opening + (k - 1) * s.extending == h[i, j])
            j, gaps = j - length, gaps + length
        else:
            i, j = i - 1, j - 1
            matches += int(q[i] == r[j])
            mismatches += int(q[i] != r[j])
    return Local(score, i, end_q, j, end_r, matches, mismatches, gaps)


def banded(query: str, reference: str, query_at: int, reference_at: int, band: int, s: Scores = AFFINE) -> Local:
    """Local alignment of the query with the slice of the reference around a seed's diagonal."""
    low = max(0, reference_at - query_at - band)
    high = min(len(reference), reference_at - query_at + len(query) + band)
    found = local_align(query, reference[low:high], s)
    return found if not found.score else Local(found.score, found.query_start, found.query_end, found.reference_start + low, found.reference_end + low, found.matches, found.mismatches, found.gaps)


def passes_gate(found: Local, overlap: int, identity: float) -> bool:
    """Both thresholds at 0 switch the gate off."""
    return not (overlap or identity) or (found.columns >= overlap and found.identity >= identity)


def diagonal_identity(query: str, reference: str, offset: int) -> tuple[float, float]:
    """(identity, coverage of the query) without gaps, the query laid at `offset` of the reference."""
    a, b = max(0, -offset), min(len(query), len(reference) - offset)
    if b <= a:
        return 0.0, 0.0
    same = sum(x == y for x, y in zip(query[a:b], reference[a + offset : b + offset], strict=True))
    return same / (b - a), (b - a) / len(query)


def best_diagonal(query: str, reference: str, k: int = 11, most: int = 32) -> tuple[float, float, int]:
    """(identity, coverage, offset) of the best of the `most` diagonals with most k-mer seeds."""
    at: dict[str, list[int]] = {}
    for i in range(len(reference) - k + 1):
        at.setdefault(reference[i : i + k], []).append(i)
    seeds: dict[int, int] = {}
    for i in range(len(query) - k + 1):
        for j in at.get(query[i : i + k], ()):
            seeds[j - i] = seeds.get(j - i, 0) + 1
    found = [(*diagonal_identity(query, reference, o), o) for o in sorted(seeds, key=lambda o: (-seeds[o], o))[:most]]
    return max(found, key=lambda x: (x[0] * x[1], x[0], -x[2]), default=(0.0, 0.0, 0))


COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(seq: str) -> str:
    return seq.translate(COMPLEMENT)[::-1]


def foldback(seq: str, least: int = 200) -> float:
    """Identity of a sequence with its own reverse complement, ungapped; 0 for short ones."""
    return diagonal_identity(seq, reverse_complement(seq), 0)[0] if len(seq) >= least else 0.0


def has_long_inverted_repeat(seq: str, least: int = 150, k: int = 21, most_overlap: float = 0.2) -> bool:
    """Whether chained k-mers of one anti-diagonal span `least` bases whose two arms overlap at most so much."""
    at: dict[str, list[int]] = {}
    for i in range(len(seq) - k + 1):
        at.setdefault(seq[i : i + k], []).append(i)
    chains: dict[int, list[int]] = {}
    for i in range(len(seq) - k + 1):
        for j in at.get(reverse_complement(seq[i : i + k]), ()):
            if i < j:
                chains.setdefault(i + j, []).append(i)
    for total, starts in chains.items():
        runs = np.split(np.array(sorted(starts)), np.flatnonzero(np.diff(sorted(starts)) > 1) + 1)
        for run in runs:
            a, b = int(run[0]), int(run[-1]) + k
            if b - a >= least:
                overlap = max(0, b - (total - int(run[-1])))
                if overlap <= most_overlap * (b - a):
                    return True
    return False


def unsupported_gap(seq: str, reads: list[str], k: int = 15, anchor: int = 25) -> int:
    """The longest inner stretch of seq that no read spans with `anchor` bases on a diagonal of k-mers."""
    at: dict[str, list[int]] = {}
    for i in range(len(seq) - k + 1):
        at.setdefault(seq[i : i + k], []).append(i)
    change = np.zeros(len(seq) + 1, np.int64)
    for read in reads:
        for text in (read, reverse_complement(read)):
            chains: dict[int, list[int]] = {}
            for i in range(len(text) - k + 1):
                for j in at.get(text[i : i + k], ()):
                    chains.setdefault(j - i, []).append(j)
            for starts in chains.values():
                for run in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > 1) + 1):
                    if run[-1] + k - run[0] >= anchor:
                        change[run[0]] += 1
                        change[run[-1] + k] -= 1
    covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return int(np.diff(covered).max() - 1) if len(covered) > 1 else max(len(seq) - len(covered), 0)


def align_pairs(df: DataFrame, keys: list[str], query: str, reference: str, scores: Scores = AFFINE) -> DataFrame:
    """keys with the local alignment of each row's two sequences."""
    columns = ["score", "query_start", "query_end", "reference_start", "reference_end", "matches", "mismatches", "gaps"]

    def run(parts):
        for part in parts:
            found = [local_align(q or "", r or "", scores) for q, r in zip(part["__q"], part["__r"], strict=True)]
            out = part[keys].copy()
            for c in columns:
                out[c] = [getattr(x, c) for x in found]
            out["identity"] = [x.identity for x in found]
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in columns), "identity double"])
    return df.select(*keys, F.col(query).alias("__q"), F.col(reference).alias("__r")).mapInPandas(run, schema)


def best_and_foreign(scored: DataFrame, query: str, own: str, target: str) -> DataFrame:
    """query, own, best_score, foreign_score, score_delta: the best score with its own locus against that with others."""
    is_own = F.col(own) == F.col(target)
    found = scored.groupBy(query, own).agg(F.coalesce(F.max(F.when(is_own, F.col("score"))), F.lit(0)).alias("best_score"), F.coalesce(F.max(F.when(~is_own, F.col("score"))), F.lit(0)).alias("foreign_score"))
    return found.withColumn("score_delta", F.col("best_score") - F.col("foreign_score"))


def validation_status(breadth, identity, delta, least_breadth: float, least_identity: float, least_delta: int):
    """The first gate that fails names the status."""
    return F.when(breadth < least_breadth, "low_breadth").when(identity < least_identity, "low_identity").when(delta < least_delta, "ambiguous").otherwise("validated")


def near_ties(scores: pd.DataFrame, share: float = 0.95) -> int:
    """Other loci whose score is at least `share` of the target's."""
    own = scores.loc[scores["own"], "score"].max()
    return int((scores.loc[~scores["own"], "score"] >= share * own).sum())
