"""Organelle contigs: overlap merging, unique bridges, circle tests, junction support, rotation."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame

from helixframe.operators.alignment import reverse_complement
from helixframe.operators.assembly import BASES, windows

MOST_NODES = 250_000


def overlap(a: str, b: str, least: int, identity: float) -> int:
    """Length of the longest overlap of a's end with b's start of enough identity; 0 if none."""
    for n in range(min(len(a), len(b)), least - 1, -1):
        if sum(x == y for x, y in zip(a[-n:], b[:n], strict=True)) >= identity * n:
            return n
    return 0


def merge_pair(a: str, b: str, n: int) -> str:
    """Bases that differ in the overlap become N."""
    middle = "".join(x if x == y else "N" for x, y in zip(a[-n:], b[:n], strict=True))
    return a[:-n] + middle + b[n:]


def collapse(contigs: list[str], least: int = 31, identity: float = 0.95) -> list[str]:
    """Contigs merged, the longest overlap first, until none is left; contained ones go."""
    found = sorted(set(contigs), key=lambda c: (-len(c), c))
    found = [c for i, c in enumerate(found) if not any(c in d or reverse_complement(c) in d for d in found[:i])]
    while True:
        best = None
        for i, a in enumerate(found):
            for j, b in enumerate(found):
                if i != j:
                    for x in (a, reverse_complement(a)):
                        n = overlap(x, b, least, identity)
                        if n and (best is None or (n, -i, -j) > best[0]):
                            best = ((n, -i, -j), i, j, x, b)
        if best is None:
            return found
        (n, *_), i, j, a, b = best
        found = sorted([c for at, c in enumerate(found) if at not in (i, j)] + [merge_pair(a, b, n)], key=lambda c: (-len(c), c))


def bridge(start: str, end: str, reads: list[str], k: int, most_length: int) -> str | None:
    """The bases between two contig ends if the shortest path through the reads' k-mers is the only one that short."""
    words = {w for r in reads for w in windows(r, k)}
    words |= {reverse_complement(w) for w in words}
    source, target = start[-k:], end[:k]
    ways, distance, before = defaultdict(int), {source: 0}, {}
    ways[source] = 1
    todo = deque([source])
    while todo and len(distance) <= MOST_NODES:
        w = todo.popleft()
        if w == target or distance[w] >= most_length:
            continue
        for b in BASES:
            v = w[1:] + b
            if v in words or v == target:
                if v not in distance:
                    distance[v], before[v] = distance[w] + 1, w
                    todo.append(v)
                if distance[v] == distance[w] + 1:
                    ways[v] = min(2, ways[v] + ways[w])
    if ways.get(target) != 1 or target == source:
        return None
    path, w = [], target
    while w != source:
        path.append(w[-1])
        w = before[w]
    return "".join(reversed(path))[: max(distance[target] - k, 0)]


def circle(contig: str, least: int = 31, identity: float = 0.995) -> str | None:
    """One round of a contig whose end overlaps its start, or which runs through a circle more than once."""
    n = 0
    for size in range(len(contig) // 2, least - 1, -1):
        if sum(x == y for x, y in zip(contig[-size:], contig[:size], strict=True)) >= identity * size:
            n = size
            break
    return contig[:-n] if n else None


def junction_support(contig: str, reads: list[str], flank: int = 20, mismatches: int = 1) -> int:
    """The least number of reads, over windows across a circle's seam, that hold a window with so few mismatches.

    Windows that recur inside the contig say nothing and are left out; 0 if all do.
    """
    seam = contig[-flank:] + contig[:flank]
    size = flank + flank // 2
    found = []
    for i in range(len(seam) - size + 1):
        window = seam[i : i + size]
        if window in contig or reverse_complement(window) in contig:
            continue
        near = lambda text: any(sum(x != y for x, y in zip(text[j : j + size], window, strict=True)) <= mismatches for j in range(len(text) - size + 1))  # noqa: B023, E731
        found.append(sum(near(r) or near(reverse_complement(r)) for r in reads))
    return min(found, default=0)


def least_rotation(seq: str) -> str:
    """The least rotation of a circle or of its reverse complement, in linear time."""

    def least(s: str) -> str:
        i, j, k, n = 0, 1, 0, len(s)
        while i < n and j < n and k < n:
            a, b = s[(i + k) % n], s[(j + k) % n]
            if a == b:
                k += 1
                continue
            if a > b:
                i += k + 1
            else:
                j += k + 1
            j += i == j
            k = 0
        at = min(i, j)
        return s[at:] + s[:at]

    return min(least(seq), least(reverse_complement(seq))) if seq else seq


def standard_rotation(seq: str, anchor: str, share: float = 0.15, most: int = 120) -> str:
    """The circle turned to begin at its first anchor match (either strand), if a start of up to `share` of the
    anchor, `most` bases at most, may be missing."""
    lead = min(int(len(anchor) * share), most)
    for text in (seq, reverse_complement(seq)):
        double = text + text
        for skip in range(lead + 1):
            at = double.find(anchor[skip : skip + 21]) if len(anchor) >= skip + 21 else -1
            if 0 <= at < len(text) + skip:
                begin = (at - skip) % len(text)
                return text[begin:] + text[:begin]
    return seq


def merge_samples(contigs: DataFrame, sample: str, seq: str, least: int = 31, identity: float = 0.95) -> DataFrame:
    """sample, contig, length, circular of each sample's merged contigs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c in collapse(sorted(pdf[seq]), least, identity):
            ring = circle(c, least)
            rows.append((pdf[sample].iloc[0], least_rotation(ring) if ring else c, len(ring or c), ring is not None))
        return pd.DataFrame(rows, columns=[sample, "contig", "length", "circular"])

    kind = dict(contigs.dtypes)[sample]
    return contigs.select(sample, seq).groupBy(sample).applyInPandas(run, f"`{sample}` {kind}, contig string, length bigint, circular boolean")
