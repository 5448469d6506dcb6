"""Clade selection in gene trees: disjoint clades with at most one leaf of each sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from helixframe.sources.formats import parse_newick


def sides(nodes: list[tuple[int, int, str]]) -> list[frozenset[str]]:
    """The leaf sets on both sides of each edge."""
    children: dict[int, list[int]] = {}
    for i, parent, _ in nodes:
        children.setdefault(parent, []).append(i)
    leaves: dict[int, frozenset[str]] = {}
    for i, _, label in reversed(nodes):  # children follow their parents
        leaves[i] = frozenset([label]) if i not in children else frozenset().union(*(leaves[c] for c in children[i]))
    all_ = leaves[0]
    return [s for i, parent, _ in nodes if parent >= 0 for s in (leaves[i], all_ - leaves[i])]


def select_clades(newick: str, outgroup: frozenset[str] = frozenset(), least: int = 2) -> list[list[str]]:
    """Disjoint clades of one leaf a sample (a label's part before |), the largest first, then by leaves.

    An outgroup must stand on one side of exactly one edge; then clades are those that lie on the other.
    """
    found = set(sides(parse_newick(newick)))
    sample = lambda leaf: leaf.split("|")[0]
    if outgroup:
        rooted = [s for s in found if {sample(x) for x in s} == outgroup and all(sample(x) in outgroup for x in s)]
        if len(rooted) != 1:
            return []
        found = {s for s in found if not s & rooted[0]}
    single = [s for s in found if len(s) >= least and len({sample(x) for x in s}) == len(s)]
    chosen: list[list[str]] = []
    taken: set[str] = set()
    for s in sorted(single, key=lambda s: (-len(s), sorted(s))):
        if not s & taken:
            chosen.append(sorted(s))
            taken |= s
    return chosen


def clades(trees: DataFrame, family: str, newick: str, outgroup: list[str] | None = None, least: int = 2) -> DataFrame:
    """family, clade (from 1), leaf."""

    def run(parts):
        for part in parts:
            rows = [(f, i, leaf) for f, t in zip(part[family], part[newick], strict=True) for i, c in enumerate(select_clades(t, frozenset(outgroup or ()), least), 1) for leaf in c]
            yield pd.DataFrame(rows, columns=[family, "clade", "leaf"])

    return trees.select(family, newick).mapInPandas(run, f"`{family}` {dict(trees.dtypes)[family]}, clade int, leaf string")
