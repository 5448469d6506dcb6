"""Alignment trimming by matches, and cleaning of alignments by a similarity graph."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import reverse_complement_iupac
from helixframe.operators.graph import bridge_components

LEAST_COLUMNS = 7


def trim(sequences: DataFrame, matches: DataFrame, id_: str, seq: str, mode: str = "longest", retention: float = 0.0) -> DataFrame:
    """id, trimmed, kept_length, length: what matches (query, query_start, query_end, strand) leave of each sequence.

    Modes: all joins merged matches, longest keeps the longest merged one, terminal spans first to last, isoform
    joins them with N between.  The strand with more matched bases stays (forward if equal), turned if reverse;
    sequences go whose matched share of 100 is at most `retention`.
    """
    if mode not in ("all", "longest", "terminal", "isoform"):
        raise ValueError(f"unknown trim mode {mode}")
    m = matches.select(F.col("query").alias(id_), F.col("query_start").alias("a"), F.col("query_end").alias("b"), "strand")
    size = F.sum(F.col("b") - F.col("a"))
    strands = m.groupBy(id_).agg(F.coalesce(F.sum(F.when(F.col("strand") == "+", F.col("b") - F.col("a"))), F.lit(0)).alias("f"), size.alias("t"))
    one = m.join(strands, id_).where(F.col("strand") == F.when(F.col("f") * 2 >= F.col("t"), "+").otherwise("-"))
    w = Window.partitionBy(id_).orderBy("a", "b")
    opened = one.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    islands = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(id_, "strand", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = islands.groupBy(id_, "strand").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"), F.sum(F.col("b") - F.col("a")).alias("matched"))
    cut = lambda x: F.substring(F.col(seq), x["a"] + 1, x["b"] - x["a"])
    found = sequences.select(id_, seq).join(spans, id_)
    longest = F.aggregate("s", F.get("s", F.lit(0)), lambda best, x: F.when(x["b"] - x["a"] > best["b"] - best["a"], x).otherwise(best))
    text = {
        "all": F.array_join(F.transform("s", cut), ""),
        "isoform": F.array_join(F.transform("s", cut), "N"),
        "longest": cut(longest),
        "terminal": F.substring(F.col(seq), F.get("s", F.lit(0))["a"] + 1, F.element_at("s", -1)["b"] - F.get("s", F.lit(0))["a"]),
    }[mode]
    trimmed = F.when(F.col("strand") == "-", reverse_complement_iupac(text)).otherwise(text)
    kept = found.where(F.col("matched") * 100.0 / F.length(seq) > retention)
    return kept.select(id_, trimmed.alias("trimmed"), F.length(text).alias("kept_length"), F.length(seq).alias("length"))


def similar(a: str, b: str, difference: float) -> bool:
    """At least LEAST_COLUMNS columns that neither has as - or ?, of which 1 - difference are equal."""
    seen = [x == y for x, y in zip(a, b, strict=True) if x not in "-?" and y not in "-?"]
    return len(seen) >= LEAST_COLUMNS and sum(seen) >= (1 - difference) * len(seen)


def clean_rows(rows: list[tuple[str, str]], difference: float, least: int) -> list[tuple[str, str]]:
    """(name, seq) of an alignment: rows of components of the similarity graph without its bridges that have at least
    max(2, least) rows, the components' columns side by side, gap-only columns dropped."""
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if similar(rows[i][1], rows[j][1], difference)]
    parts = [sorted(p) for p in bridge_components(edges, list(range(len(rows)))) if len(p) >= max(2, least)]
    names = [i for p in parts for i in p]
    out: dict[int, str] = dict.fromkeys(names, "")
    for part in parts:
        columns = [c for c in range(len(rows[part[0]][1])) if any(rows[i][1][c] not in "-?" for i in part)]
        for i in names:
            out[i] += "".join(rows[i][1][c] for c in columns) if i in part else "-" * len(columns)
    return [(rows[i][0], out[i]) for i in sorted(out)]


def clean(alignments: DataFrame, locus: str, name: str, seq: str, difference: float = 0.2, least: int = 2) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable")
        rows = clean_rows(list(zip(pdf[name], pdf[seq], strict=True)), difference, least)
        return pd.DataFrame([(pdf[locus].iloc[0], *r) for r in rows], columns=[locus, name, seq])

    return alignments.select(locus, name, seq).groupBy(locus).applyInPandas(run, alignments.select(locus, name, seq).schema)
