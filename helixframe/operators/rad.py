"""Paired-arm stacks of restriction-site reads: bounded stacks, consensus, catalog matching."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.kernels import edit_distance_within
from helixframe.functions.sequences import bottom_sketch

STACK, SHARED_SEEDS, MOST_POSTINGS, MOST_EDITS = 128, 2, 1024, 3


def bounded_stacks(reads: DataFrame, keys: list[str], hash_: str, size: int = STACK) -> DataFrame:
    """The `size` reads of least hash of each stack."""
    return reads.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_))).where(F.col("__n") <= size).drop("__n")


def plurality(reads: list[str], least: float = 0.5) -> str:
    """The observed read nearest to the column-wise plurality (ties by text); columns that under `least` of the reads
    reach have no say."""
    n = len(reads)
    columns = [Counter(r[i] for r in reads if i < len(r)) for i in range(max(map(len, reads), default=0))]
    text = "".join(min(c, key=lambda b: (-c[b], b)) for c in columns if sum(c.values()) >= least * n)
    return min(sorted(set(reads)), key=lambda r: (sum(a != b for a, b in zip(r, text, strict=False)) + abs(len(r) - len(text)), r)) if reads else ""


def consensus(stacks: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """keys, reads, consensus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys} | {"reads": len(pdf), "consensus": plurality(sorted(pdf[seq]))}
        return pd.DataFrame([row])

    kinds = dict(stacks.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", reads bigint, consensus string"
    return stacks.select(*keys, seq).groupBy(*keys).applyInPandas(run, schema)


def catalog_matches(arms: DataFrame, catalog: DataFrame, k: int = 15, size: int = 16) -> DataFrame:
    """id, locus of arms (id, r1, r2) with one catalog locus (locus, r1, r2) that shares SHARED_SEEDS sketch values on
    each arm and lies within MOST_EDITS on both; arms near several loci equally have none."""
    both = None
    for arm in ("r1", "r2"):
        left = arms.select("id", F.explode(bottom_sketch(arm, k, size)).alias("v"))
        right = catalog.select("locus", F.explode(bottom_sketch(arm, k, size)).alias("v"))
        few = right.join(right.groupBy("v").count().where(F.col("count") <= MOST_POSTINGS), "v").select("locus", "v")
        pairs = left.join(few, "v").groupBy("id", "locus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_SEEDS).select("id", "locus")
        both = pairs if both is None else both.join(pairs, ["id", "locus"])
    named = both.join(arms.select("id", "r1", "r2"), "id").join(catalog.select("locus", F.col("r1").alias("c1"), F.col("r2").alias("c2")), "locus")
    edits = F.array(F.levenshtein("r1", "c1", MOST_EDITS), F.levenshtein("r2", "c2", MOST_EDITS))
    near = named.withColumn("e", edits).where(F.forall("e", lambda x: x >= 0)).withColumn("d", F.get("e", F.lit(0)) + F.get("e", F.lit(1)))
    best = near.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy("d"))).where("r = 1")
    return best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("n = 1").select("id", "locus")


def arms_match(a: tuple[str, str], b: tuple[str, str], most: int = MOST_EDITS) -> bool:
    return all(edit_distance_within(x, y, most) is not None for x, y in zip(a, b, strict=True))
