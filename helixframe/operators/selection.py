"""Depth-adaptive selection of a locus' candidate fragments, as window ranks over the locus.

Candidates have: locus, id, bases, max_exact, locus_count, mates, left_extension, right_extension, terminal_mask
(1 left, 2 right), covered_bins (mask), bin (of its midpoint, null if none).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.tables import stored

#: Fixed values of the automatic mode.
LEAST_CANDIDATES, ACTIVATION_DEPTH, LEAST_BINS, TARGET_DEPTH, RETAIN = 512, 160.0, 48, 80.0, (3, 5)
PER_EXTENSION, PER_SIDE, BINS = 4, 768, 64
#: Candidates of whole loci that one task ranks, about.
ROWS_A_TASK = 100_000
#: Reads of a block, in which caps on reads are given.
BLOCK_READS = 2**20


def select_auto(candidates: DataFrame, effective_length: float) -> DataFrame:
    """candidates with mode, target and selected.

    Small, shallow or narrow loci pass through.  Others keep, by side, at most PER_EXTENSION terminal reads of each
    extension and PER_SIDE in all; then the best of each bin up to its quota, then the best of the rest, until the
    target is met.  Terminal reads aren't counted towards it unless the bin pass meets them again.
    """
    locus = Window.partitionBy("locus")
    totals = candidates.groupBy("locus").agg(F.count(F.lit(1)).alias("eligible"), F.sum("bases").alias("total_bases"), F.bit_count(F.bit_or("covered_bins")).alias("bins"))
    n = F.col("eligible")
    passes = (n < LEAST_CANDIDATES) | (F.col("total_bases") / F.lit(effective_length) <= ACTIVATION_DEPTH) | (F.col("bins") < LEAST_BINS)
    by_depth = F.ceil(F.lit(TARGET_DEPTH * effective_length) / (F.col("total_bases") / n))
    target = F.least(F.greatest(by_depth, F.lit(LEAST_CANDIDATES), F.ceil(n * RETAIN[0] / RETAIN[1])), n)
    totals = totals.select("locus", "eligible", F.when(passes, "pass_through").otherwise("core").alias("mode"), F.when(passes, n).otherwise(target).alias("target"))
    totals = stored(totals)
    # All ranks of a locus are in one task, which holds its rows once for each of them.
    rows = totals.agg(F.sum("eligible")).first()[0] or 0
    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    quality = [F.col("locus_count"), F.desc("max_exact"), F.desc("mates"), F.col("id")]
    found = candidates.repartition(tasks, "locus").join(totals.repartition(tasks, "locus"), "locus")
    for side, bit in (("left", 1), ("right", 2)):
        at_end = F.col("terminal_mask").bitwiseAND(bit) != 0
        extension = f"{side}_extension"
        ladder = F.row_number().over(Window.partitionBy("locus", at_end, extension).orderBy(*quality))
        found = found.withColumn(f"__{side}", at_end & (ladder <= PER_EXTENSION))
        order = F.row_number().over(Window.partitionBy("locus", f"__{side}").orderBy(F.desc(extension), *quality))
        found = found.withColumn(f"__{side}", F.col(f"__{side}") & (order <= PER_SIDE))
    quota = F.greatest(F.ceil(F.col("target") / BINS), F.lit(1))
    in_quota = F.col("bin").isNotNull() & (F.row_number().over(Window.partitionBy("locus", "bin").orderBy(*quality)) <= quota)
    found = found.withColumn("__quota", in_quota)
    core = F.col("__quota") & (F.row_number().over(Window.partitionBy("locus", "__quota").orderBy(*quality)) <= F.col("target"))
    found = found.withColumn("__core", core).withColumn("__in_core", F.sum(F.col("__core").cast("bigint")).over(locus))
    found = found.withColumn("__rest", ~(F.col("__core") | F.col("__left") | F.col("__right")))
    fill = F.col("__rest") & (F.row_number().over(Window.partitionBy("locus", "__rest").orderBy(*quality)) <= F.col("target") - F.col("__in_core"))
    chosen = (F.col("mode") == "pass_through") | F.col("__left") | F.col("__right") | F.col("__core") | fill
    return found.withColumn("selected", chosen).drop("__left", "__right", "__quota", "__core", "__in_core", "__rest")


def thin_every_n(df: DataFrame, keys: list[str], order: list[str], interval: int) -> DataFrame:
    """Each interval-th row of a key, in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") % interval == 0).drop("__n")


def choose_exact(histogram: dict[int, int], effective_length: float, first_k: int, least_depth: float, most_depth: float, most_mb: int) -> tuple[int | None, int | None, int]:
    """(least exact match, thinning interval, bases left) for bases by longest exact match.

    k rises by 2, or by 6 far above the limits, until depth and size fit; a step under the least depth is undone.
    """
    total = all_ = sum(histogram.values())
    if not histogram or effective_length <= 0:
        return None, None, 0
    deep = lambda x: x / effective_length > most_depth
    large = lambda x: x // 1_000_000 > most_mb
    if not deep(total) and not large(total):
        return None, None, total
    least_depth, k = min(least_depth, most_depth / 4), first_k
    while k < 64 and (deep(total) or large(total)):
        step = 6 if total / effective_length > 8 * most_depth or total // 1_000_000 > 6 * most_mb else 2
        longer = sum(n for exact, n in histogram.items() if exact >= k + step)
        if longer / effective_length < least_depth:
            break
        k, total = k + step, longer
    if k == first_k and not large(total):
        return None, None, all_
    return k, max(int(total / 1e6 / most_mb), 2) if large(total) else None, total


def legacy_decisions(candidates: DataFrame, effective_length: float, first_k: int, least_depth: float, most_depth: float, most_mb: int) -> DataFrame:
    """locus, minimum_exact, thinning_interval, total_bases; from sums of bases by longest exact match."""
    sums = candidates.groupBy("locus", "max_exact").agg(F.sum("bases").alias("bases"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        k, interval, total = choose_exact({int(a): int(b) for a, b in zip(pdf["max_exact"], pdf["bases"], strict=True)}, effective_length, first_k, least_depth, most_depth, most_mb)
        return pd.DataFrame({"locus": pdf["locus"].iloc[:1], "minimum_exact": pd.array([k], "Int64"), "thinning_interval": pd.array([interval], "Int64"), "total_bases": [total]})

    kind = dict(candidates.dtypes)["locus"]
    return sums.groupBy("locus").applyInPandas(decide, f"locus {kind}, minimum_exact bigint, thinning_interval bigint, total_bases bigint")


def refilter(candidates: DataFrame, effective_length: float, first_k: int = 31, least_depth: float = 50, most_depth: float = 768, most_mb: int = 6) -> DataFrame:
    """Candidates that the legacy decision of their locus leaves, thinned in the order of id if need be."""
    decisions = legacy_decisions(candidates, effective_length, first_k, least_depth, most_depth, most_mb)
    passing = candidates.join(decisions, "locus").where(F.col("minimum_exact").isNull() | (F.col("max_exact") >= F.col("minimum_exact")))
    n = F.row_number().over(Window.partitionBy("locus").orderBy("id"))
    return passing.withColumn("__n", n).where(F.col("thinning_interval").isNull() | (F.col("__n") % F.col("thinning_interval") == 0)).drop("__n")


def smallest_hashes(df: DataFrame, sample: str, order: str, cap: int, taxon: str | None = None) -> DataFrame:
    """The cap rows of least `order` of each sample; with a taxon, cap is shared among the taxon's samples."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(sample).orderBy(order)))
    if taxon is None:
        return ranked.where(F.col("__n") <= cap).drop("__n")
    samples = df.select(taxon, sample).distinct().groupBy(taxon).agg(F.count(F.lit(1)).alias("__samples"))
    return ranked.join(samples, taxon).where(F.col("__n") <= F.greatest(F.floor(F.lit(cap) / F.col("__samples")), F.lit(1))).drop("__n", "__samples")


def smallest_of_cohort(df: DataFrame, order: list[str], cap: int = 50_000) -> DataFrame:
    """The cap rows of least `order` of all samples together: each task gives its cap least ones, one merges these."""
    return df.orderBy(*order).limit(cap)


def read_cap(reads: DataFrame, ordinal: str, blocks: int) -> DataFrame:
    """The reads of the first `blocks` blocks of BLOCK_READS, by their ordinal in the file from 0; all for 0 blocks."""
    return reads.where(F.col(ordinal) < blocks * BLOCK_READS) if blocks > 0 else reads
