"""Workflow steps: recruitment with fallback, the probe gate, rescue decisions, run profiles and manifests."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import evidence, recruit
from helixframe.operators.tables import stored

#: Fixed values of automatic recruitment: fast and fallback k-mers with their steps, overlap and identity.
FAST_K, FAST_STEP, FALLBACK_K, FALLBACK_STEP, OVERLAP, IDENTITY = 23, 4, 21, 1, 45, 0.80
#: Fixed values of the probe gate.
LEAST_LENGTH, LEAST_COVERAGE, LEAST_IDENTITY, NEAR_TIE, REVIEW_GAP = 200, 0.8, 0.8, 0.95, 40


def auto_recruit(frags: DataFrame, refs: DataFrame, fast: tuple[int, int] = (FAST_K, FAST_STEP), fallback: tuple[int, int] = (FALLBACK_K, FALLBACK_STEP), overlap: int = OVERLAP) -> DataFrame:
    """frag, locus, pass: a fast pass; then, for loci it left without fragments, a finer one whose exact match reaches
    `overlap` and whose fragments have that locus alone on the whole panel."""
    first = stored(recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", fast[0]), *fast))
    unresolved = refs.select("locus").join(first.select("locus").distinct(), "locus", "left_anti")
    full = recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", fallback[0]), *fallback)
    alone = full.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("frag"))).where("n = 1").drop("n").join(unresolved, "locus", "left_semi")
    long = evidence.maximal_matches(alone, frags, refs, evidence.verify_k(fallback[0])).where(F.col("length") >= overlap)
    return first.withColumn("pass", F.lit("fast")).unionByName(long.select("frag", "locus").withColumn("pass", F.lit("fallback")))


def probe_gate(length: Column, coverage: Column, identity: Column, target: Column, other: Column, inverted: Column, gap: Column) -> Column:
    """accepted, review or the reason of a rejection: the first check that holds."""
    return (
        F.when(length < LEAST_LENGTH, "too_short")
        .when(coverage < LEAST_COVERAGE, "low_probe_coverage")
        .when(identity < LEAST_IDENTITY, "low_identity")
        .when(other >= target * NEAR_TIE, "near_tie")
        .when(inverted, "inverted_repeat")
        .when(gap >= REVIEW_GAP, "review")
        .otherwise("accepted")
    )


def rescue_decision(active: Column, accepted: Column, density_ratio: Column, second_round: Column, terminal_ok: Column, new_inverted: Column, new_gap: Column) -> Column:
    """What becomes of a locus after a rescue round, its checks in order."""
    return (
        F.when(~active, "inactive")
        .when(~accepted, "revert_not_accepted")
        .when(density_ratio < 0.5, "revert_low_density")
        .when(second_round & ~terminal_ok, "trim_terminal")
        .when(new_inverted, "revert_inverted_repeat")
        .when(new_gap, "revert_gap")
        .otherwise("accept")
    )


def rescue_rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """state (locus, round, ...) with each round's rows added; a round sees the latest row of each locus."""
    for n in range(1, rounds + 1):
        newest = Window.partitionBy("locus").orderBy(F.desc("round"))
        latest = state.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        state = stored(state.unionByName(step(latest, n).withColumn("round", F.lit(n))))
    return state


def doubling_budget(run: Callable[[int], str | None], first: int = 10, last: int = 320) -> tuple[int, str | None]:
    """(budget, result) of the first budget, doubled each time, whose verified result equals the one before."""
    before, budget = None, first
    while True:
        found = run(budget)
        if found is not None and found == before or budget * 2 > last:
            return budget, found
        before, budget = found, budget * 2


#: Rows of a range of even_sample.
ROWS_A_RANGE = 250_000


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows evenly spread in order: those at i * (rows - 1) / (n - 1).

    Rows are dealt to ranges of the order of about ROWS_A_RANGE rows, which are ranked each by itself.
    """
    total = df.count()
    if total <= n or n < 2:
        return df.orderBy(order).limit(n)
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS_A_RANGE))
    dealt = stored(df.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()))
    before, wanted, rest = 0, [], [i * (total - 1) // (n - 1) for i in range(n)]
    for number, rows in dealt.groupBy("__range").count().orderBy("__range").collect():
        wanted += [(number, i - before) for i in rest if before <= i < before + rows]
        before += rows
    places = F.broadcast(df.sparkSession.createDataFrame(wanted, "__range int, __n int"))
    few = dealt.join(F.broadcast(places.select("__range").distinct()), "__range", "left_semi").repartition(ranges, "__range")
    ranked = few.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1)
    return ranked.join(places, ["__range", "__n"], "left_semi").drop("__range", "__n")


def accepted_row(accepted: Column, status: Column, low_quality: Column) -> Column:
    """The accepted flag where there is one; else a success that isn't of low quality."""
    flag = F.lower(accepted.cast("string")).isin("1", "true", "yes")
    return F.when(accepted.isNotNull() & (accepted.cast("string") != ""), flag).otherwise((status == "success") & ~F.coalesce(low_quality, F.lit(False)))


@dataclass
class Profile:
    """Wall times and row counts of named stages."""

    rows: list[dict] = field(default_factory=list)

    def run(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        began, status, found = time.time(), "failed", None
        try:
            found = stored(work())
            status = "succeeded"
            return found
        finally:
            self.rows.append({"stage": stage, "wall_ms": int((time.time() - began) * 1000), "rows": found.count() if found is not None else None, "status": status})


def manifest(parameters: dict, inputs: dict[str, DataFrame]) -> dict:
    """Parameters and a digest of each input's rows (independent of their order), with a digest of it all."""
    digests = {}
    for name, df in sorted(inputs.items()):
        n, total = df.select(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        digests[name] = f"{n}:{total or 0}"
    body = {"parameters": parameters, "inputs": digests}
    return body | {"artifact_hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def publish(df: DataFrame, path: str) -> None:
    """df under path, whole or not at all: it is written beside it and renamed, the former table removed last."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = (hadoop(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    df.write.mode("overwrite").parquet(str(fresh.toString()))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        fs.rename(old, target)
        raise OSError(f"could not publish {path}")
    fs.delete(old, True)
