"""Variant sites: genotype masks, site filters, one site per locus, linkage pruning, principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def called(genotype: Column) -> Column:
    """Whether every allele of a genotype text is there."""
    return F.forall(F.split(genotype, r"[/|]"), lambda a: ~a.isin("", "."))


def site_filter(sites: DataFrame, genotypes: str, least_dp: int, least_gq: int, most_missing: float, least_qual: float, least_mac: int) -> DataFrame:
    """sites that pass, with samples, missing, an, ac: genotypes (gt, dp, gq) under the limits count as missing first."""
    usable = F.filter(genotypes, lambda g: called(g["gt"]) & (g["dp"] >= least_dp) & (g["gq"] >= least_gq))
    alleles = F.flatten(F.transform(usable, lambda g: F.split(g["gt"], r"[/|]")))
    found = sites.withColumns({"samples": F.size(genotypes), "__usable": usable, "__alleles": alleles})
    found = found.withColumns({"missing": F.col("samples") - F.size("__usable"), "an": F.size("__alleles"), "ac": F.size(F.filter("__alleles", lambda a: a != "0"))}).drop("__usable", "__alleles")
    mac = F.least(F.col("ac"), F.col("an") - F.col("ac"))
    return found.where((F.col("missing") / F.col("samples") <= most_missing) & (F.col("qual") >= least_qual) & (F.col("an") > 0) & (mac >= least_mac))


def one_site_per_locus(sites: DataFrame, locus: str) -> DataFrame:
    """The best site of each locus: call rate and median GQ high, median DP near the locus' median, QUAL high, first."""
    middle = sites.groupBy(locus).agg(F.median("dp").alias("__dp"), F.count(F.lit(1)).alias("candidate_snp_count"))
    order = [F.desc("call_rate"), F.desc("gq"), F.abs(F.col("dp") - F.col("__dp")), F.desc("qual"), F.col("position")]
    ranked = sites.join(middle, locus).withColumn("__n", F.row_number().over(Window.partitionBy(locus).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n", "__dp")


def prune_linked(sites: DataFrame, chrom: str, position: str, dosages: str, most_r2: float, window: int) -> DataFrame:
    """sites kept by a greedy pass along each chromosome: one goes if a kept site in the window before it is too alike."""

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, kind="stable")
        x = np.stack([np.asarray(v, float) for v in pdf[dosages]])
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        kept: list[int] = []
        for i, p in enumerate(pdf[position].to_numpy()):
            near = [j for j in kept[-window:] if p - pdf[position].iloc[j] <= window]
            if not norm[i] or not any((x[i] @ x[j] / (norm[i] * norm[j])) ** 2 > most_r2 for j in near if norm[j]):
                kept.append(i)
        return pdf.iloc[kept]

    return sites.groupBy(chrom).applyInPandas(prune, sites.schema)


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with pc1..pck: the covariance is summed on the executors (dimension squared), only it reaches the driver."""
    size = len(df.select(vector).first()[0])

    def moments(batches):
        total, square, n = np.zeros(size), np.zeros((size, size)), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].map(np.asarray)).astype(float)
                total, square, n = total + x.sum(axis=0), square + x.T @ x, n + len(x)
        yield pd.DataFrame({"total": [total.tolist()], "square": [square.ravel().tolist()], "n": [n]})

    parts = df.select(vector).mapInPandas(moments, "total array<double>, square array<double>, n bigint")
    flat = parts.select("n", F.posexplode(F.concat("total", "square")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").toPandas()
    n = max(int(flat["n"].iloc[0]), 1)
    mean = flat["v"].to_numpy()[:size] / n
    covariance = flat["v"].to_numpy()[size:].reshape(size, size) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, np.argsort(values)[::-1][:k]]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)  # signs are free

    def score(i: int) -> Column:
        weights = F.array(*[F.lit(float(a)) for a in axes[:, i]])
        centred = F.zip_with(F.col(vector).cast("array<double>"), weights, lambda x, a: x * a)
        return F.aggregate(centred, F.lit(float(-(mean @ axes[:, i]))), lambda s, x: s + x)

    return df.withColumns({f"pc{i + 1}": score(i) for i in range(k)})


def mapping_quality(coverage: DataFrame, sample: str) -> DataFrame:
    """sample, reference_bases, covered_bases, breadth and mean_depth weighted by length."""
    found = coverage.groupBy(sample).agg(F.sum("length").alias("reference_bases"), F.sum("covered").alias("covered_bases"), (F.sum(F.col("depth") * F.col("length")) / F.sum("length")).alias("mean_depth"))
    return found.withColumn("coverage_breadth", F.col("covered_bases") / F.col("reference_bases"))
