"""How the sample tables stand in for sequencing data, in Spark and in SQL.

fragments: documents; loci: benchmark; pairs: turns 2i and 2i+1 of a conversation; samples: sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import dna_of_text
from helixframe.operators.tables import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frag, seq"""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("frag"), dna_of_text("text").alias("seq"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, seq"""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("locus"), dna_of_text("text").alias("seq"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frag (conversation and number of the pair), r1, r2"""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", dna_of_text("text").alias("seq"))
    first = turns.where("turn % 2 = 0").select("conv_id", (F.col("turn") / 2).cast("bigint").alias("pair"), F.col("seq").alias("r1"))
    second = turns.where("turn % 2 = 1").select("conv_id", ((F.col("turn") - 1) / 2).cast("bigint").alias("pair"), F.col("seq").alias("r2"))
    return first.join(second, ["conv_id", "pair"]).select((F.col("conv_id") * 10000 + F.col("pair")).alias("frag"), "r1", "r2")


# The same as SQL ----------------------------------------------------------------------------------------

SQL_PAIRS = "pairs AS (SELECT a.conv_id * 10000 + a.turn // 2 AS frag, {a} AS r1, {b} AS r2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)"


def dna(column: str) -> str:
    return f"translate(lower(regexp_replace({column}, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def rc(expression: str) -> str:
    return f"reverse(translate({expression}, 'ACGT', 'TGCA'))"


def sql_windows(name: str, source: str, ids: str, seq: str, k: int, canonical: bool = True) -> str:
    """A CTE name(ids, pos, kmer) of the k-wide windows of seq."""
    kmer = f"least(f, {rc('f')})" if canonical else "f"
    return f"{name} AS (SELECT {ids}, pos, {kmer} AS kmer FROM (SELECT {ids}, pos, substring(s, pos + 1, {k}) AS f FROM (SELECT {ids}, {seq} AS s, unnest(range(0, greatest(length({seq}) - {k - 1}, 0))) AS pos FROM {source})))"


FRAGMENTS = f"fragments AS (SELECT doc_id AS frag, source, lang, {dna('text')} AS seq FROM documents)"
LOCI = f"loci AS (SELECT item_id AS locus, {dna('text')} AS seq FROM benchmark)"
PAIRS = SQL_PAIRS.format(a=dna("a.text"), b=dna("b.text"))
