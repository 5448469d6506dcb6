"""Sinks: text lines of FASTA, FASTQ, GFA, partition and table files, and partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(seq: str | Column, width: int = 80) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_lines(df: DataFrame, name: str, seq: str, order: list[str], width: int | None = 80) -> DataFrame:
    """value: a record (title and sequence) a row, in order."""
    body = wrapped(seq, width) if width else F.col(seq)
    return df.orderBy(*order).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def fastq_lines(df: DataFrame, header: str, seq: str, qual: str, order: list[str] | None = None) -> DataFrame:
    """value: a record a row; without an order they stay where they are."""
    return (df.orderBy(*order) if order else df).select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(header)), F.col(seq), F.lit("+"), F.col(qual)).alias("value"))


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    s = segments.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("key"), F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), "seq").alias("value"))
    l = links.select(F.lit(2).alias("part"), F.col("a").cast("string").alias("key"), F.concat_ws("\t", F.lit("L"), F.col("a").cast("string"), sign("a_reverse"), F.col("b").cast("string"), sign("b_reverse"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))  # noqa: E741
    head = segments.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("H\tVN:Z:1.0").alias("value"))
    return head.unionByName(s).unionByName(l).orderBy("part", "key", "value").select("value")


def partition_lines(partitions: DataFrame, locus: str) -> DataFrame:
    """NEXUS character sets of a supermatrix."""
    return partitions.orderBy("start").select(F.concat(F.lit("charset "), F.col(locus), F.lit(" = "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(";")).alias("value"))


def evidence_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_by_locus(df: DataFrame, path: str, locus: str = "locus", rows_a_file: int = 5_000_000) -> None:
    """One folder for each locus; large loci have several files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(locus).parquet(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
