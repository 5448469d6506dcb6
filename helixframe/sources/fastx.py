"""FASTQ and FASTA files as tables, read by Spark's own text reader (any file system, gzip by ending, splits).

Lines are numbered per file: within a split by their order, before it by the counts of earlier splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import locus_name, pair_id

FASTQ_ENDINGS, FASTA_ENDINGS = ("fastq", "fq", "gz"), ("fasta", "fa", "fas", "fna", "ffn")


def kind_of(path: str) -> str:
    """fastq or fasta, by a file's ending; a bare .gz counts as FASTQ."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(tuple(f".{x}" for x in FASTA_ENDINGS)):
        return "fasta"
    if name.endswith(tuple(f".{x}" for x in FASTQ_ENDINGS)) or path.lower().endswith(".gz"):
        return "fastq"
    raise ValueError(f"neither FASTQ nor FASTA by its ending: {path}")


def numbered_lines(spark: SparkSession, path: str | list[str], drop_blank: bool = True) -> DataFrame:
    """file, n (from 0), line (without line end) of each line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("__at"))
    if drop_blank:
        raw = raw.where(F.trim("line") != "")
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("__at")) - 1
    return raw.withColumn("__inside", inside).join(sizes.withColumn("__before", before), ["file", "block"]).select("file", (F.col("__before") + F.col("__inside")).alias("n"), "line")


def _check(condition, message: str, value):
    """value, or an error where the condition fails."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _is_blank() -> Column:
    return F.trim("line") == ""


def _without_gaps(lines: DataFrame) -> DataFrame:
    """lines, numbered anew, without blank ones between records.

    A blank line between a header and a plus line is a sequence, and one after such a plus line its quality; no other line
    of a record is blank, and no record has a plus line elsewhere.
    """
    blank = lines.where(_is_blank()).select("file", "n")
    near = blank
    for name, step in (("after", 1), ("before", -1), ("before2", -2), ("before3", -3)):
        near = near.join(lines.select("file", (F.col("n") - step).alias("n"), F.col("line").alias(name)), ["file", "n"], "left")
    is_seq = F.col("before").startswith("@") & F.col("after").startswith("+")
    is_qual = F.col("before").startswith("+") & (F.trim("before2") == "") & F.col("before3").startswith("@")
    gaps = near.where(~F.coalesce(is_seq | is_qual, F.lit(False))).select("file", "n")
    rest = lines.join(gaps, ["file", "n"], "left_anti").withColumn("__block", F.floor(F.col("n") / 100_000))
    sizes = rest.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("file", "__block").orderBy("n")) - 1
    return rest.withColumn("__inside", inside).join(sizes.withColumn("__before", before), ["file", "__block"]).select("file", (F.col("__before") + F.col("__inside")).alias("n"), "line")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord (from 0), header, seq, plus, qual; a malformed record is an error.

    Blank lines before a header are passed over; those of a read without bases are its sequence and quality.
    """
    lines = numbered_lines(spark, path, drop_blank=False)
    if not lines.where(_is_blank()).isEmpty():
        lines = _without_gaps(lines)
    records = lines.groupBy("file", F.floor(F.col("n") / 4).cast("bigint").alias("ord")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("line"))).alias(c) for i, c in enumerate(("header", "seq", "plus", "qual"))])
    whole = F.col("header").isNotNull() & F.col("seq").isNotNull() & F.col("plus").isNotNull() & F.col("qual").isNotNull()
    good = F.coalesce(whole & F.col("header").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False))
    return records.withColumn("seq", _check(good, "malformed FASTQ record", F.col("seq"))).select("file", "ord", F.expr("substring(header, 2)").alias("header"), "seq", "plus", "qual")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, name (the whole title), seq (white space dropped); sequence before any title is an error."""
    lines = numbered_lines(spark, path)
    title = F.col("line").startswith(">")
    # Records are numbered like lines: by titles within a block of lines, then by earlier blocks' titles.
    block = F.floor(F.col("n") / 100_000)
    marked = lines.withColumns({"__title": title.cast("bigint"), "__block": block})
    sizes = marked.groupBy("file", "__block").agg(F.sum("__title").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("__title").over(Window.partitionBy("file", "__block").orderBy("n"))
    numbered = marked.withColumn("__inside", inside).join(sizes.withColumn("__before", before), ["file", "__block"]).withColumn("ord", F.col("__before") + F.col("__inside") - 1)
    checked = numbered.withColumn("line", _check(F.col("ord") >= 0, "sequence before any FASTA title", F.col("line")))
    parts = F.transform(F.sort_array(F.collect_list(F.when(~title, F.struct("n", "line")))), lambda x: F.regexp_replace(x["line"], r"\s", ""))
    return checked.groupBy("file", "ord").agg(F.trim(F.expr("substring(max(CASE WHEN line LIKE '>%' THEN line END), 2)")).alias("name"), F.array_join(parts, "").alias("seq"))


def read_references(spark: SparkSession, folder: str) -> DataFrame:
    """locus (file stem), ref_ord, name, seq of a folder of FASTA files; two files of one stem are an error."""
    found = read_fasta(spark, folder).withColumn("locus", locus_name("file"))
    same = found.groupBy("locus").agg(F.countDistinct("file").alias("n")).where("n > 1").select("locus").limit(5).collect()
    if same:
        raise ValueError(f"files of one stem: {[r[0] for r in same]}")
    return found.select("locus", F.col("ord").alias("ref_ord"), "name", "seq")


def _file_numbers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pair: the files of one side of pairs, numbered by name; those of a list in its order."""
    names = [f for x in ([path] if isinstance(path, str) else path) for f in sorted(spark.read.text(x).inputFiles())]
    # One names a file by file:///, the other by file:/.
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", f), i) for i, f in enumerate(dict.fromkeys(names))], "file string, pair int")


def read_pairs(spark: SparkSession, r1: str | list[str], r2: str | list[str], check_ids: bool = True) -> DataFrame:
    """pair (number of the pair of files), frag_ord, frag_id, r1, r2 (structs of header, seq, qual): mates on one row.

    The files of a side are taken by name, those of a list in its order; the n-th of r1 has the mates of the n-th of r2.
    Unequal numbers of files or of reads are an error.
    """
    sides = []
    for path, name in ((r1, "r1"), (r2, "r2")):
        reads = read_fastq(spark, path)
        numbers = _file_numbers(spark, path)
        sides.append((numbers.count(), reads.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")).join(F.broadcast(numbers), "file").select("pair", "ord", F.struct("header", "seq", "qual").alias(name))))
    if sides[0][0] != sides[1][0]:
        raise ValueError(f"{sides[0][0]} files of first mates, {sides[1][0]} of second ones")
    both = sides[0][1].join(sides[1][1], ["pair", "ord"], "full_outer")
    same = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    if check_ids:
        same = same & (pair_id("r1.header") == pair_id("r2.header"))
    return both.select("pair", F.col("ord").alias("frag_ord"), _check(same, "mates don't match", pair_id("r1.header")).alias("frag_id"), "r1", "r2")


def read_interleaved(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, frag_ord, frag_id, r1, r2 of files with mates in turn."""
    reads = read_fastq(spark, path).select("file", F.floor(F.col("ord") / 2).alias("frag_ord"), (F.col("ord") % 2).alias("mate"), F.struct("header", "seq", "qual").alias("r"))
    both = reads.groupBy("file", "frag_ord").agg(F.max(F.when(F.col("mate") == 0, F.col("r"))).alias("r1"), F.max(F.when(F.col("mate") == 1, F.col("r"))).alias("r2"))
    same = F.col("r2").isNotNull() & (pair_id("r1.header") == pair_id("r2.header"))
    return both.select("file", "frag_ord", _check(F.coalesce(same, F.lit(False)), "mates don't match", pair_id("r1.header")).alias("frag_id"), "r1", "r2")
