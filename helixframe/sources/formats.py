"""Tables from SAM, VCF, GFA, GFF3, BLAST tabular, RAD loci, GenBank and Newick files, sample lists and ledgers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import cigar_ops, sample_name

#: Unmapped, secondary and supplementary alignments.
NOT_PRIMARY = 0x4 | 0x100 | 0x800


def _fields(spark: SparkSession, path: str, comment: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != "")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, ref, pos (from 0), mapq, cigar, ops, seq of primary alignments."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(spark, path, "@").select(f(0).alias("name"), f(1).cast("int").alias("flag"), f(2).alias("ref"), (f(3).cast("int") - 1).alias("pos"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"), f(9).alias("seq"))
    return rows.where((F.col("flag").bitwiseAND(NOT_PRIMARY) == 0) & (F.col("cigar") != "*")).withColumn("ops", cigar_ops("cigar"))


def read_sam_references(spark: SparkSession, path: str) -> DataFrame:
    """ref, length from the header."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ\t"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info, genotypes (gt, dp, gq by sample; null where FORMAT lacks them)."""
    f = lambda i: F.get("f", F.lit(i))
    number = lambda x: F.when(x.rlike(r"^\d+$"), x.cast("int"))

    def genotype(sample, keys):
        part = lambda name: F.get(F.split(sample, ":"), (F.array_position(keys, name) - 1).cast("int"))
        has = lambda name: F.array_position(keys, name) > 0
        return F.struct(F.when(has("GT"), part("GT")).otherwise("./.").alias("gt"), F.when(has("DP"), number(part("DP"))).alias("dp"), F.when(has("GQ"), number(part("GQ"))).alias("gq"))

    samples = F.when(F.size("f") > 9, F.slice("f", F.lit(10), F.size("f") - 9)).otherwise(F.array().cast("array<string>"))
    rows = _fields(spark, path, "#").withColumns({"keys": F.split(F.coalesce(f(8), F.lit("")), ":"), "samples": samples})
    qual = F.when(f(5) != ".", f(5).cast("double"))
    return rows.select(f(0).alias("chrom"), f(1).cast("bigint").alias("pos"), f(2).alias("id"), f(3).alias("ref"), f(4).alias("alt"), qual.alias("qual"), f(6).alias("filter"), f(7).alias("info"), F.transform("samples", lambda s: genotype(s, F.col("keys"))).alias("genotypes"))


def site_summary(sites: DataFrame) -> DataFrame:
    """sites with call_rate, median_dp and median_gq of called genotypes."""
    from helixframe.operators.population import called

    good = F.filter("genotypes", lambda g: called(g["gt"]))
    middle = lambda name: F.expr(f"array_sort(filter(transform(__good, g -> g.{name}), x -> x IS NOT NULL))")
    found = sites.withColumn("__good", good).withColumns({"__dp": middle("dp"), "__gq": middle("gq")})
    median = lambda c: F.expr(f"CASE WHEN size({c}) > 0 THEN (get({c}, cast((size({c}) - 1) / 2 as int)) + get({c}, cast(size({c}) / 2 as int))) / 2 END")
    return found.withColumns({"call_rate": F.size("__good") / F.size("genotypes"), "median_dp": median("__dp"), "median_gq": median("__gq")}).drop("__good", "__dp", "__gq")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """segments (id, seq) and links (a, a_reverse, b, b_reverse, overlap); overlaps other than nM are an error."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(spark, path, "#")
    overlap = F.when(f(5).rlike(r"^\d+M$"), F.regexp_extract(f(5), r"^\d+", 0)).otherwise(F.raise_error(F.lit("a link's overlap must be nM")).cast("string")).cast("int")
    links = rows.where(f(0) == "L").select(f(1).alias("a"), (f(2) == "-").alias("a_reverse"), f(3).alias("b"), (f(4) == "-").alias("b_reverse"), overlap.alias("overlap"))
    return rows.where(f(0) == "S").select(f(1).alias("id"), f(2).alias("seq")), links


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, type, start (from 0), end, score, strand, phase and the attributes id, parent, identity, target."""
    f = lambda i: F.get("f", F.lit(i))
    attribute = lambda name: F.nullif(F.regexp_extract(f(8), rf"(?:^|;){name}=([^;]*)", 1), F.lit(""))
    return _fields(spark, path, "#").select(f(0).alias("chrom"), f(2).alias("type"), (f(3).cast("int") - 1).alias("start"), f(4).cast("int").alias("end"), F.when(f(5) != ".", f(5).cast("double")).alias("score"), f(6).alias("strand"), F.when(f(7) != ".", f(7).cast("int")).alias("phase"), attribute("ID").alias("id"), attribute("Parent").alias("parent"), attribute("Identity").cast("double").alias("identity"), attribute("Target").alias("target"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns of tabular BLAST, coordinates half-open from 0, strand - if one side runs backwards."""
    f = lambda i: F.get("f", F.lit(i))
    n = lambda i: f(i).cast("int")
    span = lambda a, b, name: ((F.least(n(a), n(b)) - 1).alias(f"{name}_start"), F.greatest(n(a), n(b)).alias(f"{name}_end"))
    strand = F.when((n(6) > n(7)) == (n(8) > n(9)), "+").otherwise("-").alias("strand")
    return _fields(spark, path, "#").select(f(0).alias("query"), f(1).alias("subject"), f(2).cast("double").alias("identity"), n(3).alias("columns"), n(4).alias("mismatches"), n(5).alias("gaps"), *span(6, 7, "query"), *span(8, 9, "subject"), strand, f(10).cast("double").alias("evalue"), f(11).cast("double").alias("score"))


def _whole(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(",")]
        for part in parts:
            yield pd.DataFrame([(*row,) for text, file in zip(part["value"], part["file"], strict=True) for row in parse(text, file)], columns=names)

    return files.mapInPandas(run, schema)


def parse_loci(text: str, file: str = "") -> Iterator[tuple]:
    """(locus, sample, r1, r2) of a .loci text: arms are split at the first NNN; r2 is empty without one."""
    rows: list[tuple[str, str]] = []
    for line in text.splitlines():
        if line.startswith("//"):
            m = re.search(r"\|([^|]*)\|", line)
            for sample, seq in rows:
                arms = re.split(r"N{3,}", seq, maxsplit=1)
                yield (m[1].strip() if m else "", sample, arms[0], arms[1] if len(arms) > 1 else "")
            rows = []
        elif line.strip():
            sample, seq = line.split(None, 1)
            rows.append((sample.lstrip(">"), seq.strip()))
    if rows:
        raise ValueError(f"{file}: the last locus has no // line")


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, parse_loci, "locus string, sample string, r1 string, r2 string")


def parse_genbank(text: str, file: str = "") -> Iterator[tuple]:
    """(record, type, gene, start, end, strand, segment) of gene, rRNA and tRNA features; segments from 0, half-open."""
    for entry in re.split(r"^//\s*$", text, flags=re.M):
        name = re.search(r"^LOCUS\s+(\S+)", entry, re.M)
        if not name:
            continue
        table = re.search(r"^FEATURES.*?\n(.*?)^(?:ORIGIN|CONTIG)", entry, re.M | re.S)
        for feature in re.split(r"^ {5}(?=\S)", table[1] if table else "", flags=re.M)[1:]:
            kind, rest = feature.split(None, 1)
            place = re.sub(r"\s", "", rest.split("/", 1)[0])
            gene = re.search(r'/(?:gene|product)="([^"]*)"', rest)
            if kind in ("gene", "rRNA", "tRNA"):
                strand = "-" if "complement" in place else "+"
                for i, m in enumerate(re.finditer(r"<?(\d+)\.\.>?(\d+)", place)):
                    yield name[1], kind, gene[1] if gene else "", int(m[1]) - 1, int(m[2]), strand, i


def parse_genbank_sequence(text: str, file: str = "") -> Iterator[tuple]:
    for entry in re.split(r"^//\s*$", text, flags=re.M):
        name, origin = re.search(r"^LOCUS\s+(\S+)", entry, re.M), re.search(r"^ORIGIN.*?\n(.*)", entry, re.M | re.S)
        if name and origin:
            yield name[1], re.sub(r"[^A-Za-z]", "", origin[1]).upper()


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """features and sequences (record, seq)."""
    features = _whole(spark, path, parse_genbank, "record string, type string, gene string, start int, end int, strand string, segment int")
    return features, _whole(spark, path, parse_genbank_sequence, "record string, seq string")


def parse_newick(text: str) -> list[tuple[int, int, str]]:
    """(node, parent, label) with -1 as the root's parent; branch lengths are read over, quoted labels kept."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),;]|:[^(),;]*|[^(),:;'\s]+", text)
    nodes: list[list] = [[-1, ""]]
    at = 0
    for token in tokens:
        if token == "(":
            nodes.append([at, ""])
            at = len(nodes) - 1
        elif token == ",":
            if nodes[at][0] < 0:
                raise ValueError("a comma outside any clade")
            nodes.append([nodes[at][0], ""])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][0]
            if at < 0:
                raise ValueError("a clade is closed that wasn't open")
        elif token == ";":
            break
        elif not token.startswith(":"):
            nodes[at][1] = token[1:-1].replace("''", "'") if token.startswith("'") else token
    if at != 0:
        raise ValueError("a clade isn't closed")
    return [(i, parent, label) for i, (parent, label) in enumerate(nodes)]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """file, tree, node, parent, label; one tree to a line or to a semicolon."""

    def parse(text: str, file: str) -> Iterator[tuple]:
        for i, tree in enumerate(x for x in re.findall(r"(?:'[^']*'|[^;'])+;", text) if x.strip()):
            for row in parse_newick(tree.strip()):
                yield file, i, *row

    return _whole(spark, path, parse, "file string, tree int, node int, parent int, label string")


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table with a header, its columns taken by name in any order."""
    wanted = [x.split()[0] for x in schema.split(",")]
    raw = spark.read.csv(path, sep=sep, header=True)
    missing = set(wanted) - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return raw.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(",")])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, r1, r2 of a sample list of two or three columns; a sample with one file has it twice.  Names are
    normalised and must then differ."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(spark, path, "#").withColumn("ord", F.monotonically_increasing_id())
    found = rows.select("ord", sample_name(f(0)).alias("name"), f(1).alias("r1"), F.coalesce(F.nullif(f(2), F.lit("")), f(1)).alias("r2"))
    same = [r[0] for r in found.groupBy("name").count().where("count > 1").select("name").limit(5).collect()]
    if same:
        raise ValueError(f"samples of one name: {same}")
    return found


def without_ledger(reads: DataFrame, id_: str, ledger: DataFrame) -> DataFrame:
    """reads whose id the deny-list lacks."""
    return reads.join(ledger.select(F.col(ledger.columns[0]).alias(id_)), id_, "left_anti")
