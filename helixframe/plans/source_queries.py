"""Queries that write sample tables as files of a format and read them back, so that their SQL is that of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import dna_of_text
from helixframe.operators.tables import shared_folder
from helixframe.plans.fixtures import PAIRS, dna, load, pairs
from helixframe.sources import fastx, formats, sinks


def _file(lines: DataFrame) -> str:
    """lines as text files in the shared folder; records of several lines stay whole."""
    path = f"{shared_folder(lines.sparkSession)}/files/{uuid.uuid4().hex}"
    sinks.write_lines(lines, path)
    return path


def _reads(spark, sf_dir):
    """Reads of parts' names; every seventh has no bases."""
    seq = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(dna_of_text("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("/1 x=1")).alias("header"), seq.alias("seq")).withColumn("qual", F.translate("seq", "ACGT", "@+I5"))


SQL_READS = f"""r AS (SELECT p_partkey, 'part' || p_partkey || '/1 x=1' AS header, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE {dna('p_name')} END AS seq FROM part)"""


def fastq_round_trip(spark, sf_dir):
    path = _file(sinks.fastq_lines(_reads(spark, sf_dir), "header", "seq", "qual", ["p_partkey"]))
    return fastx.read_fastq(spark, path).select("header", "seq", "qual")


FASTQ = f"WITH {SQL_READS} SELECT header, seq, translate(seq, 'ACGT', '@+I5') AS qual FROM r"


def fasta_round_trip(spark, sf_dir):
    """Texts of documents as records of many lines."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), dna_of_text("text").alias("seq"))
    path = _file(sinks.fasta_lines(docs.where("seq <> ''"), "name", "seq", ["doc_id"], 60))
    return fastx.read_fasta(spark, path).select("name", "seq")


FASTA = f"SELECT 'doc ' || doc_id AS name, {dna('text')} AS seq FROM documents WHERE {dna('text')} <> ''"


#: Files of each side of pairs.
FILES = 4


def _mates(spark, sf_dir):
    """conv_id, pair, mate, header, seq, qual: turns 2i and 2i + 1 of a conversation as mates, dealt over FILES files."""
    both = pairs(spark, sf_dir).where("r1 <> '' AND r2 <> ''")
    each = both.select("frag", F.posexplode(F.array("r1", "r2")).alias("mate", "seq"))
    name = F.concat(F.lit("c"), F.col("frag").cast("string"), F.lit("/"), (F.col("mate") + 1).cast("string"))
    return each.select("frag", "mate", name.alias("header"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual")).repartition(FILES, "frag").sortWithinPartitions("frag", "mate")


def paired_round_trip(spark, sf_dir):
    """Both sides in several files each, whose reads correspond by file and place."""
    mates = _mates(spark, sf_dir)
    first, second = (_file(sinks.fastq_lines(mates.where(F.col("mate") == m), "header", "seq", "qual")) for m in (0, 1))
    return fastx.read_pairs(spark, first, second).select("frag_id", F.col("r1.seq").alias("r1"), F.col("r2.seq").alias("r2"))


def interleaved_round_trip(spark, sf_dir):
    path = _file(sinks.fastq_lines(_mates(spark, sf_dir), "header", "seq", "qual"))
    return fastx.read_interleaved(spark, path).select("frag_id", F.col("r1.seq").alias("r1"), F.col("r2.seq").alias("r2"))


PAIRED = f"WITH {PAIRS} SELECT 'c' || frag AS frag_id, r1, r2 FROM pairs WHERE r1 <> '' AND r2 <> ''"


def _tabbed(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in columns]).alias("value"))


def sam_scan(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_linestatus") == "F", 16).when(F.col("l_partkey") % 3 == 0, 4).when(F.col("l_partkey") % 3 == 1, 256).otherwise(2064)
    n = F.col("l_quantity").cast("int").cast("string")
    lines = _tabbed(l, F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), flag.cast("string"), F.concat(F.lit("ref"), (F.col("l_suppkey") % 10).cast("string")), (F.col("l_partkey") + 1).cast("string"), F.lit("60"), F.concat(n, F.lit("M2I"), n, F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), 3), F.lit("*"))
    head = spark.createDataFrame([(f"@SQ\tSN:ref{i}\tLN:5000",) for i in range(10)], "value string")
    rows = formats.read_sam(spark, _file(head.unionByName(lines)))
    return rows.groupBy("ref", "flag").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum(F.aggregate(F.filter("ops", lambda o: o["op"] == "M"), F.lit(0), lambda a, o: a + o["length"])).alias("matched"))


SAM = """WITH r AS (SELECT 'ref' || l_suppkey % 10 AS ref, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'F' THEN 16 ELSE -1 END AS flag, l_partkey AS pos, l_quantity::INT AS q FROM lineitem)
SELECT ref, flag, count(*) AS n, sum(pos)::BIGINT AS pos, sum(2 * q)::BIGINT AS matched FROM r WHERE flag >= 0 GROUP BY ALL"""


def vcf_scan(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    gt = F.when(F.col("o_orderstatus") == "F", "0/1:12:30").when(F.col("o_orderstatus") == "O", "1|1:7:.").otherwise("./.:.:.")
    qual = F.when(F.col("o_orderkey") % 4 == 0, ".").otherwise((F.col("o_orderkey") % 100).cast("string"))
    lines = _tabbed(o, F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")), F.col("o_orderkey").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), qual, F.lit("PASS"), F.lit("DP=3"), F.lit("GT:DP:GQ"), gt, F.lit("0/0:5:20"))
    rows = formats.read_vcf(spark, _file(spark.createDataFrame([("##fileformat=VCFv4.2",)], "value string").unionByName(lines)))
    found = formats.site_summary(rows)
    return found.select("chrom", "pos", "qual", F.size("genotypes").cast("bigint").alias("samples"), "call_rate", F.col("median_dp").cast("double").alias("median_dp"), F.col("median_gq").cast("double").alias("median_gq"))


VCF = """SELECT 'chr' || o_custkey % 5 AS chrom, o_orderkey AS pos, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 100)::DOUBLE END AS qual, 2::BIGINT AS samples, CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0.5 END::DOUBLE AS call_rate,
CASE o_orderstatus WHEN 'F' THEN 8.5 WHEN 'O' THEN 6 ELSE 5 END::DOUBLE AS median_dp, CASE o_orderstatus WHEN 'F' THEN 25 ELSE 20 END::DOUBLE AS median_gq FROM orders"""


def gfa_round_trip(spark, sf_dir):
    """Parts as segments, each linked to the next; the links that come back, with both segments' lengths."""
    p = load(spark, sf_dir, "part")
    segments = p.select(F.col("p_partkey").alias("id"), dna_of_text("p_name").alias("seq"))
    links = p.where("p_partkey > 0").select((F.col("p_partkey") - 1).alias("a"), (F.col("p_size") % 2 == 1).alias("a_reverse"), F.col("p_partkey").alias("b"), (F.col("p_size") % 3 == 0).alias("b_reverse"), (F.col("p_size") + 5).cast("int").alias("overlap"))
    back, joined = formats.read_gfa(spark, _file(sinks.gfa_lines(segments, links)))
    side = lambda name: back.select(F.col("id").alias(name), F.length("seq").alias(f"{name}_length"))
    return joined.join(side("a"), "a").join(side("b"), "b").select(F.col("a").cast("bigint").alias("a"), "a_reverse", F.col("b").cast("bigint").alias("b"), "b_reverse", "overlap", "a_length", "b_length")


GFA = f"""SELECT y.p_partkey - 1 AS a, y.p_size % 2 = 1 AS a_reverse, y.p_partkey AS b, y.p_size % 3 = 0 AS b_reverse, (y.p_size + 5)::INT AS overlap, length({dna('x.p_name')})::INT AS a_length, length({dna('y.p_name')})::INT AS b_length
FROM part y JOIN part x ON x.p_partkey = y.p_partkey - 1"""


def gff_scan(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    text = lambda c: c.cast("string")
    lines = _tabbed(p, F.concat(F.lit("chr"), text(F.col("p_size"))), F.lit("made"), F.lit("gene"), text(F.col("p_partkey") + 1), text(F.col("p_partkey") + 10), F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("7.5"), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+"), F.lit("."), F.concat(F.lit("ID=g"), text(F.col("p_partkey")), F.when(F.col("p_partkey") % 5 == 0, ";Parent=top").otherwise("")))
    return formats.read_gff(spark, _file(spark.createDataFrame([("##gff-version 3",)], "value string").unionByName(lines))).select("chrom", "type", "start", "end", "score", "strand", "id", "parent")


GFF = """SELECT 'chr' || p_size AS chrom, 'gene' AS type, p_partkey::INT AS start, (p_partkey + 10)::INT AS "end", CASE WHEN p_partkey % 2 = 1 THEN 7.5 END::DOUBLE AS score, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
'g' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'top' END AS parent FROM part"""


def blast_scan(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    t = lambda c: c.cast("string")
    low, high = F.col("l_partkey") + 1, F.col("l_partkey") + F.col("l_linenumber") * 10
    back = F.col("l_returnflag") == "R"
    lines = _tabbed(l, t(F.col("l_orderkey")), F.concat(F.lit("s"), t(F.col("l_suppkey"))), F.lit("97.5"), F.lit("100"), F.lit("2"), F.lit("1"), F.lit("1"), t(F.col("l_linenumber") * 10), t(F.when(back, high).otherwise(low)), t(F.when(back, low).otherwise(high)), F.lit("1e-20"), F.lit("180"))
    rows = formats.read_blast(spark, _file(lines))
    return rows.groupBy("subject", "strand").agg(F.count(F.lit(1)).alias("n"), F.min("subject_start").alias("start"), F.max("subject_end").alias("end"), F.sum(F.col("query_end") - F.col("query_start")).alias("span"))


BLAST = """SELECT 's' || l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, count(*) AS n, min(l_partkey)::INT AS start, max(l_partkey + l_linenumber * 10)::INT AS "end", sum(l_linenumber * 10)::BIGINT AS span FROM lineitem GROUP BY ALL"""


def sample_list(spark, sf_dir):
    """Suppliers as samples of one or two files."""
    s = load(spark, sf_dir, "supplier")
    number = F.col("s_suppkey").cast("string")
    lines = _tabbed(s, F.concat(F.lit("site "), number, F.lit("-a")), F.concat(number, F.lit("_1.fq")), F.when(F.col("s_suppkey") % 3 > 0, F.concat(number, F.lit("_2.fq"))).otherwise(""))
    return formats.read_samples(spark, _file(lines)).select("name", "r1", "r2")


SAMPLES = "SELECT 'Site_' || s_suppkey || '_a' AS name, s_suppkey || '_1.fq' AS r1, s_suppkey || CASE WHEN s_suppkey % 3 > 0 THEN '_2.fq' ELSE '_1.fq' END AS r2 FROM supplier"


def table_round_trip(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    path = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    sinks.write_table(rows, path)
    return formats.read_table(spark, path, "s_nationkey int, s_suppkey bigint, s_name string")


TABLE = "SELECT s_nationkey::INT AS s_nationkey, s_suppkey, s_name FROM supplier"


def newick_trees(spark, sf_dir):
    """A tree for each nation, its suppliers the leaves under one clade."""
    names = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(":1.5")))), ",")
    trees = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(names.alias("t")).select(F.concat(F.lit("(("), F.col("t"), F.lit(")n"), F.col("s_nationkey").cast("string"), F.lit(",out);")).alias("value"))
    nodes = formats.read_newick(spark, _file(trees))
    child = nodes.where("label LIKE 's%'").select("file", "tree", F.col("parent").alias("node"), F.col("label").alias("leaf"))
    return nodes.where("label LIKE 'n%'").join(child, ["file", "tree", "node"]).select("label", "leaf")


NEWICK = "SELECT 'n' || s_nationkey AS label, 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS leaf FROM supplier"


QUERIES = {
    "fastq_round_trip": (fastq_round_trip, FASTQ),
    "fasta_round_trip": (fasta_round_trip, FASTA),
    "paired_round_trip": (paired_round_trip, PAIRED),
    "interleaved_round_trip": (interleaved_round_trip, PAIRED),
    "sam_scan": (sam_scan, SAM),
    "vcf_scan": (vcf_scan, VCF),
    "gfa_round_trip": (gfa_round_trip, GFA),
    "gff_scan": (gff_scan, GFF),
    "blast_scan": (blast_scan, BLAST),
    "sample_list": (sample_list, SAMPLES),
    "table_round_trip": (table_round_trip, TABLE),
    "newick_trees": (newick_trees, NEWICK),
}
