import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.sources import fastx, formats, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True)
    (gzip.open(path, "wt") if name.endswith(".gz") else path.open("w")).write(text)
    if name.endswith(".gz"):
        with gzip.open(path, "wt") as file:
            file.write(text)
    else:
        path.write_text(text)
    return str(path)


FASTQ = "@r1/1 x\nACGT\n+\nIIII\n\n@r2/1\r\nGGTT\r\n+\r\n####\r\n"


@pytest.mark.parametrize("name", ["a.fastq", "a.fastq.gz"])
def test_fastq(spark, tmp_path, name):
    rows = fastx.read_fastq(spark, put(tmp_path, name, FASTQ)).orderBy("ord").collect()
    assert [(r["ord"], r["header"], r["seq"], r["qual"]) for r in rows] == [(0, "r1/1 x", "ACGT", "IIII"), (1, "r2/1", "GGTT", "####")]


@pytest.mark.parametrize("text", ["r1\nACGT\n+\nIIII\n", "@r1\nACGT\n-\nIIII\n", "@r1\nACGT\n+\nIII\n", "@r1\nACGT\n+\n"])
def test_malformed_fastq_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception, match="malformed FASTQ"):
        fastx.read_fastq(spark, put(tmp_path, "a.fastq", text)).collect()


def test_fastq_over_many_splits(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'IIII' * (i % 5 + 1)}\n" for i in range(500))
    path = put(tmp_path, "a.fastq", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = fastx.read_fastq(spark, path).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["header"] for r in rows] == [f"r{i}" for i in range(500)]


def test_fasta_references(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    put(tmp_path / "refs", "u1.fasta", ">a one\nACGT\nAC GT\n>b\nTTTT\n")
    put(tmp_path / "refs", "u2.fa", ">c\nGG\n")
    rows = fastx.read_references(spark, str(tmp_path / "refs")).orderBy("locus", "ref_ord").collect()
    assert [(r["locus"], r["ref_ord"], r["name"], r["seq"]) for r in rows] == [("u1", 0, "a one", "ACGTACGT"), ("u1", 1, "b", "TTTT"), ("u2", 0, "c", "GG")]
    put(tmp_path / "refs", "u1.fas", ">c\nGG\n")
    with pytest.raises(ValueError, match="one stem"):
        fastx.read_references(spark, str(tmp_path / "refs"))
    with pytest.raises(Exception, match="before any FASTA title"):
        fastx.read_fasta(spark, put(tmp_path, "b.fasta", "ACGT\n>a\nAC\n")).collect()


def test_pairs(spark, tmp_path):
    r1, r2 = put(tmp_path, "1.fq", "@x/1\nAC\n+\nII\n@y/1\nGG\n+\nII\n"), put(tmp_path, "2.fq", "@x/2\nTT\n+\nII\n@y/2\nCC\n+\nII\n")
    rows = fastx.read_pairs(spark, r1, r2).orderBy("frag_ord").collect()
    assert [(r["frag_id"], r["r1"]["seq"], r["r2"]["seq"]) for r in rows] == [("x", "AC", "TT"), ("y", "GG", "CC")]
    for i, (a, b) in enumerate((("AA", "CC"), ("GG", "TT"))):
        put(tmp_path / "first", f"l {i}.fq", "".join(f"@{n}{i}/1\n{s}\n+\nII\n" for n, s in (("p", a), ("q", b))))
        put(tmp_path / "second", f"r {i}.fq", "".join(f"@{n}{i}/2\n{s}\n+\nII\n" for n, s in (("p", b), ("q", a))))
        put(tmp_path / "turns", f"{i}.fq", f"@p{i}/1\n{a}\n+\nII\n@p{i}/2\n{b}\n+\nII\n@q{i}/1\n{b}\n+\nII\n@q{i}/2\n{a}\n+\nII\n")
    want = [("p0", "AA", "CC"), ("p1", "GG", "TT"), ("q0", "CC", "AA"), ("q1", "TT", "GG")]
    plain = lambda df: sorted((r["frag_id"], r["r1"]["seq"], r["r2"]["seq"]) for r in df.collect())
    assert plain(fastx.read_pairs(spark, str(tmp_path / "first"), str(tmp_path / "second"))) == want
    assert plain(fastx.read_interleaved(spark, str(tmp_path / "turns"))) == want
    with pytest.raises(ValueError, match="files of first mates"):
        fastx.read_pairs(spark, str(tmp_path / "first"), r2)
    both = put(tmp_path, "i.fq", "@x/1\nAC\n+\nII\n@x/2\nTT\n+\nII\n")
    assert fastx.read_interleaved(spark, both).first()["r2"]["seq"] == "TT"
    with pytest.raises(Exception, match="mates don't match"):
        fastx.read_pairs(spark, r1, put(tmp_path, "3.fq", "@x/2\nTT\n+\nII\n")).collect()
    assert fastx.kind_of("a.FA.gz") == "fasta" and fastx.kind_of("x.gz") == "fastq"
    with pytest.raises(ValueError):
        fastx.kind_of("x.txt")


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@SQ\tSN:u1\tLN:100\nr1\t0\tu1\t1\t60\t2M1I2M\t*\t0\t0\tACTGT\tIIIII\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\nr3\t256\tu1\t1\t60\t2M\t*\t0\t0\tAC\tII\n")
    rows = formats.read_sam(spark, path).collect()
    assert [(r["name"], r["pos"], [tuple(o) for o in r["ops"]]) for r in rows] == [("r1", 0, [(2, "M"), (1, "I"), (2, "M")])]
    assert tuple(formats.read_sam_references(spark, path).first()) == ("u1", 100)


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##x\n#CHROM\n" + "\t".join("u1 10 . A G 30 PASS . GT:DP:GQ 0/1:10:40 ./.:.:. 1/1:8:30".split()) + "\n")
    row = formats.site_summary(formats.read_vcf(spark, path)).first()
    assert (row["chrom"], row["pos"], row["qual"], round(row["call_rate"], 6), row["median_dp"], row["median_gq"]) == ("u1", 10, 30.0, round(2 / 3, 6), 9.0, 35.0)


def test_blast_gfa_gff(spark, tmp_path):
    row = formats.read_blast(spark, put(tmp_path, "b.txt", "q\ts\t100\t4\t0\t0\t8\t5\t1\t4\t0\t100\n")).first()
    assert (row["query_start"], row["query_end"], row["subject_start"], row["subject_end"], row["strand"]) == (4, 8, 0, 4, "-")
    segments, links = formats.read_gfa(spark, put(tmp_path, "g.gfa", "H\tVN\nS\t1\tACGT\nS\t2\tGTAA\nL\t1\t+\t2\t-\t2M\n"))
    assert segments.count() == 2 and tuple(links.first()) == ("1", False, "2", True, 2)
    lines = [r[0] for r in sinks.gfa_lines(segments, links).collect()]
    assert lines[0].startswith("H") and lines[-1] == "L\t1\t+\t2\t-\t2M"
    row = formats.read_gff(spark, put(tmp_path, "x.gff", "#\nc1\tm\tmRNA\t11\t20\t5\t+\t.\tID=a;Identity=0.9;Target=t 1 3\n")).first()
    assert (row["start"], row["end"], row["id"], row["identity"], row["parent"]) == (10, 20, "a", 0.9, None)


def test_loci_genbank_newick(spark, tmp_path):
    rows = formats.read_loci(spark, put(tmp_path, "a.loci", "s1   ACGTNNNNTTTT\ns2   ACGT\n//   *   |7|\n")).orderBy("sample").collect()
    assert [tuple(r) for r in rows] == [("7", "s1", "ACGT", "TTTT"), ("7", "s2", "ACGT", "")]
    text = 'LOCUS       AB1 20 bp\nFEATURES             Location/Qualifiers\n     gene            complement(join(1..3,\n                     7..9))\n                     /gene="cox1"\nORIGIN\n        1 acgtacgtac gtacgtacgt\n//\n'
    features, sequences = formats.read_genbank(spark, put(tmp_path, "a.gb", text))
    assert [tuple(r)[1:] for r in features.orderBy("segment").collect()] == [("gene", "cox1", 0, 3, "-", 0), ("gene", "cox1", 6, 9, "-", 1)]
    assert sequences.first()["seq"] == "ACGTACGTACGTACGTACGT"
    assert [x[2] for x in formats.parse_newick("('a b':0.1,B)95:1;")] == ["95", "a b", "B"]
    assert formats.read_newick(spark, put(tmp_path, "t.nwk", "(A,(B,C)x);\n")).count() == 5
    for bad in ("(A,B;", "A,B);", "(A))B;"):
        with pytest.raises(ValueError):
            formats.parse_newick(bad)


def test_tables_and_samples(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "selected\tlocus\n0\tu1\n5\tu2\n")
    assert [tuple(r) for r in formats.read_table(spark, path, "locus string, selected int").where("selected = 0").collect()] == [("u1", 0)]
    with pytest.raises(ValueError, match="lacks"):
        formats.read_table(spark, path, "other int")
    rows = formats.read_samples(spark, put(tmp_path, "s.tsv", "a\tx.fq\ty.fq\nb b\tz.fq\n")).orderBy("ord").collect()
    assert [(r["name"], r["r1"], r["r2"]) for r in rows] == [("A", "x.fq", "y.fq"), ("B_b", "z.fq", "z.fq")]
    with pytest.raises(ValueError, match="one name"):
        formats.read_samples(spark, put(tmp_path, "d.tsv", "a\tx\nA\ty\n"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 100), ("b", "C" * 80)], "name string, seq string")
    sinks.write_lines(sinks.fasta_lines(df, "name", "seq", ["name"]), str(tmp_path / "out"))
    back = fastx.read_fasta(spark, str(tmp_path / "out"))
    assert sinks.same_rows(back.select("name", "seq"), df)
    sinks.write_by_locus(df, str(tmp_path / "parts"), "name")
    assert sinks.same_rows(spark.read.parquet(str(tmp_path / "parts")).select(F.col("name").cast("string"), "seq"), df)


def test_fastq_reads_without_bases_and_gaps_between_records(spark, tmp_path):
    text = "\n\n@a\n\n+\n\n\n@b\nAC\n+\n@+\n@c\n\n+\n\n@d\nG\n+b\n+\n\n"
    rows = fastx.read_fastq(spark, put(tmp_path, "gaps.fastq", text)).orderBy("ord").collect()
    assert [(r["header"], r["seq"], r["qual"]) for r in rows] == [("a", "", ""), ("b", "AC", "@+"), ("c", "", ""), ("d", "G", "+")]
