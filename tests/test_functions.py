from pyspark.sql import functions as F

from helixframe.functions import sequences as Q


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_complements(spark):
    assert one(spark, "AACGN", Q.reverse_complement) == "NCGTT"
    assert one(spark, "AACGNR", lambda c: Q.reverse_complement(c, "N")) == "NNCGTT"
    assert one(spark, "ARYSWKMBDHVN", Q.reverse_complement_iupac) == "NBDHVKMWSRYT"
    assert one(spark, "TTTT", Q.canonical) == "AAAA"


def test_windows_and_sketches(spark):
    assert one(spark, "ACGTA", lambda c: Q.kmers(c, 3)) == ["ACG", "CGT", "GTA"]
    assert one(spark, "AC", lambda c: Q.kmers(c, 3)) == []
    found = one(spark, "ACGTACG", lambda c: Q.terminal_windows(c, 3, 3))
    assert [w["pos"] for w in found] == [0, 3, 4]
    assert one(spark, "ACGTTGCA", lambda c: Q.minimizers(c, 3, 10)) == ["AAC"]
    assert one(spark, "ACGTTGCA", lambda c: Q.bottom_sketch(c, 3, 2)) == ["AAC", "ACG"]


def test_translation_and_motifs(spark):
    assert one(spark, "ATGGCCTAANNNAT", Q.translate_codons) == "MA*X"
    assert one(spark, "", Q.translate_codons) == ""
    assert one(spark, "GTAC", Q.canonical_motif) == min(s[i:] + s[:i] for s in ("GTAC",) for i in range(4))
    assert one(spark, "TTA", Q.canonical_motif) == "AAT"
    assert one(spark, "ACACACACAC", Q.period) == 2 and one(spark, "A", Q.period) == 0


def test_entropy(spark):
    assert one(spark, "AAAAAA", Q.dinucleotide_entropy) == 0
    assert abs(one(spark, "ACACACACA", Q.dinucleotide_entropy) - 1.0) < 1e-9
    assert one(spark, "N", Q.dinucleotide_entropy) == 0


def test_names(spark):
    assert one(spark, "@read_1/1 extra", Q.pair_id) == "read_1"
    assert one(spark, "@read_1/1/2 extra", Q.pair_id_repeated) == "read_1"
    assert one(spark, "my sample-1 (a)", Q.sample_name) == "My_sample_1_a"
    assert one(spark, "/a/b/locus7.fasta.gz", Q.locus_name) == "locus7"
    assert one(spark, "a b:c", Q.vcf_name) == "a_b_c"


def test_cigar(spark):
    assert [tuple(x) for x in one(spark, "2M1I2M", Q.cigar_ops)] == [(2, "M"), (1, "I"), (2, "M")]
    assert one(spark, "*", Q.cigar_ops) == [] and one(spark, "2Q", Q.cigar_ops) == []


def test_quartiles(spark):
    row = lambda v: tuple(one(spark, [float(x) for x in v], Q.tukey_hinges, "array<double>"))
    assert row([1.0, 2, 3, 4, 5]) == (1.5, 3.0, 4.5) and row([1.0, 2, 3, 4]) == (1.5, 2.5, 3.5) and row([7.0]) == (7.0, 7.0, 7.0)
    assert one(spark, [], Q.tukey_hinges, "array<double>") is None
    assert one(spark, [4, 1, 3, 2], Q.upper_median, "array<int>") == 3


def test_other(spark):
    assert one(spark, "ACGT", lambda c: Q.masked_by_quality(c, F.lit("I#I!"))) == "ANGN"
    assert one(spark, "ACGTT", lambda c: Q.circular_slice(c, F.lit(3), F.lit(4))) == "TTAC"
    assert [t["start"] for t in one(spark, "A" * 10, lambda c: Q.tiles(c, 4, 4))] == [0, 4, 6]
    assert one(spark, ["T", "C", "C"], Q.iupac_of, "array<string>") == "Y"
    assert one(spark, ["A", "B"], lambda c: Q.jaccard(c, F.array(F.lit("B"))), "array<string>") == 0.5
