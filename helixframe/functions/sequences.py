"""Sequence functions as Spark columns (JVM side), for short texts such as reads, k-mers and motifs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases with their complements, IUPAC included.
PLAIN, PLAIN_COMPLEMENT = "ACGTacgt", "TGCAtgca"
IUPAC, IUPAC_COMPLEMENT = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
#: The standard genetic code, by first, second and third base in the order T, C, A, G.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
#: IUPAC codes of sets of bases, the bases in order.
IUPAC_OF = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def dna_of_text(c: str | Column) -> Column:
    """Stand-in sequences: letters of a text mapped to bases, the rest dropped."""
    return F.translate(F.lower(F.regexp_replace(col(c), "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def u_to_t(c: str | Column) -> Column:
    return F.translate(F.upper(col(c)), "U", "T")


def only_bases(c: str | Column) -> Column:
    """Upper case, U as T, everything but ACGT dropped."""
    return F.regexp_replace(u_to_t(c), "[^ACGT]", "")


def is_plain(c: str | Column) -> Column:
    """Whether a sequence has no ambiguous base."""
    return col(c).rlike("^[ACGTUacgtu]+$")


def reverse_complement(c: str | Column, unknown: str | None = None) -> Column:
    """Bases beyond ACGT stay, or become `unknown`."""
    found = F.reverse(F.translate(col(c), PLAIN, PLAIN_COMPLEMENT))
    return found if unknown is None else F.regexp_replace(found, "[^ACGTacgt]", unknown)


def reverse_complement_iupac(c: str | Column) -> Column:
    return F.reverse(F.translate(col(c), IUPAC, IUPAC_COMPLEMENT))


def canonical(c: str | Column) -> Column:
    """The lesser of a sequence and its reverse complement; equals the lesser 2-bit value at equal lengths."""
    return F.least(col(c), reverse_complement(c))


def kmers(c: str | Column, k: int) -> Column:
    """All k-wide windows of a sequence, as an array in order."""
    c = col(c)
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(none)


def terminal_windows(c: str | Column, k: int, step: int) -> Column:
    """(pos, kmer) at the positions that step divides, and at the last one whatever it is."""
    found = F.transform(kmers(c, k), lambda x, i: F.struct(i.alias("pos"), x.alias("kmer")))
    return F.filter(found, lambda w: (w["pos"] % step == 0) | (w["pos"] == F.length(col(c)) - k))


def minimizers(c: str | Column, k: int, w: int) -> Column:
    """Distinct sorted minima of w consecutive canonical k-mers; of all of them if there are fewer."""

    def sketch(found: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(found) - (w - 1), F.lit(1)))
        return F.sort_array(F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(found, i, F.lit(w))))))

    none = F.array().cast("array<string>")
    return F.when(F.length(col(c)) >= k, let(F.transform(kmers(c, k), canonical), sketch)).otherwise(none)


def bottom_sketch(c: str | Column, k: int, size: int = 16) -> Column:
    """The `size` least distinct canonical k-mers."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(kmers(c, k), canonical))), 1, size)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def translate_codons(c: str | Column) -> Column:
    """Amino acids of whole codons from the first base on; X for codons beyond the standard code."""
    code = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    c = u_to_t(c)
    n = F.floor(F.length(c) / 3).cast("int")
    found = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(code, F.substring(c, i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(n > 0, F.array_join(found, "")).otherwise(F.lit(""))


def back_translate(aligned: str | Column, cds: str | Column) -> Column:
    """Codons of cds in the columns of its aligned amino acids, --- for each gap; null where cds has too few codons."""
    cds = col(cds)
    runs = F.regexp_extract_all(col(aligned), F.lit("(-+|[^-]+)"), 1)
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("codons"))

    def longer(state: Column, run: Column) -> Column:
        n, gap = F.length(run), run.startswith("-")
        codons = F.when(gap, F.repeat(F.lit("---"), n)).otherwise(F.substring(cds, state["used"] * 3 + 1, n * 3))
        return F.struct((state["used"] + F.when(gap, 0).otherwise(n)).alias("used"), F.concat(state["codons"], codons).alias("codons"))

    found = F.aggregate(runs, start, longer)
    return F.when(found["used"] * 3 <= F.length(cds), found["codons"])


def dinucleotide_entropy(c: str | Column) -> Column:
    """Shannon entropy in bits of the two-base windows without ambiguous bases; 0 without any."""
    pairs = F.filter(kmers(F.upper(col(c)), 2), lambda x: x.rlike("^[ACGT]{2}$"))
    all_ = F.array(*[F.lit(a + b) for a in "ACGT" for b in "ACGT"])

    def entropy(found: Column) -> Column:
        share = F.transform(all_, lambda x: F.size(F.filter(found, lambda y: y == x)) / F.size(found))
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))

    return let(pairs, lambda found: F.when(F.size(found) > 0, entropy(found)).otherwise(F.lit(0.0)))


def rotations(c: str | Column) -> Column:
    c = col(c)
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, i, F.length(c)), F.substring(c, F.lit(1), i - 1)))


def canonical_motif(c: str | Column) -> Column:
    """The least rotation of a motif or of its reverse complement."""
    return F.when(F.length(col(c)) > 0, F.array_min(F.concat(rotations(c), rotations(reverse_complement(c))))).otherwise(F.lit(""))


def canonical_circle(c: str | Column) -> Column:
    """The same for circular sequences, compared as texts."""
    return canonical_motif(c)


def period(c: str | Column, share: float = 0.85) -> Column:
    """The least p up to half the length with `share` of the positions equal to those p bases cycle through; 0 if none."""
    c = col(c)

    def matches(p: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.substring(c, i + 1, F.lit(1)) == F.substring(c, i % p + 1, F.lit(1))))

    found = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(F.length(c) / 2).cast("int"), F.lit(1))), lambda p: matches(p) >= share * F.length(c))
    return F.when(F.length(c) >= 2, F.coalesce(F.get(found, F.lit(0)), F.lit(0))).otherwise(F.lit(0))


def circular_slice(c: str | Column, start: Column, length: Column) -> Column:
    """`length` bases (at most one round) from `start` (from 0) on, past the end to the beginning."""
    return F.substring(F.concat(col(c), col(c)), (start % F.length(col(c)) + 1).cast("int"), F.least(length, F.length(col(c))).cast("int"))


def tiles(c: str | Column, size: int, step: int) -> Column:
    """(start, tile) at each step, the last one flush with the end."""
    c = col(c)
    last = F.greatest(F.length(c) - size, F.lit(0))
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(step)), last))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(c, s + 1, F.lit(size)).alias("tile")))


def iupac_of(bases: str | Column) -> Column:
    """The code of an array of bases; N for sets that have none."""
    code = F.create_map(*[F.lit(x) for pair in IUPAC_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(code, F.array_join(F.sort_array(F.array_distinct(col(bases))), "")), F.lit("N"))


def masked_by_quality(seq: str | Column, qual: str | Column, least: int = 20) -> Column:
    """Bases of a Phred quality (offset 33) under `least` become N."""
    seq, qual = col(seq), col(qual)
    found = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.when(F.ascii(F.substring(qual, i, F.lit(1))) - 33 < least, F.lit("N")).otherwise(F.substring(seq, i, F.lit(1))))
    return F.when(F.length(seq) > 0, F.array_join(found, "")).otherwise(seq)


def pair_id(header: str | Column) -> Column:
    """A read's name without @, without what follows white space, without one /1 or /2 at its end."""
    return F.regexp_replace(F.regexp_extract(col(header), r"^@?(\S*)", 1), "/[12]$", "")


def pair_id_repeated(header: str | Column) -> Column:
    """The same with all such ends trimmed."""
    return F.regexp_replace(F.regexp_extract(col(header), r"^[@>]?(\S*)", 1), "(?:/[12])+$", "")


def cigar_ops(c: str | Column) -> Column:
    """(length, op) of each operation of a CIGAR text; empty for * and for malformed ones."""
    c = col(c)
    found = F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    good = c.rlike(r"^(\d+[MIDNSHP=X])+$")
    return F.when(good, F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("length"), F.right(x, F.lit(1)).alias("op")))).otherwise(F.array().cast("array<struct<length:int,op:string>>"))


def sample_name(c: str | Column) -> Column:
    """Punctuation dropped, blanks and hyphens as _, first letter upper case."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[\s-]+", "_"), r"[^\p{L}\p{N}_]", "")
    return F.concat(F.upper(F.substring(kept, 1, 1)), F.substring(kept, F.lit(2), F.length(kept)))


def locus_name(c: str | Column) -> Column:
    """A file's stem: no folder, no FASTA ending, no .gz."""
    return F.regexp_replace(F.regexp_extract(col(c), r"([^/\\]*)$", 1), r"(?i)\.(?:fa|fas|fasta|fna|ffn)?(?:\.gz)?$", "")


def vcf_name(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9_.-]", "_")


def tukey_hinges(values: str | Column) -> Column:
    """(q1, median, q3): quartiles as medians of the halves, the median left out of both if the number is odd."""

    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0)

    def hinges(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        low, high = F.slice(v, F.lit(1), half), F.slice(v, F.size(v) - half + 1, half)
        single = F.size(v) == 1
        return F.struct(F.when(single, middle(v)).otherwise(middle(low)).alias("q1"), middle(v).alias("median"), F.when(single, middle(v)).otherwise(middle(high)).alias("q3"))

    return let(F.sort_array(col(values)), lambda v: F.when(F.size(v) > 0, hinges(v)))


def upper_median(values: str | Column) -> Column:
    """Of an even number of values the upper of the middle two."""
    return let(F.sort_array(col(values)), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))


def within_hamming(a: str | Column, b: str | Column, most: int = 1) -> Column:
    """Whether two sequences of one length differ in at most `most` places."""
    a, b = col(a), col(b)
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x)
    return (F.length(a) == F.length(b)) & (F.size(differ) <= most)


def trimmed_number(c: str | Column, digits: int) -> Column:
    """A number as text with at most so many digits after the point, without zeros at its end; a half, as the shortest
    decimal that stands for the number shows it, is rounded away from zero."""
    text = F.format_string(f"%.{digits}f", col(c).cast("double"))
    return F.when(F.lit(digits) > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
