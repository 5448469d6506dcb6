"""Queries of recruitment and sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as Q
from helixframe.operators import evidence, recruit
from helixframe.plans.fixtures import FRAGMENTS, LOCI, PAIRS, fragments, load, loci, pairs, rc, sql_windows

K = 31


def recruit_loci(spark, sf_dir):
    index = recruit.reference_index(loci(spark, sf_dir), "locus", "seq", K)
    hits = recruit.recruit(fragments(spark, sf_dir), "frag", ["seq"], index, K)
    return hits.groupBy("locus").agg(F.count(F.lit(1)).alias("reads"), F.min("frag").alias("first_frag"))


HITS = f"WITH {FRAGMENTS}, {LOCI}, {sql_windows('fk', 'fragments', 'frag', 'seq', K)}, {sql_windows('lk', 'loci', 'locus', 'seq', K)}, hits AS (SELECT DISTINCT frag, locus FROM fk JOIN lk USING (kmer))"
RECRUIT_LOCI = f"{HITS} SELECT locus, count(*) AS reads, min(frag) AS first_frag FROM hits GROUP BY locus"


def recruit_pairs_strong_rescue(spark, sf_dir):
    k = 15
    seeds = recruit.unique_seeds(loci(spark, sf_dir), "locus", "seq", k)
    frags = pairs(spark, sf_dir)
    sides = [recruit.recruit(frags.select("frag", s), "frag", [s], seeds, k) for s in ("r1", "r2")]
    found = recruit.assign_pairs(*sides, "frag", frags)
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("locus").alias("loci"))


def _sides(k: int) -> str:
    return f"""WITH {PAIRS}, {LOCI}, {sql_windows('lk', 'loci', 'locus', 'seq', k)},
seeds AS (SELECT kmer, min(locus) AS locus FROM lk GROUP BY kmer HAVING count(DISTINCT locus) = 1),
{sql_windows('k1', 'pairs', 'frag', 'r1', k)}, {sql_windows('k2', 'pairs', 'frag', 'r2', k)},
s1 AS (SELECT frag, list(DISTINCT locus) AS l FROM k1 JOIN seeds USING (kmer) GROUP BY frag),
s2 AS (SELECT frag, list(DISTINCT locus) AS l FROM k2 JOIN seeds USING (kmer) GROUP BY frag)"""


RECRUIT_PAIRS = f"""{_sides(15)},
b AS (SELECT frag, coalesce(s1.l, []) AS l1, coalesce(s2.l, []) AS l2 FROM pairs LEFT JOIN s1 USING (frag) LEFT JOIN s2 USING (frag)),
c AS (SELECT *, list_intersect(l1, l2) AS shared FROM b),
d AS (SELECT CASE WHEN len(l1) + len(l2) = 0 THEN 'none' WHEN len(shared) = 1 THEN 'strong' WHEN len(shared) = 0 AND len(l1) + len(l2) = 1 THEN 'rescue' ELSE 'ambiguous' END AS state,
             CASE WHEN len(shared) = 1 THEN shared[1] WHEN len(shared) = 0 AND len(l1) + len(l2) = 1 THEN list_concat(l1, l2)[1] END AS locus FROM c)
SELECT state, count(*) AS n, count(DISTINCT locus) AS loci FROM d GROUP BY state"""


def recruit_tiered_fallback(spark, sf_dir):
    hits = recruit.recruit_tiered(fragments(spark, sf_dir), "frag", ["seq"], loci(spark, sf_dir), "locus", "seq", [31, 25, 19])
    return hits.groupBy("k", "locus").agg(F.count(F.lit(1)).alias("reads"))


TIERED = f"""WITH {FRAGMENTS}, {LOCI},
{", ".join(sql_windows(f'f{k}', 'fragments', 'frag', 'seq', k) + ", " + sql_windows(f'l{k}', 'loci', 'locus', 'seq', k) for k in (31, 25, 19))},
h31 AS (SELECT DISTINCT frag, locus FROM f31 JOIN l31 USING (kmer)),
h25 AS (SELECT DISTINCT frag, locus FROM f25 JOIN l25 USING (kmer) WHERE frag NOT IN (SELECT frag FROM h31)),
h19 AS (SELECT DISTINCT frag, locus FROM f19 JOIN l19 USING (kmer) WHERE frag NOT IN (SELECT frag FROM h31) AND frag NOT IN (SELECT frag FROM h25))
SELECT k::INT AS k, locus, count(*) AS reads FROM (SELECT 31 AS k, * FROM h31 UNION ALL SELECT 25, * FROM h25 UNION ALL SELECT 19, * FROM h19) GROUP BY ALL"""


def recruit_panel_expansion(spark, sf_dir):
    refs = loci(spark, sf_dir)
    hits = recruit.panel_expansion(fragments(spark, sf_dir), "frag", ["seq"], refs, "locus", "seq", refs.where("locus % 2 = 0").select("locus"), K, 1)
    return hits.groupBy("locus").agg(F.count(F.lit(1)).alias("reads"))


PANEL = f"""{HITS}, gate AS (SELECT DISTINCT frag FROM hits WHERE locus % 2 = 0),
few AS (SELECT *, count(*) OVER (PARTITION BY frag) AS n FROM hits WHERE frag IN (SELECT frag FROM gate))
SELECT locus, count(*) AS reads FROM few WHERE n <= 1 AND locus % 2 = 0 GROUP BY locus"""


def unique_seeds(spark, sf_dir):
    found = recruit.unique_seeds(loci(spark, sf_dir), "locus", "seq", 23)
    return found.select("locus", recruit.decode("kmer", 23).alias("kmer"))


UNIQUE_SEEDS = f"WITH {LOCI}, {sql_windows('lk', 'loci', 'locus', 'seq', 23)} SELECT min(locus) AS locus, kmer FROM lk GROUP BY kmer HAVING count(DISTINCT locus) = 1"


def kmer_depth_topk(spark, sf_dir):
    depth = recruit.deepest_kmers(fragments(spark, sf_dir), "seq", 21, 2000, 2)
    return depth.select(recruit.decode("kmer", 21).alias("kmer"), "depth").orderBy(F.desc("depth"), "kmer").limit(2000)


KMER_DEPTH = f"WITH {FRAGMENTS}, {sql_windows('fk', 'fragments', 'frag', 'seq', 21)} SELECT kmer, count(DISTINCT frag) AS depth FROM fk GROUP BY kmer HAVING count(DISTINCT frag) >= 2 ORDER BY depth DESC, kmer LIMIT 2000"


def fractional_support(spark, sf_dir):
    index = recruit.reference_index(loci(spark, sf_dir), "locus", "seq", K)
    hits = recruit.recruit(fragments(spark, sf_dir), "frag", ["seq"], index, K)
    groups = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("frag"), "quality")
    support = recruit.fractional_support(hits.join(groups, "frag", "left_semi"), "frag", "locus")
    return support.withColumn("fractional_queries", F.round("fractional_queries", 9))


FRACTIONAL = f"""{HITS}, h AS (SELECT *, count(*) OVER (PARTITION BY frag) AS n FROM hits WHERE frag IN (SELECT doc_id FROM labels))
SELECT locus, count(*) AS hit_queries, round(sum(1.0::DOUBLE / n), 9) AS fractional_queries, sum((n = 1)::BIGINT)::BIGINT AS singleton_queries FROM h GROUP BY locus"""


def effective_length(spark, sf_dir):
    refs = loci(spark, sf_dir).select((F.col("locus") % 10).alias("locus"), "seq")
    return evidence.effective_length(refs, "locus", "seq", K)


EFFECTIVE_LENGTH = f"""WITH {LOCI} SELECT locus % 10 AS locus, count(*) FILTER (length(seq) >= {K}) AS refs, max(length(seq)) AS longest,
trunc(max(length(seq)) * (log10(count(*) FILTER (length(seq) >= {K})) + 1))::BIGINT AS effective_length FROM loci GROUP BY 1 HAVING refs > 0"""


def rc_canonical(spark, sf_dir):
    return loci(spark, sf_dir).select("locus", Q.reverse_complement("seq").alias("rc"), Q.canonical("seq").alias("canonical"), Q.canonical_motif("seq").alias("motif"))


def _rotations(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 1), lambda i: substring({s}, i) || substring({s}, 1, i - 1))"


RC = f"WITH {LOCI}, m AS (SELECT *, {rc('seq')} AS rc FROM loci) SELECT locus, rc, least(seq, rc) AS canonical, least(list_min({_rotations('seq')}), list_min({_rotations('rc')})) AS motif FROM m"


def translate_codons(spark, sf_dir):
    return loci(spark, sf_dir).select("locus", Q.translate_codons("seq").alias("protein"))


TRANSLATE = f"""WITH {LOCI}, c AS (SELECT locus, i, substring(seq, 3 * i + 1, 3) AS codon FROM (SELECT locus, seq, unnest(range(0, length(seq) // 3)) AS i FROM loci))
SELECT locus, string_agg(CASE codon {" ".join(f"WHEN '{c}' THEN '{a}'" for c, a in Q.CODONS.items())} ELSE 'X' END, '' ORDER BY i) AS protein FROM c GROUP BY locus"""


def entropy2(spark, sf_dir):
    return evidence.dinucleotide_entropy(fragments(spark, sf_dir), "frag", "seq").withColumn("entropy", F.round("entropy", 6))


ENTROPY = f"""WITH {FRAGMENTS}, {sql_windows('w', 'fragments', 'frag', 'seq', 2, False)}, n AS (SELECT frag, kmer, count(*) AS n FROM w GROUP BY ALL),
p AS (SELECT frag, n / sum(n) OVER (PARTITION BY frag) AS p FROM n), e AS (SELECT frag, -sum(p * log2(p)) AS e FROM p GROUP BY frag)
SELECT frag, round(coalesce(e, 0.0), 6)::DOUBLE AS entropy FROM fragments LEFT JOIN e USING (frag)"""


def minimizer_sketch_size(spark, sf_dir):
    return evidence.minimizer_sketches(fragments(spark, sf_dir), "frag", "seq", 15, 10).select("frag", F.size("sketch").cast("bigint").alias("size"))


MINIMIZERS = f"""WITH {FRAGMENTS}, {sql_windows('w', 'fragments', 'frag', 'seq', 15)},
m AS (SELECT frag, pos, min(kmer) OVER (PARTITION BY frag ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (PARTITION BY frag) AS n FROM w),
s AS (SELECT frag, count(DISTINCT m) AS size FROM m WHERE pos <= greatest(n - 10, 0) GROUP BY frag)
SELECT frag, coalesce(size, 0)::BIGINT AS size FROM fragments LEFT JOIN s USING (frag)"""


def cigar_ops(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_size")).cast("string"), F.lit("M"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("I2D"), (F.col("p_size") + 1).cast("string"), F.lit("M")).alias("cigar"))
    ops = rows.select("p_partkey", F.posexplode(Q.cigar_ops("cigar")).alias("i", "o"))
    return ops.groupBy("p_partkey").agg(F.sum(F.when(F.col("o.op").isin("M", "I"), F.col("o.length"))).alias("query_bases"), F.sum(F.when(F.col("o.op").isin("M", "D"), F.col("o.length"))).alias("reference_bases"), F.count(F.lit(1)).alias("ops"))


CIGAR = "SELECT p_partkey, (p_size + p_partkey % 3 + 1 + p_size + 1)::BIGINT AS query_bases, (p_size + 2 + p_size + 1)::BIGINT AS reference_bases, 4::BIGINT AS ops FROM part"


def unresolved_loci(spark, sf_dir):
    refs = loci(spark, sf_dir)
    hits = recruit.recruit(fragments(spark, sf_dir), "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", K), K)
    return refs.select("locus").exceptAll(hits.select("locus").distinct())


UNRESOLVED = f"{HITS} SELECT locus FROM loci EXCEPT SELECT locus FROM hits"


def id_coverage_checks(spark, sf_dir):
    """Ids of a group map against reference ids: missing, unused and disagreeing ones."""
    refs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    groups = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("group"))
    return evidence.id_coverage(refs, groups, "id", "group")


ID_COVERAGE = """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing,
(SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS unused,
(SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(DISTINCT quality) > 1)) AS disagreeing"""

QUERIES = {
    "recruit_loci": (recruit_loci, RECRUIT_LOCI),
    "recruit_pairs_strong_rescue": (recruit_pairs_strong_rescue, RECRUIT_PAIRS),
    "recruit_tiered_fallback": (recruit_tiered_fallback, TIERED),
    "recruit_panel_expansion": (recruit_panel_expansion, PANEL),
    "unique_seeds": (unique_seeds, UNIQUE_SEEDS),
    "kmer_depth_topk": (kmer_depth_topk, KMER_DEPTH),
    "fractional_support": (fractional_support, FRACTIONAL),
    "effective_length": (effective_length, EFFECTIVE_LENGTH),
    "rc_canonical": (rc_canonical, RC),
    "translate_codons": (translate_codons, TRANSLATE),
    "entropy2": (entropy2, ENTROPY),
    "minimizer_sketch_size": (minimizer_sketch_size, MINIMIZERS),
    "cigar_ops": (cigar_ops, CIGAR),
    "unresolved_loci": (unresolved_loci, UNRESOLVED),
    "id_coverage_checks": (id_coverage_checks, ID_COVERAGE),
}
