"""Queries of hits, links, candidates, names and positions, over whole sample tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences
from helixframe.functions.sequences import IUPAC, IUPAC_COMPLEMENT, dna_of_text
from helixframe.operators import cohort, evidence, graph, population, rad, recruit, repeats, selection, workflow
from helixframe.plans.fixtures import dna, load, rc
from helixframe.sources import formats


def _arm_hits(spark, sf_dir):
    """Orders hit the arm of their part: 60 loci of two arms and 20 without."""
    arm = F.when(F.col("l_partkey") % 80 < 60, F.concat(F.lit("L"), (F.col("l_partkey") % 60).cast("string"), F.lit("__R"), (F.col("l_linenumber") % 2 + 1).cast("string"))).otherwise(F.concat(F.lit("S"), (F.col("l_partkey") % 20).cast("string")))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frag"), arm.alias("locus")).distinct()


SQL_ARMS = """h AS (SELECT DISTINCT l_orderkey AS frag, CASE WHEN l_partkey % 80 < 60 THEN 'L' || l_partkey % 60 || '__R' || (l_linenumber % 2 + 1) ELSE 'S' || l_partkey % 20 END AS locus FROM lineitem)"""


def sibling_arms(spark, sf_dir):
    return recruit.expand_siblings(_arm_hits(spark, sf_dir), "frag", "frag", 40)


SIBLINGS = f"""WITH {SQL_ARMS}, n AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY frag) AS n FROM h WHERE regexp_matches(locus, '__R[12]$'))
SELECT frag, locus FROM h UNION SELECT frag, left(locus, length(locus) - 1) || CASE WHEN right(locus, 1) = '1' THEN '2' ELSE '1' END FROM n WHERE n <= 40"""


def pair_rule(spark, sf_dir):
    first, second = (F.col("l_partkey") % 4).cast("int"), (F.col("l_suppkey") % 4).cast("int")
    return load(spark, sf_dir, "lineitem").groupBy(first.alias("v1"), second.alias("v2")).agg(F.count(F.lit(1)).alias("pairs")).select("v1", "v2", "pairs", evidence.pair_kept(F.col("v1"), F.col("v2")).alias("kept"), evidence.pair_kept(F.col("v1"), F.col("v2"), True).alias("kept_strict"))


PAIR_RULE = """WITH v AS (SELECT (l_partkey % 4)::INT AS v1, (l_suppkey % 4)::INT AS v2, count(*) AS pairs FROM lineitem GROUP BY ALL)
SELECT v1, v2, pairs, NOT (v1 = v2 AND v1 IN (1, 2)) AS kept, NOT (v1 = v2 AND v1 IN (0, 1, 2)) AS kept_strict FROM v"""


def accepted_rows(spark, sf_dir):
    flag = F.when(F.col("o_orderkey") % 5 == 0, "Yes").when(F.col("o_orderkey") % 5 == 1, "0").when(F.col("o_orderkey") % 5 == 2, "")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    low = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") < 50000)
    return load(spark, sf_dir, "orders").select("o_orderkey", workflow.accepted_row(flag, status, low).alias("accepted"))


ACCEPTED = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE o_orderstatus = 'F' AND NOT (o_orderkey % 3 > 0 AND o_totalprice < 50000) END AS accepted FROM orders"""


def hamming_neighbours(spark, sf_dir):
    """Brands of parts, as texts of one length or another, within one difference of the next part's."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("next"))
    return p.join(other, "p_partkey").where(sequences.within_hamming("p_brand", "next")).select("p_partkey", "p_brand", "next")


HAMMING = """SELECT a.p_partkey, a.p_brand, b.p_brand AS next FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE length(a.p_brand) = length(b.p_brand) AND hamming(a.p_brand, b.p_brand) <= 1"""


def column_identities(spark, sf_dir):
    """Names of parts as aligned rows, their r as gaps and w as unknown, against the next part's."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "rw", "-?").alias("a"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    found = p.join(other, "p_partkey").select("p_partkey", cohort.column_identity(F.col("a"), F.col("b")).alias("i"))
    return found.where("i.comparable > 0").select("p_partkey", F.col("i.comparable").cast("bigint").alias("comparable"), F.round("i.identity", 9).alias("identity"))


COLUMN_IDENTITY = """WITH p AS (SELECT p_partkey, translate(p_name, 'rw', '-?') AS a FROM part),
c AS (SELECT x.p_partkey, unnest(string_split(x.a, '')) AS u, unnest(string_split(y.a, '')) AS v FROM p x JOIN p y ON y.p_partkey = x.p_partkey + 1)
SELECT p_partkey, count(*) AS comparable, round(avg((u = v)::INT), 9)::DOUBLE AS identity FROM c WHERE u NOT IN ('-', '?') AND v NOT IN ('-', '?') GROUP BY p_partkey"""


def distinct_candidates(spark, sf_dir):
    """Bases of names, repeated to 40 and more, of parts by brand; both strands occur."""
    seq = F.repeat(dna_of_text("p_name"), 5)
    made = F.when(F.col("p_partkey") % 2 == 0, seq).otherwise(sequences.reverse_complement(seq))
    cut = F.substring(made, F.lit(1), F.length(seq) - (F.col("p_size") % 3).cast("int"))
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", cut.alias("seq"), F.lit(60).alias("reference_length"))
    return cohort.distinct_candidates(rows, ["p_brand"], "seq", "p_partkey", "reference_length").select("p_brand", "p_partkey")


DISTINCT_CANDIDATES = f"""WITH s AS (SELECT p_brand, p_partkey, p_size, repeat({dna('p_name')}, 5) AS f FROM part),
m AS (SELECT p_brand, p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN f ELSE {rc('f')} END AS f FROM s),
c AS (SELECT p_brand, p_partkey, substring(f, 1, length(f) - p_size % 3) AS seq FROM m), l AS (SELECT *, least(seq, {rc('seq')}) AS k FROM c WHERE length(seq) >= 40),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY p_brand, k ORDER BY p_partkey) = 1)
SELECT p_brand, p_partkey FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.p_brand = o.p_brand AND starts_with(x.seq, o.seq) AND length(x.seq) > length(o.seq))"""


def _labelled_lines(spark, sf_dir):
    group = F.when(F.col("l_returnflag") != "N", (F.col("l_partkey") % 12).cast("bigint"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), "l_suppkey", group.alias("grp"))


def group_transitions(spark, sf_dir):
    return graph.transitions(_labelled_lines(spark, sf_dir), "l_orderkey", "at", "grp")


TRANSITIONS = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 12 AS grp FROM lineitem WHERE l_returnflag <> 'N'),
f AS (SELECT grp, lag(grp) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM g)
SELECT least(before, grp) AS a, greatest(before, grp) AS b, count(*) AS n FROM f WHERE before <> grp GROUP BY ALL"""


def mate_links(spark, sf_dir):
    hits = _labelled_lines(spark, sf_dir).where("grp IS NOT NULL").select("l_orderkey", (F.col("l_suppkey") % 3).alias("source"), (F.col("grp") % 4).alias("target"))
    return graph.mate_links(hits, "l_orderkey", "source", "target")


MATE_LINKS = """WITH c AS (SELECT l_orderkey, l_suppkey % 3 AS source, l_partkey % 12 % 4 AS target, count(*) AS hits FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
b AS (SELECT *, max(hits) OVER (PARTITION BY l_orderkey, source) AS best FROM c),
o AS (SELECT l_orderkey, source, max(target) AS target FROM b WHERE hits = best GROUP BY ALL HAVING count(*) = 1)
SELECT source, target, count(*) AS n FROM o GROUP BY ALL"""


def status_enrichment(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    spent = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return cohort.enrich(rows, [(nations, "c_nationkey", {"n_name": "unknown"}), (spent, "c_custkey", {"orders": 0})]).select("c_custkey", "n_name", "orders")


ENRICH = """SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def reference_mean_lengths(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_brand", F.translate("p_name", "aen ", "-Nn-").alias("seq"))
    return cohort.reference_lengths(rows, "p_brand", "seq")


REFERENCE_LENGTHS = "SELECT p_brand, round(avg(length(regexp_replace(translate(p_name, 'aen ', '-Nn-'), '[-Nn]', '', 'g'))))::BIGINT AS mean_length FROM part GROUP BY 1"


def mapping_qc(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("bigint").alias("length"), F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("bigint").alias("covered"), (F.col("l_tax") * 100).alias("depth"))
    return population.mapping_quality(rows, "sample").withColumns({"mean_depth": F.round("mean_depth", 6), "coverage_breadth": F.round("coverage_breadth", 9)})


MAPPING_QC = """WITH r AS (SELECT l_suppkey AS sample, l_quantity::BIGINT AS length, floor(l_quantity * (1 - l_discount))::BIGINT AS covered, l_tax * 100 AS depth FROM lineitem)
SELECT sample, sum(length)::BIGINT AS reference_bases, sum(covered)::BIGINT AS covered_bases, round(sum(depth * length) / sum(length), 6)::DOUBLE AS mean_depth, round(sum(covered) / sum(length), 9)::DOUBLE AS coverage_breadth FROM r GROUP BY sample"""


def repeat_annotation(spark, sf_dir):
    c = F.col
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 30 - 5).alias("period"), (c("l_discount") * 10).alias("foldback"), (c("l_suppkey") % 6).alias("support"), (1 - c("l_tax") * 4).alias("identity"), (c("l_quantity") / 50).alias("coverage"), (c("l_tax") * 3).alias("delta"))
    return rows.select("l_orderkey", "l_linenumber", repeats.annotation(c("period"), c("foldback"), c("support"), c("identity"), c("coverage"), c("delta"), F.lit("library")).alias("class"))


ANNOTATION = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 30 - 5 AS p, l_discount * 10 AS f, l_suppkey % 6 AS s, 1 - l_tax * 4 AS i, l_quantity / 50 AS c, l_tax * 3 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p BETWEEN 1 AND 20 THEN 'simple_repeat' WHEN p > 20 THEN 'satellite' WHEN i >= 0.8::DOUBLE AND c >= 0.6::DOUBLE AND d >= 0.1::DOUBLE THEN 'library'
WHEN f >= 0.85::DOUBLE AND s >= 3 THEN 'foldback' WHEN s >= 3 THEN 'unknown' ELSE 'unsupported' END AS class FROM r"""


def repeat_curation(spark, sf_dir):
    atoms = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum((F.col("l_returnflag") == "N").cast("bigint")).alias("specific_pairs"), F.sum((F.col("l_returnflag") != "N").cast("bigint")).alias("ambiguous_pairs"))
    found = repeats.curate(atoms.withColumn("key", F.col("l_partkey") % 700), "l_partkey", "key")
    return found


CURATION = """WITH a AS (SELECT l_partkey, l_suppkey, count(*) FILTER (l_returnflag = 'N') AS s, count(*) FILTER (l_returnflag <> 'N') AS m FROM lineitem GROUP BY ALL),
c AS (SELECT l_partkey % 700 AS key, min(l_partkey) AS equivalence_id, count(*) AS atomic_count, max(s) AS specific_pairs_total, max(m) AS ambiguous_pairs_total FROM a GROUP BY 1)
SELECT *, CASE WHEN specific_pairs_total < 3 THEN 'low' WHEN specific_pairs_total / (specific_pairs_total + ambiguous_pairs_total) >= 0.7::DOUBLE THEN 'high' ELSE 'medium' END AS confidence,
CASE WHEN specific_pairs_total < 3 THEN 'review' ELSE 'keep' END AS decision FROM c"""


def divergence_bins(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("grp"), (1 - F.col("l_orderkey") % 64 / 256).alias("identity"))
    return repeats.divergence_bins(rows, "grp", "identity")


DIVERGENCE = "SELECT l_partkey % 40 AS grp, least(floor((1 - (1 - l_orderkey % 64 / 256::DOUBLE)) * 100), 20)::INT AS bin, count(*) AS reads FROM lineitem GROUP BY ALL"


def informative_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_brand", F.translate("p_name", "rNen", "--?N").alias("seq"))
    return cohort.informative_columns(rows, ["p_brand"], "seq").select("p_brand", F.col("column").cast("int").alias("column"), F.round("informative", 9).alias("informative"))


INFORMATIVE = """WITH c AS (SELECT p_brand, unnest(string_split(translate(p_name, 'rNen', '--?N'), '')) AS b, unnest(range(length(p_name))) AS k FROM part)
SELECT p_brand, k::INT AS "column", round(avg((b NOT IN ('-', '?', 'N', 'n', 'X'))::INT), 9)::DOUBLE AS informative FROM c GROUP BY p_brand, k HAVING avg((b NOT IN ('-', '?', 'N', 'n', 'X'))::INT) >= 0.5"""


def bounded_stacks(spark, sf_dir):
    reads = load(spark, sf_dir, "lineitem").select("l_suppkey", F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("hash"))
    return rad.bounded_stacks(reads, ["l_suppkey"], "hash", 25)


STACKS = "WITH r AS (SELECT l_suppkey, md5(l_orderkey || ':' || l_linenumber) AS hash FROM lineitem) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY hash) <= 25"


def even_sample(spark, sf_dir):
    return workflow.even_sample(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 101)


EVEN = """WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS k FROM orders)
SELECT o_orderkey, o_totalprice FROM n WHERE i IN (SELECT unnest(list_transform(range(101), lambda x: x * (k - 1) // 100)) FROM (SELECT count(*) AS k FROM orders))"""


def read_ledger(spark, sf_dir):
    denied = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return formats.without_ledger(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", denied).select("o_orderkey", "o_custkey")


LEDGER = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"


def site_subset(spark, sf_dir):
    sites = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return cohort.exact_subset(sites, sites.where("o_orderkey % 10 = 3"), ["o_orderkey"])


SUBSET = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 = 3"


def mean_and_hinges(spark, sf_dir):
    found = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(sequences.tukey_hinges(F.collect_list("l_quantity")).alias("h"), sequences.upper_median(F.collect_list("l_quantity")).alias("upper"))
    return found.select("l_partkey", "h.q1", "h.median", "h.q3", "upper")


HINGES = """WITH v AS (SELECT l_partkey, list_sort(list(l_quantity)) AS v, count(*)::INT AS n FROM lineitem GROUP BY 1), h AS (SELECT *, n // 2 AS k FROM v)
SELECT l_partkey, CASE WHEN n = 1 THEN v[1] ELSE list_median(v[1:k]) END AS q1, list_median(v) AS median, CASE WHEN n = 1 THEN v[1] ELSE list_median(v[n - k + 1:n]) END AS q3, v[n // 2 + 1] AS upper FROM h"""


def names_and_ids(spark, sf_dir):
    header = F.concat(F.lit("@"), F.regexp_replace("c_name", "#", "_"), F.when(F.col("c_custkey") % 3 == 0, "/1").when(F.col("c_custkey") % 3 == 1, "/2/1").otherwise(""), F.lit(" len=5"))
    raw = F.concat(F.lit("a-"), F.col("c_name"), F.lit(" x.1"))
    path = F.concat(F.lit("/data/"), F.col("c_name"), F.lit(".fasta"), F.when(F.col("c_custkey") % 2 == 0, ".gz").otherwise(""))
    return load(spark, sf_dir, "customer").select(
        "c_custkey", sequences.pair_id(header).alias("pair"), sequences.pair_id_repeated(header).alias("repeated"), sequences.sample_name(raw).alias("sample"), sequences.vcf_name(raw).alias("vcf"), sequences.locus_name(path).alias("locus"), sequences.trimmed_number(F.col("c_acctbal") / 7, 2).alias("number")
    )


NAMES = r"""WITH h AS (SELECT c_custkey, c_acctbal, c_name, regexp_replace(c_name, '#', '_', 'g') || CASE c_custkey % 3 WHEN 0 THEN '/1' WHEN 1 THEN '/2/1' ELSE '' END AS id, 'a-' || c_name || ' x.1' AS raw FROM customer)
SELECT c_custkey, regexp_replace(id, '/[12]$', '') AS pair, regexp_replace(id, '(/[12])+$', '') AS repeated, 'A' || substring(regexp_replace(regexp_replace(raw, '[\s-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), 2) AS sample,
regexp_replace(raw, '[^A-Za-z0-9_.-]', '_', 'g') AS vcf, c_name AS locus, regexp_replace(regexp_replace(printf('%.2f', c_acctbal / 7), '0+$', ''), '\.$', '') AS number FROM h"""


def sequence_slices(spark, sf_dir):
    """Bases of parts' names: circular slices, the last tile's start, motif and IUPAC complements, masked bases."""
    s = dna_of_text("p_name")
    qual = F.translate(F.col("p_name"), "abcdefghijklmnopqrstuvwxyz ", "!+5?I!+5?I!+5?I!+5?I!+5?II!")
    rows = load(spark, sf_dir, "part").select("p_partkey", s.alias("s"), qual.alias("q"), F.col("p_name"), F.col("p_size"))
    return rows.select(
        "p_partkey",
        sequences.circular_slice("s", F.col("p_partkey") % 97, F.col("p_size")).alias("slice"),
        F.transform(sequences.tiles("s", 4, 3), lambda t: t["tile"]).getItem(0).alias("first_tile"),
        F.array_max(F.transform(sequences.tiles("s", 4, 3), lambda t: t["start"])).alias("last_start"),
        sequences.reverse_complement_iupac(F.translate("s", "AC", "RY")).alias("rc_iupac"),
        sequences.only_bases("p_name").alias("bases"),
        sequences.is_plain("p_name").alias("plain"),
        sequences.masked_by_quality(F.upper("p_name"), F.col("q"), 20).alias("masked"),
    )


SLICES = f"""WITH p AS (SELECT p_partkey, p_name, p_size, {dna('p_name')} AS s FROM part)
SELECT p_partkey, substring(s || s, p_partkey % 97 % length(s) + 1, least(p_size, length(s))) AS slice, substring(s, 1, 4) AS first_tile, greatest(length(s) - 4, 0)::INT AS last_start,
reverse(translate(translate(s, 'AC', 'RY'), '{IUPAC}', '{IUPAC_COMPLEMENT}')) AS rc_iupac, regexp_replace(translate(upper(p_name), 'U', 'T'), '[^ACGT]', '', 'g') AS bases, regexp_matches(p_name, '^[ACGTUacgtu]+$') AS plain,
array_to_string(list_transform(string_split(p_name, ''), lambda x: CASE WHEN contains('abfgklpquv ', x) THEN 'N' ELSE upper(x) END), '') AS masked FROM p"""


def pileup_insertions(spark, sf_dir):
    """Made-up alignments of parts' names: two to four bases, an insertion of one to three, the rest."""
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("ref"), (F.col("p_partkey") % 11).cast("int").alias("pos"), (F.col("p_partkey") % 3).cast("int").alias("k"), dna_of_text("p_name").alias("seq")).where(F.length("seq") > 7)
    ops = F.expr("array(named_struct('length', 2 + k, 'op', 'M'), named_struct('length', 3 - k, 'op', 'I'), named_struct('length', length(seq) - 5, 'op', 'M'))")
    rows = p.withColumn("ops", ops)
    return cohort.insertions(rows, cohort.pileup(rows, "ref", "pos", "ops", "seq"), "ref", "pos", "ops", "seq").withColumn("column", F.col("column").cast("bigint")).withColumn("position", F.col("position").cast("bigint"))


INSERTIONS = f"""WITH p AS (SELECT p_partkey % 50 AS ref, p_partkey % 11 AS pos, p_partkey % 3 AS k, {dna('p_name')} AS seq FROM part), a AS (SELECT * FROM p WHERE length(seq) > 7),
i AS (SELECT ref, pos + 1 + k AS position, unnest(range(3 - k)) AS "column", k, seq FROM a), b AS (SELECT ref, position, "column", substring(seq, (3 + k + "column")::INT, 1) AS base FROM i),
c AS (SELECT ref, position, "column", base, count(*) AS n FROM b GROUP BY ALL),
cov AS (SELECT ref, position, count(*) AS depth FROM (SELECT ref, pos + unnest(range(length(seq) - 3 + k)) AS position FROM a) GROUP BY ALL),
e AS (SELECT ref, max(position) AS last FROM cov GROUP BY 1),
s AS (SELECT ref, position, "column", sum(n)::BIGINT AS seen FROM c GROUP BY ALL)
SELECT ref, position, "column", base, n FROM c UNION ALL
SELECT s.ref, s.position, s."column", '-' AS base, depth - seen AS n FROM s JOIN e ON e.ref = s.ref JOIN cov ON cov.ref = s.ref AND cov.position = least(s.position, last) WHERE depth > seen"""


def sample_statistics(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linestatus") == "F").alias("accepted"), F.col("l_quantity").cast("bigint").alias("length"), (F.col("l_partkey") % 4).alias("reads"))
    found = cohort.sample_stats(rows, "l_suppkey")
    return found.select("l_suppkey", "loci", "accepted_loci", "loci_with_reads", F.round("mean_length", 6).alias("mean_length"))


SAMPLE_STATS = """SELECT l_suppkey, count(*) AS loci, count(*) FILTER (l_linestatus = 'F') AS accepted_loci, count(*) FILTER (l_partkey % 4 > 0) AS loci_with_reads, round(avg(l_quantity::BIGINT) FILTER (l_linestatus = 'F'), 6)::DOUBLE AS mean_length FROM lineitem GROUP BY 1"""


def back_translation(spark, sf_dir):
    """Names of parts as aligned amino acids, blanks and e as gaps; a fifth of them with fewer codons."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", " e", "--").alias("aligned"), dna_of_text("p_name").alias("seq"))
    cds = F.when(F.col("p_partkey") % 5 == 0, F.repeat("seq", F.lit(2))).otherwise(F.repeat("seq", F.lit(3)))
    return p.select("p_partkey", sequences.back_translate("aligned", cds).alias("codons"))


BACK_TRANSLATION = f"""WITH p AS (SELECT p_partkey, translate(p_name, ' e', '--') AS a, repeat({dna('p_name')}, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END) AS cds FROM part),
r AS (SELECT p_partkey, cds, unnest(string_split(a, '')) AS c, unnest(range(length(a))) AS i FROM p),
o AS (SELECT *, sum((c <> '-')::INT) OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM r)
SELECT p_partkey, CASE WHEN max(n) * 3 <= max(length(cds)) THEN string_agg(CASE WHEN c = '-' THEN '---' ELSE substring(cds, (n * 3 - 2)::BIGINT, 3) END, '' ORDER BY i) END AS codons FROM o GROUP BY 1"""


def alignment_qc(spark, sf_dir):
    """Names of parts, padded by gaps, as alignments by size, in letters and codons; some have rows of unequal lengths."""
    group = F.col("p_size") % 10
    width = F.when(group == 3, 60 + F.col("p_partkey") % 2).when(group == 4, 61).otherwise(60).cast("int")
    rows = load(spark, sf_dir, "part").select(group.alias("grp"), "p_partkey", F.rpad(F.translate("p_name", " r", "-X"), width, F.lit("-")).alias("seq"))
    found = [cohort.alignment_qc(rows, ["grp"], "seq", "p_partkey", u).withColumn("unit", F.lit(u)) for u in (1, 3)]
    return found[0].unionByName(found[1]).withColumn("fraction", F.round("fraction", 9))


ALIGNMENT_QC = """WITH r AS (SELECT p_size % 10 AS grp, p_partkey, rpad(translate(p_name, ' r', '-X'), (CASE p_size % 10 WHEN 3 THEN 60 + p_partkey % 2 WHEN 4 THEN 61 ELSE 60 END)::INT, '-') AS seq FROM part),
g AS (SELECT grp, arg_min(length(seq), p_partkey) AS len, min(length(seq)) = max(length(seq)) AS even, count(*) AS n FROM r GROUP BY grp), u AS (SELECT unnest([1, 3]) AS unit),
c AS (SELECT grp, unit, k, count(*) FILTER (regexp_full_match(substring(seq, k * unit + 1, unit), '[A-WYZa-z]+')) AS whole FROM (SELECT grp, unit, seq, unnest(range(length(seq) // unit)) AS k FROM r CROSS JOIN u) GROUP BY ALL),
e AS (SELECT grp, unit, count(*) AS whole FROM c JOIN g USING (grp) WHERE whole * 2 >= n GROUP BY ALL),
f AS (SELECT g.grp, u.unit, len // u.unit AS columns, CASE WHEN even AND len % u.unit = 0 THEN coalesce(whole, 0) ELSE 0 END AS effective FROM g CROSS JOIN u LEFT JOIN e ON e.grp = g.grp AND e.unit = u.unit)
SELECT grp, unit, columns, effective, round(effective::DOUBLE / columns, 9) AS fraction FROM f"""


def cohort_smallest_hashes(spark, sf_dir):
    reads = load(spark, sf_dir, "lineitem").select("l_suppkey", F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("hash"))
    return selection.smallest_of_cohort(reads, ["hash"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("reads"), F.max("hash").alias("last_hash"))


COHORT_HASHES = """WITH r AS (SELECT l_suppkey, md5(l_orderkey || ':' || l_linenumber) AS hash FROM lineitem ORDER BY hash LIMIT 50000)
SELECT l_suppkey, count(*) AS reads, max(hash) AS last_hash FROM r GROUP BY 1"""


def largest_components(spark, sf_dir):
    """Orders as reads, their customers as components."""
    return graph.largest_components(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("component")))


LARGEST_COMPONENTS = """SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey)::INT AS rank, o_custkey AS component, count(*) AS size FROM orders GROUP BY o_custkey HAVING count(*) >= 20 QUALIFY rank <= 256"""


def read_cap(spark, sf_dir):
    """Orders as reads of a file, 500 ordinals apart: some are within a block."""
    reads = load(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey") * 500)
    return selection.read_cap(reads, "ordinal", 1).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("reads"), F.max("ordinal").alias("last"))


READ_CAP = "SELECT o_orderstatus, count(*) AS reads, max(o_orderkey * 500) AS last FROM orders WHERE o_orderkey * 500 < 1048576 GROUP BY 1"


def depth_stability(spark, sf_dir):
    """Quantities of an order's lines as depths, less 10 and no less than 0."""
    depth = F.greatest(F.col("l_quantity").cast("bigint") - 10, F.lit(0))
    depths = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(depth).alias("depths"))
    return depths.select("l_orderkey", evidence.depth_stability("depths").alias("score"))


DEPTH_STABILITY = """WITH d AS (SELECT l_orderkey, greatest(l_quantity::BIGINT - 10, 0) AS d FROM lineitem),
m AS (SELECT l_orderkey, list(d ORDER BY d) FILTER (d > 0) AS v FROM d GROUP BY 1),
n AS (SELECT l_orderkey, v, v[len(v) // 2 + 1] AS m FROM m), o AS (SELECT l_orderkey, m, list_sort(list_transform(v, lambda x: abs(x - m))) AS w FROM n)
SELECT l_orderkey, coalesce(m * 100 // (w[len(w) // 2 + 1] + 1), 0)::BIGINT AS score FROM o"""


QUERIES = {
    "sibling_arms": (sibling_arms, SIBLINGS),
    "pair_rule": (pair_rule, PAIR_RULE),
    "accepted_rows": (accepted_rows, ACCEPTED),
    "hamming_neighbours": (hamming_neighbours, HAMMING),
    "column_identities": (column_identities, COLUMN_IDENTITY),
    "distinct_candidates": (distinct_candidates, DISTINCT_CANDIDATES),
    "group_transitions": (group_transitions, TRANSITIONS),
    "mate_links": (mate_links, MATE_LINKS),
    "status_enrichment": (status_enrichment, ENRICH),
    "reference_mean_lengths": (reference_mean_lengths, REFERENCE_LENGTHS),
    "mapping_qc": (mapping_qc, MAPPING_QC),
    "repeat_annotation": (repeat_annotation, ANNOTATION),
    "repeat_curation": (repeat_curation, CURATION),
    "divergence_bins": (divergence_bins, DIVERGENCE),
    "informative_columns": (informative_columns, INFORMATIVE),
    "bounded_stacks": (bounded_stacks, STACKS),
    "even_sample": (even_sample, EVEN),
    "read_ledger": (read_ledger, LEDGER),
    "site_subset": (site_subset, SUBSET),
    "mean_and_hinges": (mean_and_hinges, HINGES),
    "names_and_ids": (names_and_ids, NAMES),
    "sequence_slices": (sequence_slices, SLICES),
    "pileup_insertions": (pileup_insertions, INSERTIONS),
    "sample_statistics": (sample_statistics, SAMPLE_STATS),
    "back_translation": (back_translation, BACK_TRANSLATION),
    "alignment_qc": (alignment_qc, ALIGNMENT_QC),
    "cohort_smallest_hashes": (cohort_smallest_hashes, COHORT_HASHES),
    "largest_components": (largest_components, LARGEST_COMPONENTS),
    "read_cap": (read_cap, READ_CAP),
    "depth_stability": (depth_stability, DEPTH_STABILITY),
}
