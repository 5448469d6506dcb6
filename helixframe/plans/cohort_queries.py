"""Queries of selection, similarity, consensus, cohort tables and variant sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.sequences import IUPAC_OF
from helixframe.operators import cohort, evidence, graph, population, selection
from helixframe.operators.tables import stored
from helixframe.plans.fixtures import FRAGMENTS, fragments, load, sql_windows

LENGTH = 150.0


def _sketches(spark, sf_dir):
    return evidence.minimizer_sketches(fragments(spark, sf_dir), "frag", "seq", 15, 10)


def near_duplicate_pairs(spark, sf_dir):
    """Each text: its class (the least text that links reach), the least text with an equal sketch, its links.  A text
    without a sketch is alone."""
    found = graph.similarity_links(_sketches(spark, sf_dir), "frag", "sketch", 0.8)
    found = found.select(F.col("id").alias("frag"), F.col("component").alias("class_id"), F.col("rep").alias("representative"), "links")
    short = fragments(spark, sf_dir).where(F.coalesce(F.length("seq"), F.lit(0)) < 15)
    return found.unionByName(short.select("frag", F.col("frag").alias("class_id"), F.col("frag").alias("representative"), F.lit(0).cast("bigint").alias("links")))


PAIRS = f"""WITH RECURSIVE {FRAGMENTS}, {sql_windows('w', 'fragments', 'frag', 'seq', 15)},
m AS (SELECT frag, pos, min(kmer) OVER (PARTITION BY frag ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (PARTITION BY frag) AS n FROM w),
s AS (SELECT DISTINCT frag, m FROM m WHERE pos <= greatest(n - 10, 0)),
few AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
size AS (SELECT frag, count(*) AS n FROM s GROUP BY frag),
cand AS (SELECT DISTINCT x.frag AS a, y.frag AS b FROM s x JOIN few USING (m) JOIN s y USING (m) WHERE x.frag < y.frag),
shared AS (SELECT a, b, count(*) AS k FROM cand JOIN s x ON x.frag = a JOIN s y ON y.frag = b AND x.m = y.m GROUP BY a, b),
pairs AS (SELECT a, b, k::DOUBLE / (p.n + q.n - k) AS jaccard FROM shared JOIN size p ON p.frag = a JOIN size q ON q.frag = b WHERE k::DOUBLE / (p.n + q.n - k) >= 0.8)"""
COMPONENTS = f"""{PAIRS}, arcs AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM arcs UNION SELECT reach.node, arcs.b FROM reach JOIN arcs ON arcs.a = reach.other),
labels AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
NEAR_PAIRS = f"""{COMPONENTS},
alike AS (SELECT frag, min(frag) OVER (PARTITION BY sketch) AS rep FROM (SELECT frag, list(m ORDER BY m) AS sketch FROM s GROUP BY frag)),
links AS (SELECT a, count(*) AS links FROM arcs GROUP BY a)
SELECT frag, coalesce(component, frag) AS class_id, coalesce(rep, frag) AS representative, coalesce(links, 0) AS links FROM fragments LEFT JOIN alike USING (frag) LEFT JOIN labels ON node = frag LEFT JOIN links ON a = frag"""
COMPONENTS = f"{COMPONENTS} SELECT node, component FROM labels"


def similarity_components(spark, sf_dir):
    """Each text that is linked to another one, and its class."""
    found, _ = graph.similarity_classes(_sketches(spark, sf_dir), "frag", "sketch", 0.8)
    found = stored(found)
    linked = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(linked, "component", "left_semi").select(F.col("id").alias("node"), "component")


def hash_topk_per_sample(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5(F.col("doc_id").cast("string")).alias("hash"))
    return selection.smallest_hashes(docs, "source", "hash", 60, "lang").select("doc_id", "source", "hash")


HASH_TOPK = """WITH d AS (SELECT doc_id, source, lang, md5(doc_id::VARCHAR) AS hash, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS n FROM documents),
s AS (SELECT lang, count(DISTINCT source) AS samples FROM documents GROUP BY lang)
SELECT doc_id, source, hash FROM d JOIN s USING (lang) WHERE n <= greatest(60 // samples, 1)"""


def run_islands(spark, sf_dir):
    runs = evidence.islands(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.sum((F.col("length") > 1).cast("bigint")).alias("repeated"))


ISLANDS = """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
i AS (SELECT user_id, event_type, g, count(*) AS length FROM r GROUP BY ALL)
SELECT user_id, count(*) AS runs, max(length) AS longest, sum((length > 1)::BIGINT)::BIGINT AS repeated FROM i GROUP BY user_id"""


def interval_support(spark, sf_dir):
    ts = F.unix_timestamp("ts").cast("bigint")
    reads = load(spark, sf_dir, "events").select("user_id", ts.alias("start"), (ts + F.floor(F.coalesce("value", F.lit(0.0)) * 60).cast("bigint") + 1).alias("end"))
    return evidence.interval_support(reads, ["user_id"], "start", "end").withColumn("breadth", F.round("breadth", 9))


INTERVALS = """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + floor(coalesce(value, 0) * 60)::BIGINT + 1 AS b FROM events),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o),
m AS (SELECT user_id, g, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY ALL),
x AS (SELECT *, a - lag(b) OVER (PARTITION BY user_id ORDER BY a) AS gap FROM m)
SELECT user_id, sum(n)::BIGINT AS reads, sum(b - a)::BIGINT AS supported, (max(b) - min(a))::BIGINT AS extent, coalesce(max(gap), 0)::BIGINT AS max_gap, count(*) AS islands,
round(sum(b - a) / (max(b) - min(a)), 9)::DOUBLE AS breadth FROM x GROUP BY user_id"""


def covered_bins(spark, sf_dir):
    start = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 900
    hits = load(spark, sf_dir, "lineitem").select("l_suppkey", evidence.bin_mask(start, start + F.col("l_linenumber") * 15, F.lit(1000)).alias("mask"))
    return evidence.covered_bins(hits.where("mask IS NOT NULL"), ["l_suppkey"], "mask")


BINS = """WITH h AS (SELECT l_suppkey, (l_orderkey * 7 + l_linenumber * 13) % 900 AS a, l_linenumber * 15 AS n FROM lineitem),
b AS (SELECT l_suppkey, unnest(range((a * 64) // 1000, least(((a + n - 1) * 64) // 1000, 63) + 1)) AS bin FROM h)
SELECT l_suppkey, count(DISTINCT bin) AS covered_bins, (SELECT count(*) FROM h WHERE h.l_suppkey = b.l_suppkey) AS n FROM b GROUP BY l_suppkey"""


def _candidates(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    left = F.when(F.col("l_returnflag") == "A", F.col("l_partkey") % 40).otherwise(0)
    right = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey") % 40).otherwise(0)
    bin_ = (F.col("l_partkey") % 64).cast("int")
    return l.select(
        F.col("l_suppkey").alias("locus"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_quantity") * 10).cast("bigint").alias("bases"),
        (31 + F.col("l_partkey") % 70).alias("max_exact"),
        (1 + F.col("l_linenumber") % 2).alias("locus_count"),
        (1 + F.col("l_orderkey") % 2).alias("mates"),
        left.alias("left_extension"),
        right.alias("right_extension"),
        (F.when(left > 0, 1).otherwise(0) + F.when(right > 0, 2).otherwise(0)).alias("terminal_mask"),
        F.expr("shiftleft(1L, cast(l_partkey % 64 as int))").alias("covered_bins"),
        bin_.alias("bin"),
    )


SQL_CANDIDATES = """c AS (SELECT l_suppkey AS locus, l_orderkey * 8 + l_linenumber AS id, (l_quantity * 10)::BIGINT AS bases, 31 + l_partkey % 70 AS max_exact, 1 + l_linenumber % 2 AS locus_count,
1 + l_orderkey % 2 AS mates, CASE WHEN l_returnflag = 'A' THEN l_partkey % 40 ELSE 0 END AS lx, CASE WHEN l_returnflag = 'R' THEN l_orderkey % 40 ELSE 0 END AS rx, l_partkey % 64 AS bin FROM lineitem)"""


def select_auto_budget(spark, sf_dir):
    found = selection.select_auto(_candidates(spark, sf_dir), LENGTH).where("selected")
    return found.groupBy("locus", "mode", "target").agg(F.count(F.lit(1)).alias("selected"), F.sum("id").alias("ids"), F.sum(F.col("terminal_mask").bitwiseAND(1)).cast("bigint").alias("left_terminal"), F.sum(F.shiftright("terminal_mask", 1)).cast("bigint").alias("right_terminal"))


_Q = "locus_count, max_exact DESC, mates DESC, id"
AUTO = f"""WITH {SQL_CANDIDATES},
t AS (SELECT locus, count(*) AS n, sum(bases) AS bases, count(DISTINCT bin) AS bins FROM c GROUP BY locus),
g AS (SELECT locus, n, CASE WHEN n < 512 OR bases / {LENGTH} <= 160 OR bins < 48 THEN 'pass_through' ELSE 'core' END AS mode,
      least(greatest(ceil({80 * LENGTH} / (bases / n)), 512, ceil(n * 3 / 5)), n)::BIGINT AS core FROM t),
a AS (SELECT c.*, mode, CASE WHEN mode = 'core' THEN core ELSE n END AS target FROM c JOIN g USING (locus)),
l1 AS (SELECT *, lx > 0 AND row_number() OVER (PARTITION BY locus, lx > 0, lx ORDER BY {_Q}) <= 4 AS l, rx > 0 AND row_number() OVER (PARTITION BY locus, rx > 0, rx ORDER BY {_Q}) <= 4 AS r FROM a),
l2 AS (SELECT * REPLACE (l AND row_number() OVER (PARTITION BY locus, l ORDER BY lx DESC, {_Q}) <= 768 AS l, r AND row_number() OVER (PARTITION BY locus, r ORDER BY rx DESC, {_Q}) <= 768 AS r),
       row_number() OVER (PARTITION BY locus, bin ORDER BY {_Q}) <= greatest(ceil(target / 64), 1) AS q FROM l1),
k AS (SELECT *, q AND row_number() OVER (PARTITION BY locus, q ORDER BY {_Q}) <= target AS core FROM l2),
f AS (SELECT *, NOT (core OR l OR r) AS rest, sum(core::INT) OVER (PARTITION BY locus) AS done FROM k),
s AS (SELECT *, mode = 'pass_through' OR l OR r OR core OR (rest AND row_number() OVER (PARTITION BY locus, rest ORDER BY {_Q}) <= target - done) AS selected FROM f)
SELECT locus, mode, target::BIGINT AS target, count(*) AS selected, sum(id)::BIGINT AS ids, sum((lx > 0)::INT)::BIGINT AS left_terminal, sum((rx > 0)::INT)::BIGINT AS right_terminal FROM s WHERE selected GROUP BY ALL"""


def thin_every_n(spark, sf_dir):
    return selection.thin_every_n(_candidates(spark, sf_dir), ["locus"], ["id"], 7).select("locus", "id")


THIN = f"WITH {SQL_CANDIDATES}, n AS (SELECT locus, id, row_number() OVER (PARTITION BY locus ORDER BY id) AS n FROM c) SELECT locus, id FROM n WHERE n % 7 = 0"


def legacy_selection(spark, sf_dir):
    """0 stands for no limit and no thinning."""
    return selection.legacy_decisions(_candidates(spark, sf_dir), 100.0, 31, 50, 200, 6).na.fill(0)


_DEEP, _LARGE = "total / 100.0 > 200", "total // 1000000 > 6"
LEGACY = f"""WITH RECURSIVE {SQL_CANDIDATES}, a AS (SELECT locus, sum(bases)::BIGINT AS total FROM c GROUP BY locus),
h AS (SELECT locus, k, coalesce(sum(bases) FILTER (max_exact >= k), 0)::BIGINT AS longer FROM c, (SELECT unnest(range(31, 71)) AS k) GROUP BY ALL),
w AS (SELECT locus, 31::BIGINT AS k, total, FALSE AS stop FROM a UNION ALL
SELECT w.locus, CASE WHEN longer / 100.0 < 50 THEN w.k ELSE h.k END, CASE WHEN longer / 100.0 < 50 THEN total ELSE longer END, longer / 100.0 < 50
FROM w JOIN h ON h.locus = w.locus AND h.k = w.k + CASE WHEN total / 100.0 > 1600 OR total // 1000000 > 36 THEN 6 ELSE 2 END WHERE NOT stop AND w.k < 64 AND ({_DEEP} OR {_LARGE})),
z AS (SELECT locus, max(k) AS k, arg_max(total, k) AS total FROM w GROUP BY locus)
SELECT locus, CASE WHEN z.k > 31 OR z.{_LARGE} THEN z.k ELSE 0 END AS minimum_exact, CASE WHEN z.{_LARGE} THEN greatest(trunc(z.total / 6e6), 2)::BIGINT ELSE 0 END AS thinning_interval,
CASE WHEN z.k > 31 OR z.{_LARGE} THEN z.total ELSE a.total END AS total_bases FROM z JOIN a USING (locus)"""


_BASES = {"view": "A", "click": "C", "purchase": "G", "signup": "T", "error": "-"}


def threshold_consensus(spark, sf_dir):
    base = F.create_map(*[F.lit(x) for p in _BASES.items() for x in p])[F.col("event_type")]
    piles = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 997).alias("position"), base.alias("base")).agg(F.count(F.lit(1)).alias("n"))
    return cohort.threshold_consensus(piles, ["position"], "base", "n", 0.6)


_CODE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IUPAC_OF.items())
CONSENSUS = f"""WITH p AS (SELECT user_id % 997 AS position, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BASES.items())} END AS base, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY position) AS coverage, sum(n) OVER (PARTITION BY position ORDER BY n DESC RANGE UNBOUNDED PRECEDING) - sum(n) OVER (PARTITION BY position, n) AS before FROM p),
t AS (SELECT position, coverage, string_agg(base, '' ORDER BY base) AS bases, replace(string_agg(base, '' ORDER BY base), '-', '') AS letters FROM r WHERE before < coverage * 0.6 GROUP BY ALL)
SELECT position, coverage::BIGINT AS coverage, bases, CASE WHEN letters = '' THEN '-' WHEN bases <> letters THEN lower(CASE letters {_CODE} END) ELSE CASE letters {_CODE} END END AS code FROM t"""


def _sites(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), (1 - F.col("l_discount")).alias("call_rate"), (F.col("l_tax") * 100).cast("int").alias("gq"), F.col("l_quantity").alias("dp"), F.col("l_extendedprice").alias("qual"))


def one_site_per_locus(spark, sf_dir):
    return population.one_site_per_locus(_sites(spark, sf_dir), "locus").select("locus", "position", "candidate_snp_count")


ONE_SITE = """WITH s AS (SELECT l_partkey AS locus, l_orderkey * 8 + l_linenumber AS position, 1 - l_discount AS call_rate, trunc(l_tax * 100)::INT AS gq, l_quantity AS dp, l_extendedprice AS qual,
median(l_quantity) OVER (PARTITION BY l_partkey) AS m, count(*) OVER (PARTITION BY l_partkey) AS candidate_snp_count FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY call_rate DESC, gq DESC, abs(dp - m), qual DESC, position) AS n FROM s)
SELECT locus, position, candidate_snp_count FROM r WHERE n = 1"""


def genotype_site_filter(spark, sf_dir):
    gt = F.when(F.col("l_returnflag") == "A", "0/0").when(F.col("l_returnflag") == "R", "1/1").when(F.col("l_linestatus") == "O", "0/1").otherwise("./.")
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.struct(gt.alias("gt"), F.col("l_quantity").cast("int").alias("dp"), (F.col("l_tax") * 1000).cast("int").alias("gq")).alias("g"), "l_extendedprice")
    sites = rows.groupBy(F.col("l_partkey").alias("locus")).agg(F.collect_list("g").alias("genotypes"), F.max("l_extendedprice").alias("qual"))
    return population.site_filter(sites, F.col("genotypes"), 5, 10, 0.4, 30000.0, 3).select("locus", "samples", "missing", "an", "ac")


SITE_FILTER = """WITH g AS (SELECT l_partkey AS locus, l_extendedprice AS qual, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 1 END AS alt,
trunc(l_quantity)::INT >= 5 AND trunc(l_tax * 1000)::INT >= 10 AS good FROM lineitem),
s AS (SELECT locus, max(qual) AS qual, count(*) AS samples, count(*) FILTER (good AND alt IS NOT NULL) AS called, coalesce(sum(alt) FILTER (good), 0) AS ac FROM g GROUP BY locus)
SELECT locus, samples::INT AS samples, (samples - called)::INT AS missing, (2 * called)::INT AS an, ac::INT AS ac FROM s
WHERE (samples - called) / samples <= 0.4 AND qual >= 30000 AND called > 0 AND least(ac, 2 * called - ac) >= 3"""


def sample_locus_matrix(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_returnflag", F.col("l_quantity").cast("bigint").alias("length"))
    return cohort.matrix(rows, "sample", "l_returnflag", "length", ["A", "N", "R"])


MATRIX = """SELECT l_suppkey AS sample, coalesce(max(l_quantity) FILTER (l_returnflag = 'A'), 0)::BIGINT AS "A", coalesce(max(l_quantity) FILTER (l_returnflag = 'N'), 0)::BIGINT AS "N",
coalesce(max(l_quantity) FILTER (l_returnflag = 'R'), 0)::BIGINT AS "R" FROM lineitem GROUP BY l_suppkey"""


def _families(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("family"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("length"))


def family_state(spark, sf_dir):
    rows = _families(spark, sf_dir)
    return cohort.family_states(rows, load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample")).distinct(), "family", "sample")


FAMILY = """WITH n AS (SELECT count(DISTINCT s_suppkey) AS n FROM supplier),
c AS (SELECT l_partkey AS family, l_suppkey AS sample, count(*) AS k FROM lineitem GROUP BY ALL),
f AS (SELECT family, count(*) FILTER (k = 1) AS one_candidate_samples, count(*) FILTER (k > 1) AS multiple_candidate_samples FROM c GROUP BY family)
SELECT family, one_candidate_samples, multiple_candidate_samples, n - one_candidate_samples - multiple_candidate_samples AS not_recovered_samples,
CASE WHEN multiple_candidate_samples > 0 THEN 'multiple_candidate_family' WHEN one_candidate_samples >= ceil(0.7 * n) THEN 'single_candidate_family' ELSE 'uncertain_family' END AS family_state FROM f, n"""


def occupancy_qc(spark, sf_dir):
    return cohort.occupancy(_families(spark, sf_dir), "family", "sample", "length", 25)


OCCUPANCY = """SELECT l_partkey AS family, count(*) AS input_candidates, count(DISTINCT l_suppkey) AS distinct_samples, median(l_quantity) AS median_sequence_length,
CASE WHEN count(DISTINCT l_suppkey) >= 25 THEN 'retained' ELSE 'insufficient_occupancy' END AS status FROM lineitem GROUP BY 1"""


def supermatrix(spark, sf_dir):
    """Nations as species, balance classes of suppliers as loci: not each nation has a supplier of each class."""
    locus = F.concat(F.lit("L"), F.floor(F.col("s_acctbal") / 2500).cast("string"))
    rows = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("species"), locus.alias("locus")).agg(F.min("s_suppkey").alias("k"))
    rows = rows.select("species", "locus", F.repeat(F.md5(F.col("k").cast("string")), (F.length("locus") - 1).cast("int")).alias("seq"))
    return cohort.supermatrix(rows, "species", "locus", "seq").withColumn("length", F.col("length").cast("bigint"))


SUPERMATRIX = """WITH a AS (SELECT s_nationkey AS species, 'L' || floor(s_acctbal / 2500)::BIGINT AS locus, min(s_suppkey) AS k FROM supplier GROUP BY ALL),
r AS (SELECT species, locus, repeat(md5(k::VARCHAR), length(locus) - 1) AS seq FROM a), l AS (SELECT locus, max(length(seq)) AS n FROM r GROUP BY locus),
g AS (SELECT s.species, l.locus, l.n, r.seq FROM (SELECT DISTINCT species FROM r) s CROSS JOIN l LEFT JOIN r ON r.species = s.species AND r.locus = l.locus)
SELECT species, string_agg(rpad(coalesce(seq, ''), n::INT, '-'), '' ORDER BY locus) AS sequence, count(seq) AS loci, sum(n)::BIGINT AS length FROM g GROUP BY species"""


def _states(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    effective = e.groupBy((F.col("user_id") % 25).alias("sample")).agg(F.count(F.lit(1)).alias("effective"))
    counts = e.groupBy((F.col("user_id") % 25).alias("sample"), "event_type").agg(F.sum((F.col("value") >= 20).cast("bigint")).alias("specific"), F.sum((F.coalesce("value", F.lit(0.0)) < 20).cast("bigint")).alias("ambiguous"))
    found = counts.withColumn("specific", F.coalesce("specific", F.lit(0))).join(effective, "sample")
    return found.withColumns({"taxon": F.col("sample") % 5, "rpm": cohort.rpm(F.col("specific"), F.col("effective")), "state": cohort.presence(F.col("effective"), F.col("specific"), F.col("ambiguous"))})


SQL_STATES = """n AS (SELECT user_id % 25 AS sample, count(*) AS effective FROM events GROUP BY 1),
c AS (SELECT user_id % 25 AS sample, event_type, count(*) FILTER (value >= 20) AS specific, count(*) FILTER (coalesce(value, 0) < 20) AS ambiguous FROM events GROUP BY ALL),
st AS (SELECT *, sample % 5 AS taxon, specific * 1e6 / effective AS rpm, CASE WHEN effective < 100 THEN 'NA' WHEN specific >= 3 AND specific / (specific + ambiguous) >= 0.7 THEN 'PRESENT' WHEN specific = 0 THEN 'ABSENT' ELSE 'NA' END AS state FROM c JOIN n USING (sample))"""


def state_rpm_taxon(spark, sf_dir):
    return cohort.taxon_summary(_states(spark, sf_dir), "taxon", "event_type").withColumn("median_rpm", F.round("median_rpm", 6))


STATE_RPM = f"""WITH {SQL_STATES} SELECT taxon, event_type, round(list_sort(list(rpm))[(count(*) // 2 + 1)::INT], 6)::DOUBLE AS median_rpm, sum((state = 'PRESENT')::BIGINT)::BIGINT AS present, count(*) AS samples,
CASE WHEN sum((state = 'PRESENT')::BIGINT) * 2 > count(*) THEN 'PRESENT' ELSE 'ABSENT' END AS state FROM st GROUP BY taxon, event_type"""


def family_compare(spark, sf_dir):
    return cohort.family_sharing(_states(spark, sf_dir).where("state = 'PRESENT'"), "event_type", "sample", "taxon")


COMPARE = f"""WITH {SQL_STATES} SELECT event_type, count(DISTINCT sample) AS samples, count(DISTINCT taxon) AS taxa,
CASE WHEN count(DISTINCT taxon) > 1 THEN 'shared' WHEN count(DISTINCT sample) > 1 THEN 'taxon_shared' ELSE 'sample_specific' END AS shared_state FROM st WHERE state = 'PRESENT' GROUP BY event_type"""


def reference_contribution(spark, sf_dir):
    samples = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"))
    found = cohort.contribution(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample")), samples, "sample")
    return found.withColumn("reference_fraction", F.round("reference_fraction", 12))


CONTRIBUTION = "SELECT c_custkey AS sample, count(o_orderkey) AS reference_loci, round(count(o_orderkey) / (SELECT count(*) FROM orders), 12)::DOUBLE AS reference_fraction FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def rescue_before_after(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    side = lambda odd: o.where(F.col("year") % 2 == odd).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("length"), F.max("o_totalprice").alias("density"), F.max((F.col("o_orderstatus") == "F").cast("int")).cast("boolean").alias("accepted"))
    return cohort.before_after(side(0), side(1), "o_custkey").groupBy("rescue_status").agg(F.count(F.lit(1)).alias("n"), F.sum("length_delta").alias("length_delta"))


RESCUE = """WITH o AS (SELECT *, year(o_orderdate) % 2 AS odd FROM orders),
s AS (SELECT o_custkey, odd, count(*) AS length, max(o_totalprice) AS density, bool_or(o_orderstatus = 'F') AS accepted FROM o GROUP BY ALL),
j AS (SELECT coalesce(b.o_custkey, a.o_custkey) AS k, b.length AS bl, a.length AS al, b.density AS bd, a.density AS ad, a.accepted AS ok FROM (SELECT * FROM s WHERE odd = 0) b FULL JOIN (SELECT * FROM s WHERE odd = 1) a ON a.o_custkey = b.o_custkey)
SELECT CASE WHEN al IS NULL THEN 'inactive' WHEN NOT ok THEN 'reverted_not_accepted' WHEN ad < bd * 0.5 THEN 'reverted_low_density' WHEN bl IS NULL THEN 'recovered' WHEN al > bl THEN 'extended' ELSE 'unchanged' END AS rescue_status,
count(*) AS n, sum(coalesce(al, 0) - coalesce(bl, 0))::BIGINT AS length_delta FROM j GROUP BY 1"""


def edit_distance_blocks(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return graph.edit_pairs(p, "p_partkey", "p_name", ["p_brand", "p_size"], 12)


EDIT = "SELECT x.p_partkey AS a, y.p_partkey AS b, levenshtein(x.p_name, y.p_name)::INT AS distance FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey WHERE levenshtein(x.p_name, y.p_name) <= 12"


def pca_embeddings(spark, sf_dir):
    found = population.principal_components(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 10)
    return found.drop("embedding").select("vec_id", *[F.round(f"pc{i + 1}", 6).alias(f"pc{i + 1}") for i in range(10)])


QUERIES = {
    "near_duplicate_pairs": (near_duplicate_pairs, NEAR_PAIRS),
    "similarity_components": (similarity_components, COMPONENTS),
    "hash_topk_per_sample": (hash_topk_per_sample, HASH_TOPK),
    "run_islands": (run_islands, ISLANDS),
    "interval_support": (interval_support, INTERVALS),
    "covered_bins": (covered_bins, BINS),
    "select_auto_budget": (select_auto_budget, AUTO),
    "thin_every_n": (thin_every_n, THIN),
    "legacy_selection": (legacy_selection, LEGACY),
    "threshold_consensus": (threshold_consensus, CONSENSUS),
    "one_site_per_locus": (one_site_per_locus, ONE_SITE),
    "genotype_site_filter": (genotype_site_filter, SITE_FILTER),
    "sample_locus_matrix": (sample_locus_matrix, MATRIX),
    "family_state": (family_state, FAMILY),
    "occupancy_qc": (occupancy_qc, OCCUPANCY),
    "supermatrix": (supermatrix, SUPERMATRIX),
    "state_rpm_taxon": (state_rpm_taxon, STATE_RPM),
    "family_compare": (family_compare, COMPARE),
    "reference_contribution": (reference_contribution, CONTRIBUTION),
    "rescue_before_after": (rescue_before_after, RESCUE),
    "edit_distance_blocks": (edit_distance_blocks, EDIT),
    "pca_embeddings": (pca_embeddings, None),
}
