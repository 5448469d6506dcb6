"""Cohort tables: consensus, family states, occupancy, matrices, stats, shares, before/after audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import iupac_of, upper_median

#: Presence of a family in a sample: fewer effective pairs say nothing; so many specific ones, and of this share.
LEAST_PAIRS, LEAST_SPECIFIC, LEAST_SHARE = 100, 3, 0.7
SINGLE_SHARE = (7, 10)


def threshold_consensus(pileup: DataFrame, keys: list[str], base: str, n: str, threshold: float) -> DataFrame:
    """keys, coverage, bases, code: whole groups of equal counts, the highest first, until they reach the threshold.

    A set with the gap gives the others' code in lower case; the gap alone gives -.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(n)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = pileup.withColumns({"coverage": F.sum(n).over(w), "__before": F.sum(n).over(order) - F.sum(n).over(Window.partitionBy(*keys, n))})
    taken = found.where(F.col("__before") < F.col("coverage") * threshold)
    sets = taken.groupBy(*keys, "coverage").agg(F.sort_array(F.collect_set(base)).alias("bases"))
    letters = F.filter("bases", lambda b: b != "-")
    code = F.when(F.size(letters) == 0, "-").when(F.array_contains("bases", "-"), F.lower(iupac_of(letters))).otherwise(iupac_of(letters))
    return sets.select(*keys, "coverage", F.array_join("bases", "").alias("bases"), code.alias("code"))


def pileup(alignments: DataFrame, ref: str, pos: str, cigar_ops: str, seq: str, most_deletion: int = 150) -> DataFrame:
    """ref, position, base, n from alignments with an array of (length, op); deleted bases count as -, unless the
    alignment has a deletion or skip over most_deletion, and insertions are left to `insertions`."""
    spans = _spans(cigar_ops, pos)
    long_gap = F.exists(cigar_ops, lambda o: o["op"].isin("D", "N") & (o["length"] > most_deletion))
    rows = alignments.select(ref, seq, long_gap.alias("__long"), F.explode(spans).alias("s")).where(F.col("s.op").isin("M", "=", "X") | (F.col("s.op").isin("D", "N") & ~F.col("__long")))
    bases = rows.select(ref, seq, "s", F.explode(F.sequence(F.lit(0), F.col("s.length") - 1)).alias("i"))
    base = F.when(F.col("s.op").isin("D", "N"), "-").otherwise(F.upper(F.substring(F.col(seq), F.col("s.q") + F.col("i") + 1, F.lit(1))))
    return bases.select(ref, (F.col("s.r") + F.col("i")).alias("position"), F.when(base.isin("A", "C", "G", "T", "-"), base).otherwise("N").alias("base")).groupBy(ref, "position", "base").agg(F.count(F.lit(1)).alias("n"))


def insertions(alignments: DataFrame, piles: DataFrame, ref: str, pos: str, cigar_ops: str, seq: str) -> DataFrame:
    """ref, position, column, base, n: the columns inserted after a reference position (-1: before the first), each with
    the bases of the alignments that have it; `-` counts the rest of the coverage there, the sum of the piles of the
    position (of the nearest end for one outside)."""
    spans = alignments.select(ref, seq, F.explode(_spans(cigar_ops, pos)).alias("s")).where("s.op = 'I'")
    columns = spans.select(ref, seq, "s", F.explode(F.sequence(F.lit(0), F.col("s.length") - 1)).alias("column"))
    base = F.upper(F.substring(F.col(seq), F.col("s.q") + F.col("column") + 1, F.lit(1)))
    found = columns.select(ref, (F.col("s.r") - 1).alias("position"), "column", F.when(base.isin("A", "C", "G", "T"), base).otherwise("N").alias("base"))
    counts = found.groupBy(ref, "position", "column", "base").agg(F.count(F.lit(1)).alias("n"))
    observed = counts.groupBy(ref, "position", "column").agg(F.sum("n").alias("__seen"))
    coverage = piles.groupBy(ref, "position").agg(F.sum("n").alias("__coverage"))
    ends = coverage.groupBy(ref).agg(F.max("position").alias("__last"))
    at = F.least(F.greatest("position", F.lit(0)), "__last")
    sides = observed.join(ends, ref).withColumn("__at", at).join(coverage.withColumnRenamed("position", "__at"), [ref, "__at"], "left")
    rest = sides.select(ref, "position", "column", F.lit("-").alias("base"), (F.coalesce("__coverage", F.lit(0)) - F.col("__seen")).alias("n")).where("n > 0")
    return counts.unionByName(rest)


def _spans(cigar_ops: str, pos: str) -> Column:
    """(r, q, length, op) of each operation: where it begins in the reference and in the read."""
    return F.aggregate(
        cigar_ops,
        F.struct(F.col(pos).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,length:int,op:string>>").alias("out")),
        lambda a, o: F.struct(
            (a["r"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["length"]).otherwise(0)).alias("r"),
            (a["q"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["length"]).otherwise(0)).alias("q"),
            F.array_append(a["out"], F.struct(a["r"].alias("r"), a["q"].alias("q"), o["length"].alias("length"), o["op"].alias("op"))).alias("out"),
        ),
        lambda a: a["out"],
    )


def presence(effective: Column, specific: Column, ambiguous: Column) -> Column:
    """PRESENT, ABSENT or NA."""
    share = specific / (specific + ambiguous)
    return F.when(effective < LEAST_PAIRS, "NA").when((specific >= LEAST_SPECIFIC) & (share >= LEAST_SHARE), "PRESENT").when(specific == 0, "ABSENT").otherwise("NA")


def rpm(specific: Column, effective: Column) -> Column:
    return F.when(effective > 0, specific * 1e6 / effective).otherwise(F.lit(0.0))


def taxon_summary(states: DataFrame, taxon: str, group: str) -> DataFrame:
    """taxon, group, median_rpm (the upper median), present, samples, state (by majority of the samples)."""
    found = states.groupBy(taxon, group).agg(upper_median(F.collect_list("rpm")).alias("median_rpm"), F.sum((F.col("state") == "PRESENT").cast("bigint")).alias("present"), F.count(F.lit(1)).alias("samples"))
    return found.withColumn("state", F.when(F.col("present") * 2 > F.col("samples"), "PRESENT").otherwise("ABSENT"))


def family_sharing(states: DataFrame, family: str, sample: str, taxon: str) -> DataFrame:
    """family, samples, taxa, shared_state from rows of families present in samples."""
    found = states.groupBy(family).agg(F.countDistinct(sample).alias("samples"), F.countDistinct(taxon).alias("taxa"))
    return found.withColumn("shared_state", F.when(F.col("taxa") > 1, "shared").when(F.col("samples") > 1, "taxon_shared").otherwise("sample_specific"))


def family_states(candidates: DataFrame, samples: DataFrame, family: str, sample: str) -> DataFrame:
    """family, one, multiple, missing and family_state; single needs one candidate in 7 of 10 samples, rounded up."""
    n = samples.count()
    counts = candidates.groupBy(family, sample).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(family).agg(F.sum((F.col("n") == 1).cast("bigint")).alias("one_candidate_samples"), F.sum((F.col("n") > 1).cast("bigint")).alias("multiple_candidate_samples"))
    needed = -(-SINGLE_SHARE[0] * n // SINGLE_SHARE[1])
    state = F.when(F.col("multiple_candidate_samples") > 0, "multiple_candidate_family").when(F.col("one_candidate_samples") >= needed, "single_candidate_family").otherwise("uncertain_family")
    return found.withColumn("not_recovered_samples", F.lit(n) - F.col("one_candidate_samples") - F.col("multiple_candidate_samples")).withColumn("family_state", state)


def occupancy(candidates: DataFrame, family: str, sample: str, length: str, least: int) -> DataFrame:
    """family, candidates, distinct_samples, median_sequence_length, status."""
    found = candidates.groupBy(family).agg(F.count(F.lit(1)).alias("input_candidates"), F.countDistinct(sample).alias("distinct_samples"), F.median(length).alias("median_sequence_length"))
    return found.withColumn("status", F.when(F.col("distinct_samples") >= least, "retained").otherwise("insufficient_occupancy"))


def matrix(df: DataFrame, sample: str, locus: str, value: str, loci: list[str]) -> DataFrame:
    """One row for each sample with the greatest value of each locus named; 0 where it has none."""
    return df.groupBy(sample).pivot(locus, loci).agg(F.max(value)).na.fill(0)


def supermatrix(alignments: DataFrame, species: str, locus: str, seq: str, missing: str = "-") -> DataFrame:
    """species, sequence (all loci by name, missing ones filled), loci (those it has), length."""
    lengths = alignments.groupBy(locus).agg(F.max(F.length(seq)).alias("__length"))
    grid = alignments.select(species).distinct().join(lengths)
    filled = grid.join(alignments.select(species, locus, F.col(seq).alias("__seq")), [species, locus], "left")
    part = F.struct(F.col(locus).alias("locus"), F.coalesce(F.rpad("__seq", F.col("__length"), missing), F.repeat(F.lit(missing), F.col("__length"))).alias("seq"))
    found = filled.groupBy(species).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["seq"]), "").alias("sequence"), F.count("__seq").alias("loci"))
    return found.withColumn("length", F.length("sequence"))


def partitions(alignments: DataFrame, locus: str, seq: str) -> DataFrame:
    """locus, start, end (1-based, inclusive) of each locus in the supermatrix."""
    lengths = alignments.groupBy(locus).agg(F.max(F.length(seq)).alias("__length"))
    upto = F.sum("__length").over(Window.orderBy(locus))  # one row for each locus
    return lengths.select(locus, (upto - F.col("__length") + 1).alias("start"), upto.alias("end"))


def contribution(references: DataFrame, samples: DataFrame, sample: str) -> DataFrame:
    """sample, reference_loci, reference_fraction; samples without references stay with 0."""
    counts = references.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    total = references.count()
    found = samples.join(counts, sample, "left").withColumn("reference_loci", F.coalesce("n", F.lit(0)))
    return found.select(sample, "reference_loci", (F.col("reference_loci") / F.lit(max(total, 1))).alias("reference_fraction"))


def before_after(before: DataFrame, after: DataFrame, key: str, least_density: float = 0.5) -> DataFrame:
    """key, rescue_status, before and after of (length, density, accepted): the first check that holds decides."""
    names = ("length", "density", "accepted")
    side = lambda df, name: df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in names])
    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    status = (
        F.when(F.col("after_length").isNull(), "inactive")
        .when(~F.coalesce("after_accepted", F.lit(False)), "reverted_not_accepted")
        .when(F.col("after_density") < F.col("before_density") * least_density, "reverted_low_density")
        .when(F.col("before_length").isNull(), "recovered")
        .when(F.col("after_length") > F.col("before_length"), "extended")
        .otherwise("unchanged")
    )
    return both.withColumn("rescue_status", status).withColumn("length_delta", F.coalesce("after_length", F.lit(0)) - F.coalesce("before_length", F.lit(0)))


def column_identity(a: Column, b: Column) -> Column:
    """(comparable, identity) of two aligned texts over columns that neither has as - or ?."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(~x.isin("-", "?", "") & ~y.isin("-", "?", ""), (x == y).cast("int")))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return F.struct(F.size(seen).alias("comparable"), (F.aggregate(seen, F.lit(0), lambda s, x: s + x) / F.size(seen)).alias("identity"))


def informative_columns(alignment: DataFrame, keys: list[str], seq: str, least: float = 0.5) -> DataFrame:
    """keys, column, informative for each column with at least `least` of its rows informative."""
    cells = alignment.select(*keys, F.posexplode(F.filter(F.split(seq, ""), lambda x: x != "")).alias("column", "base"))
    found = cells.groupBy(*keys, "column").agg(F.avg((~F.col("base").isin("-", "?", "N", "n", "X")).cast("double")).alias("informative"))
    return found.where(F.col("informative") >= least)


def alignment_qc(alignment: DataFrame, keys: list[str], seq: str, order: str, unit: int = 1) -> DataFrame:
    """keys, columns, effective, fraction of alignments in columns of `unit` letters (3: codons).

    A column is effective where half of the rows or more have letters alone there, none of them X.  Rows of unequal
    lengths, or lengths that are no multiple of unit, give no effective columns; their columns are those of the first row
    in `order`.  A null row is an empty one.
    """
    rows = alignment.select(*keys, F.col(order).alias("__order"), F.coalesce(seq, F.lit("")).alias("__seq"))
    length = F.length("__seq")
    sizes = rows.groupBy(*keys).agg(F.min_by(length, "__order").alias("__length"), (F.min(length) == F.max(length)).alias("__even"), F.count(F.lit(1)).alias("__rows"))
    cells = rows.select(*keys, F.posexplode(F.regexp_extract_all("__seq", F.lit(f"(?s)(.{{{unit}}})"), 1)).alias("__column", "__cell"))
    whole = cells.where(F.col("__cell").rlike("^[A-WYZa-z]+$")).groupBy(*keys, "__column").agg(F.count(F.lit(1)).alias("__whole"))
    effective = whole.join(sizes, keys).where(F.col("__whole") * 2 >= F.col("__rows")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    columns = F.floor(F.col("__length") / unit)
    n = F.when(F.col("__even") & (F.col("__length") % unit == 0), F.coalesce("__n", F.lit(0))).otherwise(F.lit(0))
    return sizes.join(effective, keys, "left").select(*keys, columns.alias("columns"), n.alias("effective"), F.when(columns > 0, n / columns).otherwise(0.0).alias("fraction"))


def sample_stats(rows: DataFrame, sample: str) -> DataFrame:
    """Per sample: loci, accepted, with reads, lengths' mean, median and sum of accepted ones."""
    good = F.when(F.col("accepted"), F.col("length"))
    return rows.groupBy(sample).agg(F.count(F.lit(1)).alias("loci"), F.count(good).alias("accepted_loci"), F.sum((F.col("reads") > 0).cast("bigint")).alias("loci_with_reads"), F.avg(good).alias("mean_length"), F.median(good).alias("median_length"), F.coalesce(F.sum(good), F.lit(0)).alias("total_length"))


def best_candidate(candidates: DataFrame, locus: str) -> DataFrame:
    """The best contig of each locus by nine keys in turn, the greater each time: supported bases damped by low density of
    unique reads, uneven depth and depth peaks (score); breadth; that density; the least share of its widest gap; length;
    unique reads; reads; flank balance; weight.  Of equals the least id."""
    density = F.when(F.col("length") > 0, F.col("unique_reads") / F.col("length")).otherwise(0.0)
    gap = F.when(F.col("length") > 0, F.col("max_gap") / F.col("length")).otherwise(1.0)
    score = F.col("supported") * F.least(F.lit(1.0), density / 0.01) * (1 / (1 + F.col("depth_cv"))) * F.least(F.lit(1.0), 10 / F.greatest(F.col("depth_ratio"), F.lit(1.0)))
    order = [F.desc("score"), F.desc("breadth"), density.desc(), gap.asc(), *map(F.desc, ("length", "unique_reads", "reads", "flank_balance", "weight")), F.col("id")]
    ranked = candidates.withColumn("score", score)
    return ranked.withColumn("__n", F.row_number().over(Window.partitionBy(locus).orderBy(*order))).where("__n = 1").drop("__n")


def population_reference(contigs: DataFrame, locus: str, strategy: str = "longest") -> DataFrame:
    """One accepted contig with unique reads for each locus, the longest, best supported or densest; with the number of
    those it was chosen from."""
    first = {"longest": "length", "supported": "supported", "density": "unique_density"}
    if strategy not in first:
        raise ValueError(f"unknown strategy {strategy}")
    usable = contigs.where(F.col("accepted") & (F.col("unique_reads") > 0))
    order = [F.desc(c) for c in dict.fromkeys([first[strategy], "length", "supported", "unique_reads"])] + [F.col("id")]
    ranked = usable.withColumns({"__n": F.row_number().over(Window.partitionBy(locus).orderBy(*order)), "candidate_count": F.count(F.lit(1)).over(Window.partitionBy(locus))})
    return ranked.where("__n = 1").drop("__n")


def minor_alleles(pileup_: DataFrame, keys: list[str], base: str, n: str) -> DataFrame:
    """keys, coverage, minor: the second count's share at positions with two bases or more."""
    counts = pileup_.where(~F.col(base).isin("-", "N")).groupBy(*keys).agg(F.sort_array(F.collect_list(n), asc=False).alias("c"), F.sum(n).alias("coverage"))
    return counts.where(F.size("c") > 1).select(*keys, "coverage", (F.get("c", F.lit(1)) / F.col("coverage")).alias("minor"))


def reference_lengths(refs: DataFrame, locus: str, seq: str) -> DataFrame:
    """locus, mean_length: the rounded mean length of its references without gaps and N."""
    return refs.groupBy(locus).agg(F.round(F.avg(F.length(F.regexp_replace(seq, "[-Nn]", "")))).cast("bigint").alias("mean_length"))


def exact_subset(sites: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of sites whose keys wanted has; an error unless each of wanted has exactly one."""
    found = sites.join(wanted.select(*keys).distinct(), keys, "left_semi")
    n, distinct, total = found.count(), found.select(*keys).distinct().count(), wanted.select(*keys).distinct().count()
    if not n == distinct == total:
        raise ValueError(f"{total} sites wanted, {n} rows of {distinct} sites found")
    return found


def enrich(df: DataFrame, tables: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """df with columns of other tables, each (table, key, column -> literal where it has no row)."""
    for other, key, defaults in tables:
        df = df.join(other.select(key, *defaults), key, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    return df


def distinct_candidates(candidates: DataFrame, keys: list[str], seq: str, id_: str, reference_length: str) -> DataFrame:
    """Candidates of a third of their reference's length, 40 bases at least, one for each sequence on either strand
    (the least id), without those that begin another of their keys."""
    from helixframe.functions.sequences import canonical

    long = candidates.where(F.length(seq) >= F.greatest(F.col(reference_length) / 3, F.lit(40)))
    one = long.withColumn("__c", canonical(seq)).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__c").orderBy(id_))).where("__n = 1").drop("__n", "__c")
    other = one.select(*keys, F.col(seq).alias("__longer"))
    inside = F.col("__longer").startswith(F.col(seq)) & (F.length("__longer") > F.length(seq))
    same = inside
    for k in keys:
        same = same & one[k].eqNullSafe(other[k])
    return one.join(other, same, "left_anti")
