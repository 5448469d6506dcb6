"""Assembly with mate pairs: two graphs of one count, branches supported by fragments, and a guard of the length.

The core graph has a locus' words (k-mers of both strands) that enough reads or a reference has.  The assisted graph has
also rarer words that lie on a mate beyond the reference while the other mate stands on it, in enough fragments, and its
branches are judged by the fragments that go over them.  Both are filters of one table of counts; both are searched in
the same rounds, as loci of their own.

An edge of the graph is a window of k + 1 bases, so what supports it is counted as words are: an aggregate over
(locus, window), joined with the windows at branches alone.  No group holds a locus' reads.

pairs: locus, frag, r1, r2, one row for each locus and frag.  A null mate is missing: what is left counts as a read and
is no fragment.  Windows with other letters than A, C, G and T are left out; a locus without a reference of k bases or
without reads on it has no row in results of contigs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import u_to_t
from helixframe.operators import recruit, search
from helixframe.operators.tables import dealt, shared, stored

#: Fragments that a rare word beyond the reference needs.
LEAST_FRAGMENTS = 2


def _mates(pairs: DataFrame, *columns: str) -> DataFrame:
    """locus, frag, mate (1 or 2), seq and columns."""
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("mate"), F.col(f"r{i}").alias("seq")) for i in (1, 2))))
    return pairs.select("locus", "frag", *columns, both.alias("m")).select("locus", "frag", *columns, "m.*").where("seq IS NOT NULL")


def anchored_pairs(pairs: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """Rows of pairs of which a mate has a word of its locus' reference (locus, seq), with on1 and on2: that mate has."""
    index = stored(recruit.reference_index(refs.withColumn("seq", u_to_t("seq")), "locus", "seq", k))
    words = recruit.seq_kmers(_mates(pairs), ["locus", "frag", "mate"], "seq", k, once=True)
    found = words.join(index, ["locus", "kmer"], "left_semi").groupBy("locus", "frag").agg(F.bit_or("mate").alias("on"))
    # A small table is broadcast, and pairs are not shuffled.
    return pairs.join(shared(stored(found)), ["locus", "frag"]).select("locus", "frag", "r1", "r2", (F.col("on").bitwiseAND(1) > 0).alias("on1"), (F.col("on").bitwiseAND(2) > 0).alias("on2"))


def _on(own: bool) -> Column:
    """Whether the mate of a row of _mates, or else the other one, stands on the reference."""
    return F.when((F.col("mate") == 1) == F.lit(own), F.col("on1")).otherwise(F.col("on2"))


def mate_words(anchored: DataFrame, k: int) -> DataFrame:
    """locus, word, depth, fragments: words of both strands, the reads that have them, and the fragments that have them
    on the one mate that is not on the reference."""
    reads = _mates(anchored, "on1", "on2").withColumn("beyond", _on(False) & ~_on(True))
    words = recruit.seq_kmers(reads, ["locus", "beyond"], "seq", k, once=True)
    counts = words.groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("depth"), F.count_if("beyond").alias("fragments"))
    return search.both_strands(counts, k)


def branch_support(anchored: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """locus, word, next, fragments: the edges of the graph that leave a word with several of them, and the fragments
    that go over them on a mate whose other one stands on the reference."""
    edges = search.graph_edges(graph.select("locus", "word"))
    several = edges.groupBy("locus", "word").agg(F.count(F.lit(1)).alias("leave")).where("leave > 1").select("locus", "word")
    branches = edges.join(dealt(several), ["locus", "word"], "left_semi").withColumn("window", F.concat("word", F.expr("right(next, 1)")))
    branches = stored(recruit.seq_kmers(branches, ["locus", "word", "next"], "window", k + 1).drop("pos"))
    reads = _mates(anchored, "on1", "on2").where(_on(False))
    windows = recruit.seq_kmers(reads, ["locus", "frag"], "seq", k + 1, once=True).select("locus", "frag", "kmer")
    met = windows.join(dealt(branches.select("locus", "kmer").distinct()), ["locus", "kmer"], "left_semi")
    # Both mates may have a window: the fragment counts once.
    counts = met.distinct().groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("fragments"))
    found = branches.join(dealt(counts), ["locus", "kmer"], "left")
    return found.select("locus", "word", "next", F.coalesce("fragments", F.lit(0).cast("bigint")).alias("fragments"))


def assisted_graph(anchored: DataFrame, refs: DataFrame, k: int, error_limit: int = 2, least: int = LEAST_FRAGMENTS) -> DataFrame:
    """search.weighted_graph's columns for the assisted graph; the rows that are not rescued are the core graph."""
    return search.weighted_words(mate_words(anchored, k), refs, k, error_limit, least)


def _of(name: bool, df: DataFrame) -> DataFrame:
    """df with loci that tell the graph: (locus, assisted)."""
    return df.withColumn("locus", F.struct("locus", F.lit(name).alias("assisted")))


def _both(df: DataFrame) -> DataFrame:
    graphs = F.explode(F.array(F.lit(False), F.lit(True)))
    return df.withColumn("assisted", graphs).withColumn("locus", F.struct("locus", "assisted")).drop("assisted")


def guarded(best: DataFrame) -> DataFrame:
    """The result of each locus from search.best_contigs of loci (locus, assisted): the better row, the core's if both
    are equal or if the assisted one is shorter (guarded, where it is better); with both lengths."""
    values = [c for c in best.columns if c != "locus"]
    row = F.struct(F.struct(*search.ranking()).alias("key"), F.struct(*values).alias("row"))
    pick = lambda name: F.max(F.when(F.col("locus.assisted") == F.lit(name), row))
    both = best.groupBy(F.col("locus.locus").alias("locus")).agg(pick(False).alias("core"), pick(True).alias("assist"))
    better = F.coalesce(F.col("assist.key") > F.col("core.key"), F.col("core").isNull())
    short = F.coalesce(F.col("assist.row.length") < F.col("core.row.length"), F.lit(False))
    chosen = F.when(better & ~short, F.col("assist.row")).otherwise(F.col("core.row"))
    lengths = [F.col(f"{x}.row.length").alias(y) for x, y in (("core", "core_length"), ("assist", "assisted_length"))]
    return both.select("locus", (better & ~short).alias("assisted"), (better & short).alias("guarded"), *lengths, chosen.alias("row")).select("locus", "assisted", "guarded", "core_length", "assisted_length", "row.*")


def mate_contigs(
    pairs: DataFrame, refs: DataFrame, k: int, size: int, error_limit: int = 2, least: int = LEAST_FRAGMENTS, budget: int = search.BUDGET, most: int = search.MOST_SIDES
) -> DataFrame:
    """The best contig of each locus of refs (locus, seq) over its core and its assisted graph, never shorter than the core's."""
    anchored = stored(anchored_pairs(pairs, refs, k))
    graph = assisted_graph(anchored, refs, k, error_limit, least)
    support = branch_support(anchored, graph, k)
    graphs = _of(False, graph.where("NOT rescued")).unionByName(_of(True, graph))
    small = search.number_size(k)
    words = search.in_numbers(graphs, small, "word")
    edges = search.choices(words, search.in_numbers(_of(True, support), small, "word", "next"), small)
    seeds = stored(search.best_seeds(graphs))
    paths = search.search_paths(words, edges, seeds, budget, most, small)
    slices = stored(_both(search.read_slices(_mates(anchored), size)))
    contigs = search.combine_sides(seeds, search.best_sides(paths, slices, size, most))
    return guarded(search.best_contigs(search.contig_support(contigs, slices, words, size, k)))
