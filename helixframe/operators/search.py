"""Search over alternative paths of a locus' k-mer graph.

Words that follow each other without a branch are compacted first, in chunks of bounded size; what is
left of a locus are its branches, numbers without bases.  On these a walk takes the best choice first and goes back to
the latest branch; a path ends where all that follow are on it, and of a side the first `budget` paths that end are its
result.  A locus' walk is sequential and runs in one task; paths share their steps, and bases are joined only to those
paths that are among the longest.

All other tables are keyed by locus and word, so a locus' reads are never one group.  What a window sorts is bounded by
parameters: `most` sides and those as long, the intervals of one contig.

Defined results: a locus without a reference of k bases or without reads on it has no seed and no row; null and empty
sequences have no words; equal reads count each; windows with other letters than A, C, G and T are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import kernels
from helixframe.functions.sequences import reverse_complement, u_to_t
from helixframe.operators import recruit
from helixframe.operators.assembly import MOST_K, OFF_REFERENCE, numbered, unitig_places
from helixframe.operators.tables import dealt, shared, stored

#: Fixed values of the choice at a branch: support by pairs, a step along the reference, depth beyond which a word off it is a repeat.
PAIR_BONUS, LEAST_PAIRS, MOST_PAIRS, RESCUE_PENALTY = 6, 2, 4, 16
STEP_BONUS, NEAR_PLACES, SURGE, LEAST_SURGE = 8, 2, 4, 8
#: Paths of a side that end, sides of a seed that are combined.
BUDGET, MOST_SIDES = 8192, 8


#: Starts of the windows that are cut from one piece: a substring is found by running through what is before it.
PIECE = 500


def text_windows(seq: str, size: int) -> Column:
    """All windows of a sequence, by start; none if it is shorter."""
    firsts = F.when(F.length(seq) >= size, F.sequence(F.lit(1), F.length(seq) - (size - 1), F.lit(PIECE)))
    pieces = F.transform(firsts, lambda i: F.substring(F.col(seq), i, F.lit(PIECE + size - 1)))
    return F.flatten(F.transform(pieces, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (size - 1)), lambda i: F.substring(x, i, F.lit(size)))))


def reference_words(refs: DataFrame, k: int) -> DataFrame:
    """locus, word, known, place: words of both strands of refs (locus, seq), their number, and the place in thousandths
    of the first one by record, start and strand; forward ones count places from the right end, others from the left."""
    size = F.greatest(F.length("seq") - k, F.lit(1))
    order = F.row_number().over(Window.partitionBy("locus").orderBy("seq"))
    each = refs.select("locus", u_to_t("seq").alias("seq"), size.alias("size"), order.alias("record")).select("locus", "size", "record", F.length("seq").alias("n"), F.posexplode(text_windows("seq", k)).alias("at", "word"))
    forward = F.when(F.col("n") > k, F.floor(1000 * (F.col("size") - F.col("at")) / F.col("size"))).otherwise(0).cast("int")
    backward = F.floor(1000 * F.col("at") / F.col("size")).cast("int")
    strands = F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("word").alias("word"), forward.alias("place")), F.struct(F.lit(1).alias("strand"), reverse_complement("word").alias("word"), backward.alias("place"))))
    both = each.where(F.col("word").rlike("^[ACGT]+$")).select("locus", "record", "at", strands.alias("s")).select("locus", "record", "at", "s.*")
    return both.groupBy("locus", "word").agg(F.count(F.lit(1)).alias("known"), F.min_by("place", F.struct("record", "at", "strand")).alias("place"))


def both_strands(counts: DataFrame, k: int) -> DataFrame:
    """counts (locus, kmer and others) with the texts of both strands as word, in place of the canonical kmer."""
    words = counts.withColumn("kmer", recruit.decode("kmer", k))
    return words.withColumn("word", F.explode(F.array_distinct(F.array("kmer", reverse_complement("kmer"))))).drop("kmer")


def read_words(reads: DataFrame, k: int) -> DataFrame:
    """locus, word, depth: words of both strands of reads (locus, seq), each read counting one once."""
    return both_strands(recruit.seq_kmers(reads, ["locus"], "seq", k, once=True).groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("depth")), k)


def depth_caps(depths: DataFrame) -> DataFrame:
    """locus, cap: q3 + 1.5 (q3 - q1) of depths (locus, depth), by hinges, from each locus' histogram."""
    histogram = depths.groupBy("locus", "depth").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("locus")
    counted = histogram.select("locus", "depth", F.sum("n").over(by.orderBy("depth")).alias("upto"), F.sum("n").over(by).alias("total"))
    half = F.floor(F.col("total") / 2)
    near, far = F.floor((half + 1) / 2), F.floor(half / 2) + 1
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("depth")))
    single = F.max("total") == 1
    q1 = F.when(single, F.min("depth")).otherwise((at(near) + at(far)) / 2)
    q3 = F.when(single, F.min("depth")).otherwise((at(F.col("total") + 1 - near) + at(F.col("total") + 1 - far)) / 2)
    return counted.groupBy("locus").agg(q1.alias("q1"), q3.alias("q3")).select("locus", F.floor((F.col("q3") - F.col("q1")) * 1.5 + F.col("q3")).alias("cap"))


def weighted_graph(reads: DataFrame, refs: DataFrame, k: int, error_limit: int = 2) -> DataFrame:
    """locus, word, depth (capped), weight (of the reference, 0 off it), place, rescued (none): words of reads (locus, seq).

    Words off the reference need more than error_limit reads."""
    return weighted_words(read_words(reads, k), refs, k, error_limit)


def weighted_words(words: DataFrame, refs: DataFrame, k: int, error_limit: int = 2, least: int = 0) -> DataFrame:
    """weighted_graph's columns for words (locus, word, depth); with `least`, those with fewer reads are rescued if they
    have that many fragments (a column of words).  Rescued words do not count for the cap."""
    reference = reference_words(refs, k)
    records = refs.groupBy("locus").agg(F.count(F.lit(1)).alias("records"))
    words = words.join(reference, ["locus", "word"], "left")
    rare = F.col("known").isNull() & (F.col("depth") <= error_limit)
    words = words.withColumn("rescued", rare & (F.col("fragments") >= least) if least else F.lit(False))
    kept = stored(words.where((F.col("depth") > error_limit) | F.col("known").isNotNull() | F.col("rescued")).drop("fragments"), compression="zstd")
    # Of the whole graph one table is kept; a row of limits a locus is joined to it wherever it is read.
    both = kept.join(stored(depth_caps(kept.where("NOT rescued")).join(records, "locus")), "locus")
    scaled = F.floor(F.col("records") * F.col("cap") / (F.abs(F.col("known") - F.col("records")) + 1)) + 1
    weight = F.when(F.col("known").isNull(), 0).when(F.col("depth") > error_limit, scaled).otherwise(1)
    return both.select("locus", "word", F.least("depth", "cap").alias("depth"), weight.cast("bigint").alias("weight"), F.coalesce("place", F.lit(OFF_REFERENCE)).alias("place"), "rescued")


def best_seeds(graph: DataFrame) -> DataFrame:
    """locus, seed: the word with the greatest reference weight, then depth, then the least text."""
    order = F.struct(-F.col("weight"), -F.col("depth"), F.col("word"))
    return graph.where("weight > 0").groupBy("locus").agg(F.min_by("word", order).alias("seed"))


def as_number(word: str, k: int | None) -> Column:
    """A word as a number where k is told and lets it be one, as text else."""
    return numbered(word, k) if k else F.col(word)


def number_size(k: int) -> int | None:
    """k if words of k bases can be numbers."""
    return k if k <= MOST_K else None


def in_numbers(df: DataFrame, k: int | None, *words: str) -> DataFrame:
    """df with its columns `words` as numbers; as it is without k."""
    return stored(df.withColumns({c: numbered(c, k) for c in words}), compression="zstd") if k else df


def _follow(words: DataFrame) -> DataFrame:
    """words with each next that may follow."""
    return words.withColumn("next", F.explode(F.array(*(F.concat(F.expr("substring(word, 2)"), F.lit(b)) for b in "ACGT"))))


def graph_edges(words: DataFrame) -> DataFrame:
    """locus, word, next of words (locus, word)."""
    return _follow(words).join(dealt(words.withColumnRenamed("word", "next")), ["locus", "next"], "left_semi").select("locus", "word", "next")


def choices(graph: DataFrame, support: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """locus, inner, word, next, bonus, score: the graph's edges over their k - 1 bases `inner`; the score holds at a branch,
    best first with ties by text.  Edges are dealt by locus and inner, unless there is support.

    support (locus, word, next, fragments): fragments that go over an edge with a mate on the reference.  With k, all words
    are numbers."""
    after = F.col("word").bitwiseAND((1 << 2 * (k - 1)) - 1) if k else F.expr("substring(word, 2)")
    before = F.shiftrightunsigned("word", 2) if k else F.expr("left(word, length(word) - 1)")
    here = graph.select("locus", after.alias("inner"), "word", F.col("depth").alias("d"), F.col("weight").alias("w"), F.col("place").alias("p"))
    there = graph.select("locus", before.alias("inner"), F.col("word").alias("next"), "depth", "weight", "place", "rescued")
    edges = here.join(dealt(there), ["locus", "inner"])
    edges = edges.join(dealt(support), ["locus", "word", "next"], "left") if support is not None else edges.withColumn("fragments", F.lit(0))
    pairs = F.coalesce("fragments", F.lit(0))
    by_pairs = F.when(pairs >= LEAST_PAIRS, PAIR_BONUS * F.least(pairs, F.lit(MOST_PAIRS))).when(F.col("rescued"), -RESCUE_PENALTY).otherwise(0)
    placed = (F.col("p") > 0) & (F.col("p") < 1000) & (F.col("place") > 0) & (F.col("place") < 1000)
    by_step = F.when(~placed, 0).when(F.abs(F.col("p") - F.col("place")) <= NEAR_PLACES, STEP_BONUS).when((F.col("w") > 0) & (F.col("weight") > 0), -STEP_BONUS).otherwise(0)
    surge = F.greatest(F.greatest("d", F.lit(2)) * SURGE, F.lit(LEAST_SURGE))
    by_surge = F.when((F.col("weight") == 0) & (F.col("depth") > surge), -F.floor((F.col("depth") - surge) / 2)).otherwise(0)
    bonus = (by_pairs + by_step + by_surge).cast("bigint")
    return edges.select("locus", "inner", "word", "next", bonus.alias("bonus"), (F.col("depth") + F.col("weight") + bonus).alias("score"))


#: Words that are compacted at once, of one locus as far as they go; stretches that are cut there are joined afterwards.
CHUNK = 4_000_000


def _pieces(of: np.ndarray, word: np.ndarray, letter: np.ndarray, value: np.ndarray, following: np.ndarray, linked: np.ndarray) -> list[np.ndarray | list]:
    """of, head, last, next, bases, value of the stretches among these words, following[i] being the word after word[i] if
    linked[i]; next is None, or the word after the last one, which is not among these.  Circles are left out: no way leads to one."""
    order = np.lexsort((word, of))
    of, word, letter, value, following, linked = (x[order] for x in (of, word, letter, value, following, linked))
    n, at = len(of), np.arange(len(of))
    before = at.copy()
    inside = np.zeros(n, bool)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), n]
    for low, high in zip(cuts, cuts[1:], strict=False):
        mine = low + np.flatnonzero(linked[low:high])
        there = np.minimum(low + np.searchsorted(word[low:high], following[mine]), high - 1)
        same = word[there] == following[mine]
        before[there[same]] = mine[same]
        inside[mine[same]] = True
    place = (before != at).astype(np.int64)
    first = place == 0
    for _ in range(n.bit_length()):
        if first[before].all():
            break
        place += place[before]
        before = before[before]
    path = np.flatnonzero(first[before])
    path = path[np.lexsort((place[path], before[path]))]
    starts = np.flatnonzero(place[path] == 0)
    ends = np.append(starts[1:], len(path))
    bases = letter[path].tobytes()
    last = path[ends - 1]
    cut = linked[last] & ~inside[last]
    after = [x if c else None for x, c in zip(following[last].tolist(), cut.tolist(), strict=True)]
    texts = [bases[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [of[last], word[path[starts]], word[last], after, texts, np.add.reduceat(value[path], starts)]


def stretches(words: DataFrame, single: DataFrame) -> DataFrame:
    """of, head, last, bases, value of the stretches of words (of, word, letter, value) that links single (of, word, next),
    of which one at most leaves and one enters a word, join.  Of circles nothing is told.

    A task compacts CHUNK words at once, which is mostly all of a locus; where a stretch goes on in other chunks its pieces
    are placed by pointer doubling.  So memory is bounded, however many words a locus has."""
    kind = dict(words.dtypes)["word"]
    rows = words.join(dealt(single), ["of", "word"], "left").select("of", "word", F.ascii("letter").cast("tinyint").alias("letter"), "value", "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if n and (batch is None or n + batch.num_rows > CHUNK):
                table = pa.Table.from_batches(held)
                of, word, letter, value = (table.column(i).to_numpy() for i in range(4))
                following = table.column(4)
                linked = following.is_valid().to_numpy()
                found = _pieces(of, word, letter.astype(np.uint8), value, following.fill_null(0 if kind == "bigint" else "").to_numpy(), linked)
                names = pa.schema([("of", pa.int64()), ("head", table.schema.field(1).type), ("last", table.schema.field(1).type), ("next", table.schema.field(1).type), ("bases", pa.string()), ("value", pa.int64())])
                yield from pa.table([pa.array(x, f.type) for x, f in zip(found, names, strict=True)], schema=names).to_batches(max_chunksize=10_000)
                held, n = [], 0
            if batch is not None:
                held.append(batch)
                n += batch.num_rows

    pieces = stored(rows.repartition("of").sortWithinPartitions("of").mapInArrow(run, f"of bigint, head {kind}, last {kind}, next {kind}, bases string, value bigint"), compression="zstd")
    if not pieces.where("next IS NOT NULL").limit(1).count():
        return pieces.drop("next")
    cut = pieces.where("next IS NOT NULL").select(F.col("of").alias("locus"), F.col("head").alias("word"), "next", F.lit(True).alias("single"))
    places = unitig_places(pieces.select(F.col("of").alias("locus"), F.col("head").alias("word")), stored(cut)).select(F.col("locus").alias("of"), F.col("word").alias("piece"), "head", "place")
    each = pieces.withColumnRenamed("head", "piece").join(dealt(places), ["of", "piece"])
    texts = F.array_sort(F.collect_list(F.struct("place", "bases")))
    return each.groupBy("of", "head").agg(F.max_by("last", "place").alias("last"), F.array_join(F.transform(texts, lambda x: x["bases"]), "").alias("bases"), F.sum("value").alias("value"))


def branch_nodes(graph: DataFrame, edges: DataFrame, loci: DataFrame, starts: DataFrame, k: int | None = None) -> DataFrame:
    """of, head, bases, value, follow: the graph's stretches without a branch, of the loci in loci (locus, of); each of
    starts (of, word) is one by itself.

    bases: last letters of its words; value: sum of their depths and weights; follow: (next, bonus), best first.  With k,
    words are numbers."""
    letter = F.substring(F.lit("ACGT"), F.col("word").bitwiseAND(3).cast("int") + 1, F.lit(1)) if k else F.expr("right(word, 1)")
    words = graph.join(loci, "locus").select("of", "word", letter.alias("letter"), (F.col("depth") + F.col("weight")).alias("value"))
    # All edges over the same k - 1 bases leave the same words and enter the same ones: one alone is single.
    over = F.count(F.lit(1)).over(Window.partitionBy("locus", "inner"))
    apart = starts.groupBy("of").agg(F.collect_set("word").alias("apart"))
    one = (F.col("n") == 1) & ~F.array_contains("apart", F.col("word")) & ~F.array_contains("apart", F.col("next"))
    joints = edges.withColumn("n", over).join(shared(stored(loci.join(apart, "of"))), "locus").withColumn("one", one)
    joints = stored(joints.select("of", "word", "next", "one", *(F.when(~F.col("one"), F.col(c)).alias(c) for c in ("bonus", "score"))), compression="zstd")
    single = joints.where("one").select("of", "word", "next")
    sorted_ones = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "next", "bonus")))
    follow = F.transform(sorted_ones, lambda x: F.struct(x["next"].alias("next"), x["bonus"].alias("bonus")))
    after = joints.where("NOT one").groupBy("of", F.col("word").alias("last")).agg(follow.alias("follow"))
    return stretches(words, single).join(dealt(after), ["of", "last"], "left").select("of", "head", "bases", "value", "follow")


#: Columns of the ends of walks: number of the locus, side, choices, numbers of the nodes, value, bases.
ENDS = "of bigint, side string, key string, ids array<bigint>, value bigint, size bigint"


def dead_ends(start: int, offsets: memoryview, after: memoryview, bonus: memoryview, gain: memoryview, size: memoryview, budget: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The first `budget` dead ends of a walk from node `start` that takes the best choice first and goes back to the latest branch.

    Those that may follow node u are after[offsets[u] : offsets[u + 1]], best first.  Returned are the ends (step, value,
    bases) and the steps (step before, node, rank of the choice): what paths share is kept once.
    """
    steps, ends = [(-1, start, 0)], []
    path, todo = [start], [(0, 0, 0, None)]
    on = {start}
    while todo and len(ends) < budget:
        step, value, length, rest = todo.pop()
        if rest is None:
            u = steps[step][1]
            free = [i for i in range(offsets[u], offsets[u + 1]) if after[i] not in on]
            if not free:
                ends.append((step, value, length))
                on.discard(path.pop())
                continue
            rest = (free[::-1], len(free) > 1, offsets[u])
        free, several, low = rest
        if not free:
            on.discard(path.pop())
            continue
        i = free.pop()
        todo.append((step, value, length, rest))
        v = after[i]
        path.append(v)
        on.add(v)
        steps.append((step, v, i - low))
        todo.append((len(steps) - 1, value + gain[v] + (bonus[i] if several else 0), length + size[v], None))
    return ends, steps


def _way(step: int, steps: list[tuple[int, int, int]]) -> tuple[str, list[int]]:
    """The choices up to a step, and the nodes."""
    ranks, nodes = [], []
    while step >= 0:
        before, node, rank = steps[step]
        nodes.append(node)
        ranks.append(str(rank) if before >= 0 else "")
        step = before
    return "".join(reversed(ranks)), nodes[::-1]


def _walks(budget: int, most: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """From a locus' nodes (of, id, size, value, next, bonus) and starts (side, id) the rows of ENDS; with `most` those that best_sides may take."""

    def run(nodes: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        found = []
        nodes = nodes.sort_values("id")
        ids = nodes["id"].to_numpy()
        offsets = np.concatenate([[0], np.cumsum(nodes["next"].map(len).to_numpy(np.int64))]) if len(ids) else np.zeros(1, np.int64)
        joined = lambda c: np.concatenate(nodes[c].to_list()).astype(np.int64) if offsets[-1] else np.zeros(0, np.int64)
        after, bonus = np.searchsorted(ids, joined("next")), joined("bonus")
        views = [memoryview(np.ascontiguousarray(x, np.int64)) for x in (offsets, after, bonus, nodes["value"].to_numpy(), nodes["size"].to_numpy())]
        for side, start in zip(starts["side"], starts["id"], strict=True):
            ends, steps = dead_ends(int(np.searchsorted(ids, start)), *views, budget)
            if most:
                greatest = max(value for _, value, _ in ends)
                ends = [e for e in ends if e[1] > greatest >> 2]
                least = sorted((e[2] for e in ends), reverse=True)[:most]
                ends = [e for e in ends if e[2] >= least[-1]]
            for step, value, length in ends:
                key, way = _way(step, steps)
                found.append((starts["of"].iloc[0], side, key, ids[way], value, length))
        return pd.DataFrame(found, columns=["of", "side", "key", "ids", "value", "size"])

    return run


def search_paths(graph: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = BUDGET, most: int | None = None, k: int | None = None) -> DataFrame:
    """locus, side, key, bases, value: the first `budget` paths that end, right of each seed (locus, seed) and, as side
    `left`, right of its reverse complement.  Their keys order them.  With `most` only those that best_sides may take.
    With k, the words of graph and edges are numbers."""
    sides = F.explode(F.array(F.struct(F.lit("right").alias("side"), F.col("seed").alias("word")), F.struct(F.lit("left").alias("side"), reverse_complement("seed").alias("word"))))
    loci = stored(seeds.select("locus", "seed", F.monotonically_increasing_id().alias("of")))
    starts = stored(loci.select("locus", "of", sides.alias("s")).select("locus", "of", "s.*"))
    nodes = stored(branch_nodes(graph, edges, loci.select("locus", "of"), starts.select("of", as_number("word", k).alias("word")), k).withColumn("id", F.monotonically_increasing_id()), compression="zstd")
    named = nodes.select("of", "head", "id")
    links = nodes.select("of", F.col("id").alias("from"), F.posexplode("follow").alias("rank", "f")).select("of", "from", "rank", F.col("f.next").alias("head"), F.col("f.bonus").alias("bonus"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id", "bonus")))
    follow = links.join(dealt(named), ["of", "head"]).groupBy("of", F.col("from").alias("id")).agg(ranked.alias("f"))
    none = F.array().cast("array<bigint>")
    small = nodes.select("of", "id", F.length("bases").cast("bigint").alias("size"), "value").join(dealt(follow), ["of", "id"], "left")
    small = small.select("of", "id", "size", "value", F.coalesce(F.col("f.id"), none).alias("next"), F.coalesce(F.col("f.bonus"), none).alias("bonus"))
    begin = stored(starts.select("of", "side", as_number("word", k).alias("head")).join(named, ["of", "head"]).select("of", "side", "id"))
    ends = stored(small.groupBy("of").cogroup(begin.groupBy("of")).applyInPandas(_walks(budget, most), ENDS))
    each = ends.select("of", "side", "key", F.posexplode("ids").alias("at", "id")).join(dealt(nodes.select("id", F.col("bases").alias("letters"))), "id")
    # The first node is the seed itself.
    letters = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("at") > 0, F.col("letters")).otherwise("").alias("letters"))))
    texts = each.groupBy("of", "side", "key").agg(F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("bases"))
    return texts.join(ends.select("of", "side", "key", "value"), ["of", "side", "key"]).join(loci.select("of", "locus"), "of").select("locus", "side", "key", "bases", "value")


def read_slices(reads: DataFrame, size: int) -> DataFrame:
    """locus, slice, n: the middle `size` bases of each read of reads (locus, seq) and of its reverse complement."""
    middle = F.floor((F.length("seq") - size) / 2).cast("int") + 1
    cut = lambda c: F.substring(c, middle, F.lit(size))
    both = F.array_distinct(F.array(cut(F.col("seq")), cut(reverse_complement("seq"))))
    return reads.where(F.length("seq") >= size).select("locus", F.explode(both).alias("slice")).groupBy("locus", "slice").agg(F.count(F.lit(1)).alias("n"))


#: Windows that are told apart at once.
MOST_WINDOWS = 1 << 21


def _offsets(size: int) -> list[int]:
    """Where the parts of a window start: each of MOST_K bases at most, the last one ending with the window."""
    return [*range(0, size - MOST_K, MOST_K), max(size - MOST_K, 0)]


def _windows(text: bytes, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of a text's windows of A, C, G and T, and their parts as numbers of two bits a base."""
    codes, _ = kernels.joined_codes([text])
    value, _, valid = kernels.kmers(codes, min(size, MOST_K))
    n = max(len(codes) - size + 1, 0)
    at = np.flatnonzero(np.logical_and.reduce([valid[o : o + n] for o in _offsets(size)]))
    return at, [value[at + o] for o in _offsets(size)]


def _apart(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The different windows; some may be left twice."""
    order = np.argsort(sum(p.astype(np.uint64) * np.uint64(m) for p, m in zip(parts, range(0x9E3779B97F4A7C15, 1 << 64, 1 << 40), strict=False)))
    parts = [p[order] for p in parts]
    new = np.logical_or.reduce([np.diff(p, prepend=-1) != 0 for p in parts])
    return [p[new] for p in parts]


class _Keys:
    """Numbers of different windows, looked up by their parts; number[i] is that of the i-th window."""

    def __init__(self, parts: list[np.ndarray]):
        self.values, self.pairs, self.number = [], [], np.zeros(len(parts[0]), np.int64)
        for p in parts:
            value, at = np.unique(p, return_inverse=True)
            pair, self.number = np.unique(self.number * len(value) + at, return_inverse=True)
            self.values.append(value)
            self.pairs.append(pair)

    def find(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of those windows that are there, and their numbers."""
        at = np.arange(len(parts[0]))
        number = np.zeros(len(at), np.int64)
        for p, value, pair in zip(parts, self.values, self.pairs, strict=True):
            there, same = _among(value, p[at])
            at, x = at[same], number[same] * len(value) + there[same]
            there, same = _among(pair, x)
            at, number = at[same], there[same]
        return at, number


def _among(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x are among the rising numbers `known`, and whether they are."""
    there = np.searchsorted(known, x)
    return there, known[np.minimum(there, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _parts(size: int) -> list[str]:
    return [f"p{i}" for i in range(len(_offsets(size)))]


def keyed(df: DataFrame, text: str, n: str, size: int) -> DataFrame:
    """of, p0, p1 ..., n: df's texts (of, text, n) of `size` bases by the parts of their numbers; those with other letters never meet a contig."""
    if dict(df.dtypes)[text] == "bigint":
        return df.select("of", F.col(text).alias("p0"), F.col(n).cast("bigint").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = kernels.joined_codes([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            value, _, _ = kernels.kmers(codes, min(size, MOST_K))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(value[starts + o]) for o in _offsets(size)), batch.column(2)], names=["of", *_parts(size), "n"])

    rows = df.where(F.col(text).rlike("^[ACGT]+$") & (F.length(text) == size)).select("of", text, F.col(n).cast("bigint").alias("n"))
    return rows.mapInArrow(run, f"of bigint, {', '.join(f'{p} bigint' for p in _parts(size))}, n bigint")


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def held_windows(texts: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """The rows of table (of, p0, p1 ..., n: see keyed) that any of the texts (of, text) of the same number holds."""
    names = _parts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine, n = [], None, 0

        def told() -> pa.RecordBatch:
            parts = _apart([np.concatenate(x) for x in zip(*held, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[0]), mine)), *map(pa.array, parts)], names=["of", *names])

        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (of != mine or n > MOST_WINDOWS):
                    yield told()
                    held, n = [], 0
                mine = of
                held.append(_windows(text.as_buffer().to_pybytes(), size)[1])
                n += len(held[-1][0])
        if held:
            yield told()

    rows = texts.select("of", "text").repartition(_tasks(texts), "of").sortWithinPartitions("of")
    found = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["of", *names]))
    return table.join(dealt(found), ["of", *names], "left_semi")


def along_texts(texts: DataFrame, tables: list[tuple[DataFrame, int]], told: Callable, schema: str) -> DataFrame:
    """id and what `told` gives for each of texts (of, id, text), from (places, numbers, n) for each of the tables with the
    size of its windows: where the text has windows of its `of` in the table, their numbers, and n by number.

    Rows come by `of`, those of the tables that any of its texts holds first, so a task has these of one `of` and one batch of texts."""
    sizes = [size for _, size in tables]
    rows = texts.select("of", F.lit(len(tables)).alias("kind"), "id", "text", F.lit(None).cast("array<bigint>").alias("parts"), F.lit(None).cast("bigint").alias("n"))
    for kind, (table, size) in enumerate(tables):
        found = held_windows(texts, table, size)
        rows = rows.unionByName(found.select("of", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("text"), F.array(*_parts(size)).alias("parts"), "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, held, known = None, [], None

        def keys() -> list[tuple[_Keys, np.ndarray]]:
            found = []
            for size, pieces in zip(sizes, held, strict=True):
                parts = np.concatenate([np.zeros((0, len(_offsets(size))), np.int64), *(p for p, _ in pieces)])
                key, n = _Keys(list(parts.T)), np.zeros(len(parts), np.int64)
                n[key.number] = np.concatenate([np.zeros(0, np.int64), *(x for _, x in pieces)])
                found.append((key, n))
            return found

        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if of[low] != mine:
                    mine, held, known = of[low], [[] for _ in sizes], None
                if kind[low] < len(sizes):
                    width = len(_offsets(sizes[kind[low]]))
                    held[kind[low]].append((part.column(4).flatten().to_numpy().reshape(-1, width), part.column(5).to_numpy()))
                    continue
                known = known or keys()
                for number, text in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    met = []
                    for size, (key, n) in zip(sizes, known, strict=True):
                        at, parts = _windows(text.as_buffer().to_pybytes(), size)
                        there, numbers = key.find(parts)
                        met.append((at[there], numbers, n))
                    yield pa.RecordBatch.from_pylist([{"id": number, **told(len(text.as_buffer()), *met)}], schema=names)

    names = pa.schema([("id", pa.int64()), *((c, {"bigint": pa.int64(), "double": pa.float64()}[t]) for c, t in (x.split() for x in schema.split(", ")))])
    return rows.repartition(_tasks(texts), "of").sortWithinPartitions("of", "kind").mapInArrow(run, f"id bigint, {schema}")


def _numbered_loci(df: DataFrame) -> DataFrame:
    return stored(df.select("locus").distinct().withColumn("of", F.monotonically_increasing_id()))


def best_sides(paths: DataFrame, slices: DataFrame, size: int, most: int = MOST_SIDES) -> DataFrame:
    """locus, side, number, bases, value, reads: of the paths with over a quarter of their side's greatest value the
    `most` best by length, reads whose slice they hold, value and text."""
    greatest = paths.groupBy("locus", "side").agg(F.max("value").alias("greatest"))
    kept = paths.join(greatest, ["locus", "side"]).where("value > shiftright(greatest, 2)").select("locus", "side", "key", "bases", "value")
    # Length comes first, so reads count only for paths as long as the last of the best.
    longest = Window.partitionBy("locus", "side").orderBy(F.length("bases").desc())
    kept = stored(kept.withColumn("rank", F.rank().over(longest)).where(F.col("rank") <= most).drop("rank").withColumn("id", F.monotonically_increasing_id()))
    loci = _numbered_loci(kept)

    def told(length: int, slices: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
        _, numbers, n = slices
        return {"reads": int(n[np.unique(numbers)].sum())}

    texts = kept.join(shared(loci), "locus").select("of", "id", F.col("bases").alias("text"))
    reads = stored(along_texts(texts, [(keyed(slices.join(shared(loci), "locus"), "slice", "n", size), size)], told, "reads bigint"))
    order = Window.partitionBy("locus", "side").orderBy(F.length("bases").desc(), F.desc("reads"), F.desc("value"), "bases", "key")
    scored = kept.join(shared(reads), "id")
    return scored.withColumn("number", F.row_number().over(order)).where(F.col("number") <= most).select("locus", "side", F.col("number").cast("bigint").alias("number"), "bases", "value", "reads")


def combine_sides(seeds: DataFrame, sides: DataFrame) -> DataFrame:
    """locus, left, right, contig, value: each left side of a seed with each right one; a side without a path is empty, number 0."""

    def half(name: str) -> DataFrame:
        mine = sides.where(F.col("side") == name).select("locus", "number", F.col("bases").alias("text"), "value")
        zero = F.lit(0).cast("bigint")
        found = seeds.select("locus").join(mine, "locus", "left").select("locus", F.coalesce("number", zero).alias(name), F.coalesce("text", F.lit("")).alias(f"{name}_bases"), F.coalesce("value", zero).alias(f"{name}_value"))
        return found

    both = seeds.join(half("left"), "locus").join(half("right"), "locus")
    return both.select("locus", "left", "right", F.concat(reverse_complement("left_bases"), "seed", "right_bases").alias("contig"), (F.col("left_value") + F.col("right_value")).alias("value"))


def contig_support(contigs: DataFrame, slices: DataFrame, graph: DataFrame, size: int, k: int) -> DataFrame:
    """contigs (locus, left, right, contig, value) with reads found in one place and in several, bases that the first
    cover, the longest gap, and median, variation and peak of the depths along each.  The graph's words are texts or numbers."""

    def told(length: int, slices: tuple[np.ndarray, np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
        at, numbers, n = slices
        places = np.bincount(numbers, minlength=len(n))
        alone = at[places[numbers] == 1]
        found = {"unique_reads": int(n[places == 1].sum()), "multi_reads": int(n[places > 1].sum())}
        if len(alone):
            # Intervals are all `size` long, so one adds what lies beyond the one before it.
            steps = np.diff(alone)
            found |= {"supported_bases": size + int(np.minimum(steps, size).sum()), "gap": max(int(steps.max(initial=0)) - size, 0), "first": int(alone[0]), "last": int(alone[-1])}
        _, numbers, n = words
        depths = np.zeros(max(length - k + 1, 0), np.int64)
        depths[: len(numbers)] = n[numbers]  # in any order
        if len(depths):
            mean = float(depths.mean())
            found |= {"median_depth": float(np.median(depths)), "depth_cv": float(depths.std()) / mean if mean else 0.0, "top": int(depths.max())}
        return found

    contigs = stored(contigs.withColumn("id", F.monotonically_increasing_id()))
    loci = _numbered_loci(contigs)
    of = lambda df: df.join(shared(loci), "locus")
    tables = [(keyed(of(slices), "slice", "n", size), size), (keyed(of(graph), "word", "depth", k), k)]
    schema = "unique_reads bigint, multi_reads bigint, supported_bases bigint, gap bigint, first bigint, last bigint, median_depth double, depth_cv double, top bigint"
    found = contigs.join(shared(stored(along_texts(of(contigs).select("of", "id", F.col("contig").alias("text")), tables, told, schema))), "id")
    size_of = F.length("contig")
    none = F.col("supported_bases").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    ends = F.greatest(F.col("gap"), F.col("first"), size_of - F.col("last") - size)
    low, high = F.col("first"), size_of - F.col("last") - size
    balance = F.when(none, 0.0).when((low == 0) & (high == 0), 1.0).otherwise(F.least(low, high) / F.greatest(low, high))
    return found.select(
        "locus", "left", "right", "contig", "value", size_of.cast("bigint").alias("length"), zero("unique_reads"), zero("multi_reads"), zero("supported_bases"),
        F.when(none, size_of).otherwise(ends).cast("bigint").alias("max_gap"), balance.alias("flank_balance"), "median_depth",
        F.round("depth_cv", 9).alias("depth_cv"), F.round(F.col("top") / F.col("median_depth"), 9).alias("depth_ratio"),
    )


def ranking() -> list[Column]:
    """What contigs are ranked by, of contig_support's columns: effective bases, breadth, density of reads, gap, length,
    reads in one place, all reads, balance, value and text, all the greater the better but for the gap."""
    density = F.col("unique_reads") / F.col("length")
    effective = F.col("supported_bases") * F.least(density / 0.01, F.lit(1.0)) / (1 + F.col("depth_cv")) * F.least(10 / F.greatest("depth_ratio", F.lit(1.0)), F.lit(1.0))
    keys = [F.round(effective, 6), F.col("supported_bases") / F.col("length"), density, -F.col("max_gap") / F.col("length"), F.col("length"), F.col("unique_reads"), F.col("unique_reads") + F.col("multi_reads"), F.col("flank_balance"), F.col("value"), F.col("contig")]
    return [x.alias(f"k{i}") for i, x in enumerate(keys)]


def best_contigs(supported: DataFrame) -> DataFrame:
    """The best row of each locus of contig_support's, with the number of candidates."""
    keys = [*ranking(), (-F.col("left")).alias("left"), (-F.col("right")).alias("right")]
    best = F.max_by(F.struct(*(c for c in supported.columns if c != "locus")), F.struct(*keys))
    return supported.groupBy("locus").agg(best.alias("b"), F.count(F.lit(1)).alias("candidates")).select("locus", "candidates", "b.*")


def search_contigs(reads: DataFrame, refs: DataFrame, slices: DataFrame, k: int, size: int, error_limit: int = 2, budget: int = BUDGET, most: int = MOST_SIDES) -> DataFrame:
    """The best contig of each locus of refs (locus, seq) from its reads (locus, seq) and read_slices of `size` bases."""
    graph = weighted_graph(reads, refs, k, error_limit)
    seeds = stored(best_seeds(graph))
    small = number_size(k)
    words = in_numbers(graph, small, "word")
    paths = search_paths(words, choices(words, k=small), seeds, budget, most, small)
    slices = stored(slices)
    return best_contigs(contig_support(combine_sides(seeds, best_sides(paths, slices, size, most)), slices, words, size, k))
