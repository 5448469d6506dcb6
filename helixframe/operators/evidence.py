"""Positional evidence: orientation runs, exact matches, covered bins, interval support, sketches, id checks."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import kernels, sequences
from helixframe.operators.recruit import _once, _parts, _texts

BINS = 64
#: Fixed values of the orientation test: runs statistic, binomial quantile, slack of the longest run, Euler's constant.
RUNS_Z, BINOMIAL_Z, LONGEST_SLACK, EULER = -3.74, 1.96, 4.0, 0.5772156649015329


def effective_length(refs: DataFrame, locus: str, seq: str, k: int, distinct: bool = False) -> DataFrame:
    """locus, refs, longest, effective_length = trunc(longest * (log10(refs) + 1)); refs: sequences of k bases or
    more, records or else distinct ones."""
    usable = F.when(F.length(seq) >= k, F.col(seq))
    n = F.countDistinct(usable) if distinct else F.count(usable)
    found = refs.groupBy(locus).agg(n.alias("refs"), F.max(F.length(seq)).cast("bigint").alias("longest")).where("refs > 0")
    return found.withColumn("effective_length", (F.col("longest") * (F.log10("refs") + 1)).cast("bigint"))


def minimizer_sketches(df: DataFrame, id_: str, seq: str, k: int, w: int) -> DataFrame:
    """id, sketch: the distinct sorted minima of w consecutive canonical k-mers (all of them if there are fewer).

    A window with an ambiguous base is no k-mer; runs between such windows are sketched as one sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            number, _, value = kernels.canonical(_texts(part.column(1)), k)
            number, value = _once(*kernels.window_minima(number, value, w), k)
            bounds = np.searchsorted(number, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value))], names=[id_, "sketch"])

    return df.select(id_, F.col(seq).cast("string")).mapInArrow(run, f"`{id_}` {dict(df.dtypes)[id_]}, sketch array<bigint>")


def dinucleotide_entropy(df: DataFrame, id_: str, seq: str) -> DataFrame:
    """id, entropy (bits) of the two-base windows without ambiguous bases; 0 without any.  For long sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            codes, starts = kernels.joined_codes(_texts(part.column(1)))
            value, _, valid = kernels.kmers(codes, 2)
            row = np.searchsorted(starts, np.flatnonzero(valid), "right") - 1
            counts = np.bincount(row * 16 + value[valid], minlength=16 * part.num_rows).reshape(-1, 16).astype(float)
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(entropy + 0.0)], names=[id_, "entropy"])

    return df.select(id_, F.col(seq).cast("string")).mapInArrow(run, f"`{id_}` {dict(df.dtypes)[id_]}, entropy double")


def bait_seeds(read: bytes, k: int = 23, w: int = 12) -> list[int]:
    """A read's seeds in order: minima of w consecutive canonical k-mers, repeats of the last left out, and the first,
    middle and last k-mer; none for a read with an ambiguous base."""
    codes = kernels.CODES[np.frombuffer(read, np.uint8)]
    if len(codes) < k or (codes > 3).any():
        return []
    forward, reverse, _ = kernels.kmers(codes, k)
    value = np.minimum(forward, reverse)
    least = np.lib.stride_tricks.sliding_window_view(value, w).min(axis=1) if len(value) >= w else value.min(keepdims=True)
    least = least[np.concatenate([[True], np.diff(least) != 0])]
    return list(dict.fromkeys([*least.tolist(), int(value[0]), int(value[len(value) // 2]), int(value[-1])]))


def id_coverage(refs: DataFrame, groups: DataFrame, id_: str, group: str) -> DataFrame:
    """One row: reference ids without a group, group ids without a reference, ids whose groups disagree."""
    missing = refs.select(id_).distinct().join(groups, id_, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    unused = groups.select(id_).distinct().join(refs, id_, "left_anti").agg(F.count(F.lit(1)).alias("unused"))
    differ = groups.groupBy(id_).agg(F.countDistinct(group).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("disagreeing"))
    one = lambda df, name: df.select(F.lit(1).alias("one"), name)
    return one(missing, "missing").join(one(unused, "unused"), "one").join(one(differ, "disagreeing"), "one").drop("one")


def islands(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Runs of equal consecutive states: keys, run (from 1), state, length, first and last of the first order column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", state).agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def interval_support(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, reads, supported (covered length), extent, breadth, max_gap (within the extent) of half-open intervals.

    An interval opens a new island if it starts after the end of all before it.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("__reach", reach).withColumn("__new", F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0))
    numbered = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "__island").agg(F.min(start).alias("__a"), F.max(end).alias("__b"), F.count(F.lit(1)).alias("__n"))
    gaps = merged.withColumn("__gap", F.col("__a") - F.lag("__b").over(Window.partitionBy(*keys).orderBy("__a")))
    found = gaps.groupBy(*keys).agg(
        F.sum("__n").alias("reads"),
        F.sum(F.col("__b") - F.col("__a")).alias("supported"),
        (F.max("__b") - F.min("__a")).alias("extent"),
        F.coalesce(F.max("__gap"), F.lit(0)).alias("max_gap"),
        F.count(F.lit(1)).alias("islands"),
    )
    return found.withColumn("breadth", F.when(F.col("extent") > 0, F.col("supported") / F.col("extent")).otherwise(F.lit(0.0)))


def bin_mask(start: Column, end: Column, length: Column, bins: int = BINS) -> Column:
    """Bit mask of the bins that positions start to end (exclusive) of a reference touch."""
    at = lambda p: F.least(F.floor(p * bins / length), F.lit(bins - 1)).cast("int")
    low, high = at(start), at(F.greatest(end - 1, start))
    all_ = F.lit(-1).cast("bigint")
    upto = F.when(high >= 63, all_).otherwise(F.bitwise_not(F.call_function("shiftleft", all_, high + 1)))
    return upto.bitwiseAND(F.call_function("shiftleft", all_, low))


def covered_bins(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_count(F.bit_or(mask)).cast("bigint").alias("covered_bins"), F.count(F.lit(1)).alias("n"))


def orientation(codes: np.ndarray) -> int:
    """1 forward, 2 reverse, 3 both or unsure, 0 none, from the strand codes (0 to 3) of a read's windows.

    One direction wins if it alone has hits; else by the share of its hits beyond a 95 % binomial interval; else,
    where there are significantly few runs, by the longest run if it is longer than chance allows.
    """
    codes = np.asarray(codes)
    one, two = int((codes == 1).sum()), int((codes == 2).sum())
    n = one + two
    if not n:
        return 3 if (codes == 3).any() else 0
    if not one or not two:
        return 1 if one else 2
    margin = BINOMIAL_Z * sqrt(n) / 2
    if abs(one - n / 2) > margin:
        return 1 if one > two else 2
    way = codes[(codes == 1) | (codes == 2)]
    cuts = np.flatnonzero(np.diff(way)) + 1
    lengths = np.diff(np.concatenate([[0], cuts, [n]]))
    first = way[np.concatenate([[0], cuts])]
    mean = 2 * one * two / n + 1
    spread = (mean - 1) * (mean - 2) / max(n - 1, 1)
    if spread <= 0 or (len(lengths) - mean) / sqrt(spread) >= RUNS_Z:
        return 3
    longest = {d: int(lengths[first == d].max()) for d in (1, 2)}
    allowed = max(0.0, log2(n) + EULER / log(2) - 1.5) + LONGEST_SLACK
    if max(longest.values()) > allowed and longest[1] != longest[2]:
        return max(longest, key=longest.get)
    return 3


def pair_kept(first: Column, second: Column, drop_unmatched: bool = False) -> Column:
    """A pair whose mates vote for the same single direction goes; (0, 0) too if asked."""
    same = (first == second) & first.isin(1, 2)
    return ~(same | ((first == 0) & (second == 0))) if drop_unmatched else ~same


def verify_k(k: int) -> int:
    return max(k // 2, k - 13) | 1


def longest_match(read: bytes, reference: bytes, k: int) -> tuple[int, int, int, int] | None:
    """(strand, read start, reference start, length) of the longest exact match of k bases or more; of equally long
    ones the first by strand, reference start and read start.  Starts on strand 2 are those of the reversed reference."""
    read_codes, codes = kernels.CODES[np.frombuffer(read, np.uint8)], kernels.CODES[np.frombuffer(reference, np.uint8)]
    mine, _, good = kernels.kmers(read_codes, k)
    q = np.flatnonzero(good)
    best = None
    for strand, target in ((1, codes), (2, np.where(codes > 3, 4, 3 - (codes & 3)).astype(np.uint8)[::-1])):
        theirs, _, usable = kernels.kmers(target, k)
        r = np.flatnonzero(usable)
        order = r[np.argsort(theirs[r], kind="stable")]
        low, high = (np.searchsorted(theirs[order], mine[q], side) for side in ("left", "right"))
        n = high - low
        if not n.sum():
            continue
        at_q = np.repeat(q, n)
        at_r = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        place = np.lexsort((at_q, at_r - at_q))
        at_q, at_r = at_q[place], at_r[place]
        new = np.ones(len(at_q), bool)
        new[1:] = (np.diff(at_r - at_q) != 0) | (np.diff(at_q) != 1)
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(at_q))) + k - 1
        i = min(range(len(heads)), key=lambda i: (-lengths[i], at_r[heads[i]], at_q[heads[i]]))
        if best is None or lengths[i] > best[3]:
            best = (strand, int(at_q[heads[i]]), int(at_r[heads[i]]), int(lengths[i]))
    return best


def maximal_matches(hits: DataFrame, frags: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """frag, locus, strand, query_start, reference_start, length of the longest match of each (frag, locus) in hits."""
    pairs = hits.join(frags.select("frag", F.col("seq").alias("__read")), "frag").join(refs.select("locus", F.col("seq").alias("__ref")), "locus").select("frag", "locus", "__read", "__ref")
    names = ["frag", "locus", "strand", "query_start", "reference_start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_match(a, b, k) for a, b in zip(_texts(batch.column(2)), _texts(batch.column(3)), strict=True)]
            keep = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            rows = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(4))], names=names)

    return pairs.mapInArrow(run, f"frag {dict(frags.dtypes)['frag']}, locus {dict(refs.dtypes)['locus']}, strand int, query_start int, reference_start int, length int")


def exact_evidence(matches: DataFrame, frags: DataFrame, refs: DataFrame, window: int = 150) -> DataFrame:
    """matches with covered_bins (mask), left_extension, right_extension and terminal_mask (1 left, 2 right).

    A read extends an end of its reference if its match begins or ends within the window (a fifth of the reference at
    most) and the read has bases beyond the match there; on strand 2 the sides are those of the forward reference.
    """
    sizes = lambda df, key, name: df.select(key, F.length("seq").alias(name))
    both = matches.join(sizes(frags, "frag", "__q"), "frag").join(sizes(refs, "locus", "__r"), "locus")
    forward = F.col("strand") == 1
    end = F.col("reference_start") + F.col("length")
    before, after = F.col("query_start"), F.col("__q") - F.col("query_start") - F.col("length")
    found = both.withColumns(
        {
            "__start": F.when(forward, F.col("reference_start")).otherwise(F.col("__r") - end),
            "__end": F.when(forward, end).otherwise(F.col("__r") - F.col("reference_start")),
            "__left": F.when(forward, before).otherwise(after),
            "__right": F.when(forward, after).otherwise(before),
            "__window": F.least(F.lit(window), F.floor(F.col("__r") / 5)),
        }
    )
    left = (F.col("__start") <= F.col("__window")) & (F.col("__left") > 0)
    right = (F.col("__r") - F.col("__end") <= F.col("__window")) & (F.col("__right") > 0)
    found = found.withColumns(
        {
            "covered_bins": bin_mask(F.col("__start"), F.col("__end"), F.col("__r")),
            "left_extension": F.when(left, F.least("__left", F.lit(65535))).otherwise(0).cast("int"),
            "right_extension": F.when(right, F.least("__right", F.lit(65535))).otherwise(0).cast("int"),
            "terminal_mask": F.when(left, 1).otherwise(0) + F.when(right, 2).otherwise(0),
        }
    )
    return found.drop("__q", "__r", "__start", "__end", "__left", "__right", "__window")


def orientation_codes(read: bytes, references: list[bytes], k: int) -> np.ndarray:
    """By window of the read: 1 or 2 for one that occurs once in the references, both strands taken together; else 0.
    A read with an ambiguous base has none."""
    codes = kernels.CODES[np.frombuffer(read, np.uint8)]
    if len(codes) < k or (codes > 3).any():
        return np.zeros(0, np.int64)
    mine = kernels.kmers(codes, k)[0]
    values, strands = [], []
    for reference in references:
        theirs = kernels.CODES[np.frombuffer(reference, np.uint8)]
        forward, reverse, good = kernels.kmers(theirs, k)
        values += [forward[good], reverse[good]]
        strands += [np.full(int(good.sum()), 1), np.full(int(good.sum()), 2)]
    values, strands = np.concatenate(values), np.concatenate(strands)
    order = np.argsort(values, kind="stable")
    values, strands = values[order], strands[order]
    low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
    once = high - low == 1
    return np.where(once, strands[np.minimum(low, max(len(strands) - 1, 0))] if len(strands) else 0, 0)


def orientation_votes(hits: DataFrame, frags: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """frag, locus, windows (those that vote), orientation of each hit (see `orientation`)."""
    by_locus = refs.groupBy("locus").agg(F.sort_array(F.collect_list("seq")).alias("__refs"))
    pairs = hits.join(frags.select("frag", F.col("seq").alias("__read")), "frag").join(by_locus, "locus").select("frag", "locus", "__read", "__refs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [orientation_codes(a, [(x or "").encode() for x in b], k) for a, b in zip(_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int((c > 0).sum()) for c in found], pa.int64()), pa.array([orientation(c) for c in found], pa.int32())], names=["frag", "locus", "windows", "orientation"])

    return pairs.mapInArrow(run, f"frag {dict(frags.dtypes)['frag']}, locus {dict(refs.dtypes)['locus']}, windows bigint, orientation int")


def depth_stability(depths: str | Column) -> Column:
    """100 * median / (MAD + 1) of an array's depths over 0, with upper medians, in whole numbers; 0 if there is none."""
    found = F.filter(sequences.col(depths), lambda x: x > 0)
    score = lambda v, m: F.floor(m * 100 / (sequences.upper_median(F.transform(v, lambda x: F.abs(x - m))) + 1))
    return F.coalesce(sequences.let(found, lambda v: sequences.let(sequences.upper_median(v), lambda m: score(v, m))), F.lit(0)).cast("bigint")
