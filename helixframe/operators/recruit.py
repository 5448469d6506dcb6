"""Recruitment of fragments to reference loci by shared canonical k-mers.

The reference's k-mers form an index.  If it takes at most MOST_BROADCAST bytes, it goes to the executors as two
sorted arrays, and each task looks its fragments' k-mers up: fragments are neither exploded nor shuffled.  A
larger reference is joined by a shuffle on the k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import kernels
from helixframe.operators.tables import stored

#: Bytes of an index that is broadcast: a k-mer has 8, or k over 31 bases, and its locus 8.
MOST_BROADCAST = 64_000_000
#: Sequences of a batch that are looked up at once, and their bytes (one of more bytes is looked up alone).
ROWS, BYTES = 512, 500_000


def _parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of `rows` rows and BYTES bytes at most; a longer row is alone."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _rows(k: int) -> int:
    """Sequences whose k-mers are made at once; texts take a byte a base."""
    return ROWS if k <= kernels.MOST_K else max(ROWS // k, 1)


def _column(value: np.ndarray) -> pa.Array:
    return pa.array(value) if value.dtype.kind == "i" else pa.array(value.tolist(), pa.binary()).cast(pa.string())


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def seq_kmers(df: DataFrame, ids: list[str], seq: str, k: int, step: int = 1, once: bool = False, forward: bool = False) -> DataFrame:
    """ids, pos, kmer (canonical, 2 bits a base; a text for k over 31) of each valid window; or each k-mer of a row once,
    at its first pos.  With forward, those of the row's own strand (k up to 31)."""
    chosen = df.select(*ids, F.col(seq).cast("string").alias("__seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, _rows(k)):
            number, position, value = kernels.canonical(_texts(part.column(len(ids))), k, step, forward)
            if once and len(value):
                order = np.lexsort((value, number))
                new = np.ones(len(order), bool)
                new[1:] = (value[order][1:] != value[order][:-1]) | (np.diff(number[order]) != 0)
                number, position, value = (x[order[new]] for x in (number, position, value))
            take = pa.array(number)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(len(ids))), pa.array(position.astype(np.int32)), _column(value)], names=[*ids, "pos", "kmer"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*ids).dtypes)
    return chosen.mapInArrow(run, f"{fields}, pos int, kmer {'bigint' if k <= kernels.MOST_K else 'string'}")


def reference_index(refs: DataFrame, locus: str, seq: str, k: int) -> DataFrame:
    """kmer, locus: each pair once."""
    return seq_kmers(refs, [locus], seq, k, once=True).select("kmer", F.col(locus).alias("locus")).distinct()


def recruit(frags: DataFrame, frag: str, seqs: list[str], index: DataFrame, k: int, step: int = 1) -> DataFrame:
    """frag, locus: each locus of which any of the fragment's sequences has a k-mer; a fragment may have many.

    frags has one row for each fragment, all its sequences (both mates of a pair) in its columns `seqs`.
    """
    index = stored(index)
    kind = dict(index.dtypes)["locus"]
    if index.count() * _row_bytes(k) > MOST_BROADCAST:
        parts = [seq_kmers(frags, [frag], s, k, step).select(frag, "kmer") for s in seqs]
        return reduce(DataFrame.unionByName, parts).distinct().join(index, "kmer").select(frag, "locus").distinct()
    return _looked_up(frags, frag, seqs, [(k, index)], step, kind).select(frag, "locus")


def _row_bytes(k: int) -> int:
    return 8 + (8 if k <= kernels.MOST_K else k)


def _looked_up(frags: DataFrame, frag: str, seqs: list[str], indexes: list[tuple[int, DataFrame]], step: int, kind: str) -> DataFrame:
    """frag, locus, k: hits of the first of the broadcast indexes (k, kmer and locus) in which a fragment has any."""
    tables = []
    for k, index in indexes:
        table = index.toArrow()
        loci = sorted(set(table.column("locus").to_pylist()))
        number = {x: i for i, x in enumerate(loci)}
        keys = table.column("kmer").to_numpy() if k <= kernels.MOST_K else np.array([x.encode() for x in table.column("kmer").to_pylist()], f"S{k}")
        values = np.array([number[x] for x in table.column("locus").to_pylist()], np.int64)
        order = np.argsort(keys, kind="stable")
        if loci:
            tables.append((k, keys[order], values[order], loci))
    if not tables:
        return frags.select(F.col(frag)).limit(0).select(frag, F.lit(None).cast(kind).alias("locus"), F.lit(None).cast("int").alias("k"))
    shared = frags.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, min(_rows(k) for k, *_ in shared.value)):
            for k, keys, values, loci in shared.value:
                found = []
                for i in range(len(seqs)):
                    row, _, value = kernels.canonical(_texts(part.column(i + 1)), k, step)
                    low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
                    n = high - low
                    hit = n > 0
                    row, low, n = row[hit], low[hit], n[hit]
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(int(n.sum()))
                    found.append(np.unique(np.repeat(row, n) * len(loci) + values[at]))
                pairs = np.unique(np.concatenate(found))
                row = pairs // len(loci)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(loci).take(pa.array(pairs % len(loci))), pa.array(np.full(len(pairs), k, np.int32))], names=[frag, "locus", "k"])
                part = part.take(pa.array(np.setdiff1d(np.arange(part.num_rows), row)))
                if not part.num_rows:
                    break

    return frags.select(F.col(frag), *[F.col(s).cast("string") for s in seqs]).mapInArrow(run, f"`{frag}` {dict(frags.dtypes)[frag]}, locus {kind}, k int")


def recruit_tiered(frags: DataFrame, frag: str, seqs: list[str], refs: DataFrame, locus: str, seq: str, ks: list[int], step: int = 1) -> DataFrame:
    """frag, locus, k: shorter k, in turn, for fragments without a hit so far.  ks must fall and be 16 at least."""
    if any(a <= b for a, b in zip(ks, ks[1:], strict=False)) or min(ks) < 16:
        raise ValueError("k-mer sizes must fall strictly and be at least 16")
    indexes = [(k, stored(reference_index(refs, locus, seq, k))) for k in ks]
    if sum(index.count() * _row_bytes(k) for k, index in indexes) <= MOST_BROADCAST:
        return _looked_up(frags, frag, seqs, indexes, step, dict(refs.dtypes)[locus])  # fragments are read once
    rest, found = frags, None
    for k in ks:
        hits = stored(recruit(rest, frag, seqs, reference_index(refs, locus, seq, k), k, step).withColumn("k", F.lit(k)))
        found = hits if found is None else found.unionByName(hits)
        rest = rest.join(hits.select(frag).distinct(), frag, "left_anti")
    return found


def counts(hits: DataFrame, paired: bool = False) -> DataFrame:
    """locus, reads: 2 for each pair even if one mate alone hit."""
    return hits.groupBy("locus").agg((F.count(F.lit(1)) * (2 if paired else 1)).alias("reads"))


def unique_seeds(refs: DataFrame, locus: str, seq: str, k: int) -> DataFrame:
    """kmer, locus of the k-mers that one locus alone has."""
    pairs = reference_index(refs, locus, seq, k)
    return pairs.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("locus").alias("locus")).where("n = 1").select("kmer", "locus")


def panel_expansion(frags: DataFrame, frag: str, seqs: list[str], refs: DataFrame, locus: str, seq: str, subset: DataFrame, k: int, most_loci: int, step: int = 1) -> DataFrame:
    """frag, locus: fragments that hit the subset, judged against the full panel: those of at most most_loci loci,
    and of their loci the ones in the subset."""
    gate = stored(recruit(frags, frag, seqs, reference_index(refs.join(subset, locus, "left_semi"), locus, seq, k), k, step))
    full = recruit(frags.join(gate.select(frag).distinct(), frag, "left_semi"), frag, seqs, reference_index(refs, locus, seq, k), k, step)
    few = full.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(frag))).where(F.col("n") <= most_loci).drop("n")
    return few.join(subset.withColumnRenamed(locus, "locus"), "locus", "left_semi").select(frag, "locus")


def assign_pairs(first: DataFrame, second: DataFrame, frag: str, frags: DataFrame) -> DataFrame:
    """frag, state, locus from each mate's loci (frag, locus): one shared locus is strong, none with one mate
    unique and the other empty a rescue, no hit none, else ambiguous."""
    sets = lambda df, name: df.groupBy(frag).agg(F.collect_set("locus").alias(name))
    none = F.array().cast("array<" + dict(first.dtypes)["locus"] + ">")
    both = frags.select(frag).join(sets(first, "l1"), frag, "left").join(sets(second, "l2"), frag, "left").withColumns({"l1": F.coalesce("l1", none), "l2": F.coalesce("l2", none)})
    both = both.withColumn("shared", F.array_intersect("l1", "l2"))
    lone = (F.size("shared") == 0) & (F.size("l1") + F.size("l2") == 1)
    state = F.when(F.size("l1") + F.size("l2") == 0, "none").when(F.size("shared") == 1, "strong").when(lone, "rescue").otherwise("ambiguous")
    locus = F.when(F.size("shared") == 1, F.get("shared", F.lit(0))).when(lone, F.get(F.concat("l1", "l2"), F.lit(0)))
    return both.select(frag, state.alias("state"), locus.alias("locus"))


def expand_siblings(hits: DataFrame, frag: str, ordinal: str, cap: int = 256) -> DataFrame:
    """Direct hits and, for a locus X__R1 or X__R2, a hit of the other arm while the locus has had at most cap."""
    arms = hits.where(F.col("locus").rlike("__R[12]$")).withColumn("n", F.row_number().over(Window.partitionBy("locus").orderBy(ordinal)))
    other = F.concat(F.regexp_replace("locus", "__R[12]$", ""), F.when(F.col("locus").endswith("__R1"), "__R2").otherwise("__R1"))
    return hits.unionByName(arms.where(F.col("n") <= cap).withColumn("locus", other).drop("n")).dropDuplicates([frag, "locus"])


def fractional_support(hits: DataFrame, query: str, reference: str) -> DataFrame:
    """reference, hit_queries, fractional_queries (1/N for a query with N references), singleton_queries."""
    weight = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(query)))
    return weight.groupBy(reference).agg(F.count(F.lit(1)).alias("hit_queries"), F.sum(1 / F.col("n")).alias("fractional_queries"), F.sum((F.col("n") == 1).cast("bigint")).alias("singleton_queries"))


def kmer_depth(df: DataFrame, ids: list[str], seq: str, k: int) -> DataFrame:
    """kmer, depth: the reads (one a row) with the k-mer, each counted once."""
    return seq_kmers(df, ids, seq, k, once=True).groupBy("kmer").agg(F.count(F.lit(1)).alias("depth"))


#: Bases of a minimizer, letters for each bucket of counted_kmers, buckets at most, and pieces that a task holds before it sorts them by bucket.
MINIMIZER, LETTERS_A_BUCKET, MOST_BUCKETS, MOST_PIECES = 11, 4_000_000, 1 << 14, 1 << 21


def _minima(value: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that follow each other."""
    span = 1
    while 2 * span <= w:
        value, span = np.minimum(value[:-span], value[span:]), 2 * span
    return np.minimum(value[: len(value) - w + span], value[w - span :]) if span < w else value


def _pieces(texts: list[bytes], k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, bases, k-mers) of pieces of up to 32 bases, two bits each, which together have each
    canonical k-mer of each text once.  A bucket has all of a k-mer: it is that of the k-mer's least hashed m-mer of both strands."""
    codes, starts = kernels.joined_codes(texts)
    forward, reverse, valid = kernels.kmers(codes, k)
    at = np.flatnonzero(valid)
    number = np.searchsorted(starts, at, "right") - 1
    value = np.minimum(forward, reverse)[at]
    if 2 * k + len(texts).bit_length() < 64:  # both in one long
        first = np.unique(number << 2 * k | value, return_index=True)[1]
    else:
        order = np.lexsort((value, number))
        first = order[(np.diff(number[order], prepend=-1) != 0) | (np.diff(value[order], prepend=-1) != 0)]
    first.sort()
    at, number = at[first], number[first]
    m = min(MINIMIZER, k)
    short = np.minimum(*kernels.kmers(codes, m)[:2]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = _minima(short ^ short >> np.uint64(32), k - m + 1)[at] if len(at) else np.zeros(0, np.uint64)
    bucket = ((least * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(bucket, prepend=-1) != 0)
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % (33 - k) == 0
    head = np.flatnonzero(new)
    bases = kernels.windows(np.concatenate([codes, np.zeros(31, np.uint8)]), 32)[at[head]] if len(head) else np.zeros(0, np.int64)
    return number[head], bucket[head], bases, np.diff(head, append=len(at)).astype(np.uint8)


def _kmers_of(bases: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers of pieces."""
    back = ~bases.view(np.uint64)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        back = (back & np.uint64(mask)) << np.uint64(bits) | back >> np.uint64(bits) & np.uint64(mask)
    back, found, mask = back.byteswap(), [], np.uint64((1 << 2 * k) - 1)
    for i in range(33 - k):
        here = sizes > i
        found.append(np.minimum(bases.view(np.uint64)[here] >> np.uint64(2 * (32 - k - i)) & mask, back[here] >> np.uint64(2 * i) & mask))
    return np.concatenate(found).astype(np.int64)


def counted_kmers(df: DataFrame, group: str, seq: str, k: int, least: int = 1) -> DataFrame:
    """group, kmer, depth: the rows of a group that have a canonical k-mer, if `least` have it, each counted once; k is 31 at most.

    What is shuffled are pieces of texts, with k-mers that follow each other and whose minimizers are of one bucket, some one
    to two bytes for each k-mer.  A task expands and counts one bucket's, of about LETTERS_A_BUCKET letters, at a time."""
    letters = df.agg(F.sum(F.length(seq).cast("bigint"))).first()[0] or 0
    buckets = min(max(letters // LETTERS_A_BUCKET, df.sparkSession.sparkContext.defaultParallelism * 8), MOST_BUCKETS)
    chosen = df.select(F.col(group), F.col(seq).cast("string").alias("__seq"))
    kind = dict(chosen.dtypes)[group]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, n, type_ = [], {}, 0, None

        def told() -> pa.RecordBatch:
            of, bucket, bases, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            key = of * buckets + bucket
            order = np.argsort(key)
            key = key[order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(cuts, len(key))
            binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])])
            names = pa.array(list(numbers), type_).take(pa.array(key[cuts] // buckets))
            return pa.RecordBatch.from_arrays([pa.array(key[cuts] % buckets), names, binary(bases), binary(sizes)], names=["bucket", group, "bases", "sizes"])

        for part in _parts(batches):
            type_ = part.schema.field(0).type
            of = np.array([numbers.setdefault(x, len(numbers)) for x in part.column(0).to_pylist()], np.int64)
            number, *rest = _pieces(_texts(part.column(1)), k, buckets)
            held.append((of[number], *rest))
            n += len(number)
            if n > MOST_PIECES:
                yield told()
                held, numbers, n = [], {}, 0
        if n:
            yield told()

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, type_ = {}, None
        for batch in batches:
            type_ = batch.schema.field(group).type
            for x, bases, sizes in zip(batch.column(group).to_pylist(), batch.column("bases"), batch.column("sizes"), strict=True):
                held.setdefault(x, []).append((np.frombuffer(bases.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.uint8)))
        for x, pieces in held.items():
            kmer, depth = np.unique(_kmers_of(*(np.concatenate(c) for c in zip(*pieces, strict=True)), k), return_counts=True)
            kmer, depth = kmer[depth >= least], depth[depth >= least]
            yield pa.RecordBatch.from_arrays([pa.array([x], type_).take(pa.array(np.zeros(len(kmer), np.int64))), pa.array(kmer), pa.array(depth)], names=[group, "kmer", "depth"])

    pieces = chosen.mapInArrow(cut, f"bucket bigint, `{group}` {kind}, bases binary, sizes binary")
    spark = df.sparkSession
    tasks = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return pieces.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(count, f"`{group}` {kind}, kmer bigint, depth bigint")


#: Letters for each counter of deepest_kmers, counters at most, and counters of one row.
LETTERS_A_COUNTER, MOST_COUNTERS, SLICE = 16, 1 << 25, 1 << 14


def _bucket(value: np.ndarray, counters: int) -> np.ndarray:
    return (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _once(number: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, value), sorted, each value once for each number."""
    if 2 * k + ROWS.bit_length() < 64:  # both in one long
        both = np.sort(number << 2 * k | value)
        both = both[np.diff(both, prepend=-1) != 0]
        return both >> 2 * k, both & ((1 << 2 * k) - 1)
    order = np.lexsort((value, number))
    number, value = number[order], value[order]
    new = (np.diff(number, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0)
    return number[new], value[new]


def _bounds(df: DataFrame, seq: str, k: int, counters: int) -> DataFrame:
    """at, n: slices of the counters; a counter has the rows' k-mers, each once a row, whose hash is its number."""
    width = min(SLICE, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(counters, np.int32)
        for part in _parts(batches):
            number, _, value = kernels.canonical(_texts(part.column(0)), k)
            bucket, n = np.unique(_bucket(_once(number, value, k)[1], counters), return_counts=True)
            found[bucket] += n.astype(np.int32)
        for at in range(0, counters, width):
            n = found[at : at + width]
            if n.any():
                # Small numbers take a byte or two; the length tells.
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n.astype(np.min_scalar_type(int(n.max()))).tobytes()], pa.binary())], names=["at", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column("n"):
                total += np.frombuffer(x.as_buffer(), f"u{len(x.as_buffer()) // width}")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["at", "n"])

    parts = df.select(F.col(seq).cast("string")).mapInArrow(count, "at bigint, n binary")
    return stored(parts.groupBy("at").applyInArrow(add, "at bigint, n binary"), compression="zstd")


def _at_least(bounds: DataFrame, least: int, counters: int) -> np.ndarray:
    """Whether each counter has `least`; a bit each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x.as_buffer(), np.int64) >= least).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["at", "bits"])

    found = np.zeros(counters, bool)
    for at, bits in bounds.mapInArrow(run, "at bigint, bits binary").toLocalIterator():
        found[at : at + SLICE] = np.unpackbits(np.frombuffer(bits, np.uint8))[: min(SLICE, counters)]
    return found


def _depths_among(df: DataFrame, seq: str, k: int, wanted: np.ndarray) -> DataFrame:
    """kmer, depth of the k-mers whose counters are wanted."""
    counters = len(wanted)
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.unpackbits(shared.value)[:counters].astype(bool)
        for part in _parts(batches):
            number, _, value = kernels.canonical(_texts(part.column(0)), k)
            keep = mine[_bucket(value, counters)]
            kmer, n = np.unique(_once(number[keep], value[keep], k)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(n)], names=["kmer", "n"])

    return df.select(F.col(seq).cast("string")).mapInArrow(run, "kmer bigint, n bigint").groupBy("kmer").agg(F.sum("n").alias("depth"))


def deepest_kmers(df: DataFrame, seq: str, k: int, most: int, least: int = 2) -> DataFrame:
    """kmer, depth (see kmer_depth) of all k-mers that may be among the `most` deepest, of `least` depth at least, k being 31 at most.

    A counter of hashed k-mers bounds the depth of each of its k-mers from above.  K-mers of the greatest counters are
    counted first; the depth that `most` of them reach then tells which other counters may hold deeper ones.  So k-mers
    are shuffled only if their counter is great enough, and all that can count are.
    """
    letters = df.agg(F.sum(F.length(seq).cast("bigint"))).first()[0] or 0
    counters = 1 << min(max(letters // LETTERS_A_COUNTER, 8), MOST_COUNTERS).bit_length() - 1
    bounds = _bounds(df, seq, k, counters)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                n, times = np.unique(np.frombuffer(x.as_buffer(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times)], names=["n", "times"])

    times = bounds.mapInArrow(histogram, "n bigint, times bigint").groupBy("n").agg(F.sum("times").alias("times"))
    cut, total = least, 0
    for n, many in times.where(F.col("n") >= least).orderBy(F.desc("n")).limit(2 * most).collect():
        cut, total = n, total + many
        if total >= 2 * most:
            break
    found = stored(_depths_among(df, seq, k, _at_least(bounds, cut, counters)))
    reached = found.orderBy(F.desc("depth")).limit(most).agg(F.count(F.lit(1)), F.min("depth")).first()
    enough = max(reached[1], least) if reached[0] == most else least
    if enough < cut:
        found = stored(_depths_among(df, seq, k, _at_least(bounds, enough, counters)))
    return found.where(F.col("depth") >= least)


def pseudo_align(frags: DataFrame, frag: str, seq: str, index: DataFrame, k: int, least_share: float = 0.8, least_relevant: float = 0.5) -> DataFrame:
    """frag, locus, hits, relevant, total: references that hold `least_share` of the fragment's k-mers which any holds,
    for fragments of whose distinct k-mers `least_relevant` are such."""
    words = stored(seq_kmers(frags, [frag], seq, k, once=True).select(frag, "kmer"))
    total = words.groupBy(frag).agg(F.count(F.lit(1)).alias("total"))
    known = words.join(index.select("kmer").distinct(), "kmer", "left_semi")
    relevant = known.groupBy(frag).agg(F.count(F.lit(1)).alias("relevant"))
    hits = known.join(index, "kmer").groupBy(frag, "locus").agg(F.count(F.lit(1)).alias("hits"))
    both = hits.join(relevant, frag).join(total, frag)
    return both.where((F.col("hits") >= F.col("relevant") * least_share) & (F.col("relevant") >= F.col("total") * least_relevant)).select(frag, "locus", "hits", "relevant", "total")


def marker_support(alignments: DataFrame, query: str, reference: str) -> DataFrame:
    """fractional_support with ambiguity_status."""
    found = fractional_support(alignments, query, reference)
    return found.withColumn("ambiguity_status", F.when(F.col("singleton_queries") > 0, "has_singleton_support").otherwise("shared_only"))


def solid_minimizers(df: DataFrame, ids: list[str], seq: str, k: int, least: int) -> DataFrame:
    """ids, kmer: the least canonical k-mer of each row that occurs `least` times over all rows."""
    words = stored(seq_kmers(df, ids, seq, k).select(*ids, "kmer"))
    solid = words.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("kmer")
    return words.join(solid, "kmer", "left_semi").groupBy(*ids).agg(F.min("kmer").alias("kmer"))


def decode(kmer: str, k: int):
    """The text of a k-mer."""
    if k > kernels.MOST_K:
        return F.col(kmer)
    digits = F.lpad(F.conv(F.col(kmer).cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", "ACGT")
