"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of the text's four-word shingles.
Fingerprints are embedded as the bit counts of their 32 two-bit segments.  The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints within MAX_BITS differing
bits lie within Manhattan distance MAX_BITS.

Range join on a grid: the segments form `n` blocks.  A distance of at most 4 touches four blocks at most, so that
embeddings within it are equal in n - 4 blocks.  A cell of the grid is the counts of n - 4 of the blocks; each
fingerprint stands in a cell for each choice of them, and pairs within the distance share a cell whichever n is.
With seven blocks a cell has three, of some 20 bits; more fingerprints get more blocks, whose cells are finer
(blocks_for), so that the pairs compared stay near the number of fingerprints.  The join condition drops pairs over the
Manhattan bound, then those over the exact Hamming distance, so that the join's rows are links alone.

Fingerprints are made distinct before the join and members come back by their fingerprint, so copies cost
nothing here.  Links are closed to components by alternating star contraction, written to the shared folder
after each round.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like
any other; fewer than four words make one shingle; a long text's bits are counted in parts, all of it; a bit that half
the hashes have is 0; rows that repeat a doc_id each come out, linked by their own texts alone; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import digest, in_small_batches, join_groups, only_kept, table, written

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 32
#: Blocks of the grid up to so many fingerprints; see above.  Bits of a cell: 1.5 for each segment in it.
BLOCKS = ((7, 1 << 21), (8, 1 << 25), (9, 1 << 28), (10, 1 << 31))
MOST_BLOCKS = 12
LOW = 0x5555555555555555
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingles(text: bytes, width: int = SHINGLE_WORDS) -> list[bytes]:
    """Space-joined windows of `width` words; the whole sequence if there are fewer; none without words."""
    words = text.lower().split()  # bytes: A-Z alone, and space, \t, \n, \v, \f, \r
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return [joined[s:e] for s, e in zip(starts[:-width].tolist(), (starts[width:] - 1).tolist(), strict=True)]


def fingerprint(text: bytes) -> int:
    found = shingles(text)
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint16 if len(bits) < 65536 else np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(documents: DataFrame, text_sha256: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; with text_sha256, that column too."""
    more = [] if text_sha256 is None else [text_sha256.alias("text_sha256")]
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint" + (", text_sha256 string" if more else ""))


def embedding(fp: Column) -> Column:
    """The bit counts of all two-bit segments, two bits each."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sum, bit by bit


def embedded_distance(x: Column, y: Column) -> Column:
    """Manhattan distance of two embeddings: counts 0, 1, 2 that differ by two differ in the high bit alone."""
    z = x.bitwiseXOR(y)
    return F.bit_count(z.bitwiseAND(F.lit(LOW))) + 2 * F.bit_count(F.shiftrightunsigned(z, 1).bitwiseAND(F.bitwise_not(z)).bitwiseAND(F.lit(LOW)))


def blocks_for(fingerprints: int) -> int:
    """Blocks of the grid for so many fingerprints; any number from MAX_BITS + 1 on gives the same links."""
    return next((n for n, most in BLOCKS if fingerprints <= most), MOST_BLOCKS)


def cells(embedded: Column, blocks: int) -> Column:
    """The grid cells of an embedding: a hash of each choice of `blocks` - MAX_BITS blocks' counts."""
    borders = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in pairwise(borders)]
    chosen = [sum(x) for x in combinations(masks, blocks - MAX_BITS)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chosen]
    # The choice's mask goes into the hash; equal hashes of different cells only add pairs, which the distance drops.
    return F.array(*[F.xxhash64(embedded.bitwiseAND(F.lit(x)), F.lit(x)) for x in signed])


def links(nodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """a, b: nodes of all pairs of nodes (node, fp) whose fingerprints differ in MAX_BITS bits at most, a pair once."""
    n = blocks or blocks_for(nodes.count())
    in_cells = nodes.select("node", "fp", F.explode(cells(embedding(F.col("fp")), n)).alias("cell"))
    # Both sides are one shuffle, which Spark uses twice.
    left = in_cells.select(F.col("node").alias("a"), F.col("fp").alias("fa"), "cell")
    right = in_cells.select(F.col("node").alias("b"), F.col("fp").alias("fb"), "cell")
    near = (embedded_distance(embedding(F.col("fa")), embedding(F.col("fb"))) <= MAX_BITS) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS)
    same = left["cell"] == right["cell"]
    return left.join(right.hint("merge"), same & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of edges (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps; each halves what is left to contract, so that a few rounds do.
    """

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        """Joins each node's neighbours, the larger ones or else the others, to its least."""
        arcs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            arcs = arcs.where(F.col("b") < F.col("a"))
        least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = (arcs if small else arcs.where(F.col("b") > F.col("a"))).join(least, "a")
        moved = moved.select(F.col("m").alias("a"), "b")
        if small:
            moved = moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return moved.where(F.col("a") < F.col("b")).distinct()

    pairs = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), "links")
    state = None
    while True:
        # How many pairs, and a sum that tells them apart: no change means that every node hangs on its least.
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        pairs = written(stars(stars(pairs, False), True), "stars")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of documents."""
    return _grouped(fingerprints(documents)).drop("root")


def _grouped(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp and maybe more) with component_id and root, the component's smallest fingerprint."""
    rows = written(prints, "fingerprints")
    copies = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    reached = written(components(links(copies.select(F.col("fp").alias("node"), "fp"))), "components")
    linked = reached.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    copies = written(copies.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    # A component may hold a third of all fingerprints: the join back deals such a one over tasks.
    sizes = copies.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    found = join_groups(copies.drop("doc_id"), written(sizes, "component-ids"), "root", "size", copies.count()).drop("size")
    return join_groups(rows, written(found, "fingerprint-components"), "fp", "n", rows.count()).drop("n")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id and of such rows the smallest digest, with all its columns."""
    found = written(_grouped(fingerprints(documents, digest(F.col("text")))), "near-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    first = written(found.groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("size")), "component-firsts")
    marked = join_groups(found, first, "root", "size", found.count())
    return only_kept(documents, marked.select("doc_id", "text_sha256", rank.eqNullSafe(F.col("first")).alias("kept")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
