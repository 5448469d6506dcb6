import numpy as np
import pytest
import xxhash

from helixframe.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    parent = dict.fromkeys(nodes)
    parent = {k: k for k in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(nodes.items())
    for i, (a, fa) in enumerate(items):
        for b, fb in items[i + 1 :]:
            if bin((fa ^ fb) & (1 << 64) - 1).count("1") <= 4:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in S.fingerprints(odd).collect():
        assert r["fp"] == signed(brute_fingerprint(texts[r["doc_id"]]))
    assert S.fingerprint(b"") == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 25)]
    fps = {(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False))) & (1 << 64) - 1 for c in centres for _ in range(12)} | {0, 1, (1 << 64) - 1}
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(k, signed(v)) for k, v in nodes.items()], "node bigint, fp bigint")
    pairs = {(a, b) for a in nodes for b in nodes if a < b and bin(nodes[a] ^ nodes[b]).count("1") <= 4}
    links = S.links(df)
    assert {(r["a"], r["b"]) for r in links.collect()} == pairs
    assert {(r["a"], r["b"]) for r in S.links(df, blocks=5 + seed * 3).collect()} == pairs
    found = {r["node"]: r["component"] for r in S.components(links).collect()}
    want = brute_components(nodes)
    assert {k: found.get(k, k) for k in nodes} == want


def test_pairs_in_cells_grow_little_faster_than_fingerprints(spark):
    from pyspark.sql import functions as F

    def compared(n):
        df = spark.range(n).select(F.xxhash64("id").alias("fp")).withColumn("cell", F.explode(S.cells(S.embedding(F.col("fp")), S.blocks_for(n))))
        return df.groupBy("cell").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]

    # Those of 80,000 random fingerprints are fewer than three for each of them; by all pairs there would be 40,000.
    assert compared(80_000) < 3 * 80_000
    assert [S.blocks_for(n) for n in (0, 1 << 21, (1 << 21) + 1, 1 << 31, 1 << 40)] == [7, 7, 8, 10, 12]


def test_distances_agree_with_their_definition(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    pairs = [tuple(int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "x bigint, y bigint")
    counts = lambda v: [bin(v >> 2 * i & 3).count("1") for i in range(32)]
    for r in df.withColumn("d", S.embedded_distance(S.embedding(F.col("x")), S.embedding(F.col("y")))).collect():
        x, y = r["x"] & (1 << 64) - 1, r["y"] & (1 << 64) - 1
        assert r["d"] == sum(abs(a - b) for a, b in zip(counts(x), counts(y), strict=True)) <= bin(x ^ y).count("1")


def test_chain_has_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 102)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in (100, 101, 102)} == {100}


def test_groups_of_odd_rows(odd, none):
    rows = S.groups(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    want = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert S.groups(none).collect() == []
    assert S.deduplicated(odd).columns == odd.columns
