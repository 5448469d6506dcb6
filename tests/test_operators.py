import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequences
from helixframe.operators import alignment as A
from helixframe.operators import assembly as G
from helixframe.operators import cleaning, cohort, evidence, graph, organelle, population, rad, recruit, repeats, selection, trees, workflow

rng = random.Random(3)


def dna(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return "".join(r.choice("ACGT") for _ in range(n))


# Recruitment ---------------------------------------------------------------------------------------------


def frames(spark, refs, frags):
    return spark.createDataFrame(refs, "locus bigint, seq string"), spark.createDataFrame(frags, "frag bigint, seq string")


@pytest.mark.parametrize("k", [21, 35])
def test_recruit_both_ways_and_both_strands(spark, monkeypatch, k):
    a, b = dna(100, 1), dna(100, 2)
    reads = [(1, a[10:60]), (2, A.reverse_complement(b[20:70])), (3, a[:40] + b[:40]), (4, dna(80, 3)), (5, None), (6, ""), (7, a[:20] + "N" + a[21:40])]
    refs, frags = frames(spark, [(1, a), (2, b)], reads)
    index = recruit.reference_index(refs, "locus", "seq", k)
    want = {(1, 1), (2, 2), (3, 1), (3, 2)}
    assert {tuple(r) for r in recruit.recruit(frags, "frag", ["seq"], index, k).collect()} == want
    monkeypatch.setattr(recruit, "MOST_BROADCAST", 10)
    assert {tuple(r) for r in recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", k), k).collect()} == want


def test_each_of_three_sequences_counts_both_ways(spark, monkeypatch):
    a, b, c = dna(60, 11), dna(60, 12), dna(60, 13)
    refs = spark.createDataFrame([(0, a), (1, b), (2, c)], "locus bigint, seq string")
    frags = spark.createDataFrame([(1, a[:40], b[:40], c[:40])], "frag bigint, r1 string, r2 string, r3 string")
    found = lambda: sorted(r["locus"] for r in recruit.recruit(frags, "frag", ["r1", "r2", "r3"], recruit.reference_index(refs, "locus", "seq", 21), 21).collect())
    assert found() == [0, 1, 2]
    monkeypatch.setattr(recruit, "MOST_BROADCAST", 10)
    assert found() == [0, 1, 2]


def test_either_mate_suffices_and_pairs_count_twice(spark):
    a = dna(75, 5)
    refs = spark.createDataFrame([(1, a)], "locus bigint, seq string")
    frags = spark.createDataFrame([(1, a[:25], A.reverse_complement(a[35:60])), (2, dna(25, 8), a[40:70])], "frag bigint, r1 string, r2 string")
    found = lambda k: recruit.recruit(frags, "frag", ["r1", "r2"], recruit.reference_index(refs, "locus", "seq", k), k)
    assert found(31).count() == 0 and found(21).count() == 2
    assert tuple(recruit.counts(found(21), paired=True).first()) == (1, 4)


def test_empty_reference_and_tiers(spark):
    a = dna(60, 9)
    refs, frags = frames(spark, [(1, a)], [(1, a[:22]), (2, a[:40])])
    assert recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs.limit(0), "locus", "seq", 21), 21).count() == 0
    tiers = {tuple(r) for r in recruit.recruit_tiered(frags, "frag", ["seq"], refs, "locus", "seq", [31, 21]).collect()}
    assert tiers == {(2, 1, 31), (1, 1, 21)}
    for ks in ([21, 31], [31, 15]):
        with pytest.raises(ValueError):
            recruit.recruit_tiered(frags, "frag", ["seq"], refs, "locus", "seq", ks)


def test_assign_pairs(spark):
    frags = spark.createDataFrame([(i,) for i in range(5)], "frag bigint")
    first = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (2, 8)], "frag bigint, locus bigint")
    second = spark.createDataFrame([(0, 7), (3, 9), (2, 9)], "frag bigint, locus bigint")
    found = {r["frag"]: (r["state"], r["locus"]) for r in recruit.assign_pairs(first, second, "frag", frags).collect()}
    assert found == {0: ("strong", 7), 1: ("rescue", 7), 2: ("ambiguous", None), 3: ("rescue", 9), 4: ("none", None)}


def test_siblings_and_fractions(spark):
    hits = spark.createDataFrame([(1, "u__R1"), (2, "u__R1"), (3, "v")], "frag bigint, locus string")
    found = {tuple(r) for r in recruit.expand_siblings(hits, "frag", "frag", 1).collect()}
    assert found == {(1, "u__R1"), (2, "u__R1"), (3, "v"), (1, "u__R2")}
    rows = {r["locus"]: (r["hit_queries"], r["fractional_queries"], r["singleton_queries"]) for r in recruit.fractional_support(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "frag bigint, locus string"), "frag", "locus").collect()}
    assert rows == {"a": (2, 1.5, 1), "b": (1, 0.5, 0)}


def test_decode(spark):
    word = "ACGTTGCAACGTACGTACGTTTT"
    found = recruit.seq_kmers(spark.createDataFrame([(1, word)], "id bigint, seq string"), ["id"], "seq", 23)
    assert found.select(recruit.decode("kmer", 23)).first()[0] == min(word, A.reverse_complement(word))


# Evidence ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("codes", "want"), [([], 0), ([0, 0], 0), ([3, 0], 3), ([1, 1, 0], 1), ([2], 2), ([1] * 40 + [2] * 3, 1), ([1, 2] * 10, 3), ([2] * 30 + [1] * 25, 2)])
def test_orientation(codes, want):
    assert evidence.orientation(np.array(codes, int)) == want


def test_longest_match_against_brute_force():
    for seed in range(30):
        a, b = dna(60, seed), dna(40, seed + 100)
        cut = a[10 : 10 + seed % 30 + 5]
        b = b[:15] + (cut if seed % 2 else A.reverse_complement(cut)) + b[15:]
        best = None
        for strand, target in ((1, b), (2, A.reverse_complement(b))):
            for r in range(len(target)):
                for q in range(len(a)):
                    if q and r and a[q - 1] == target[r - 1]:
                        continue
                    n = 0
                    while q + n < len(a) and r + n < len(target) and a[q + n] == target[r + n]:
                        n += 1
                    if n >= 7 and (best is None or n > best[3]):
                        best = (strand, q, r, n)
        assert evidence.longest_match(a.encode(), b.encode(), 7) == best


def test_intervals_and_islands(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 5, 12), ("x", 12, 15), ("x", 20, 30), ("y", 1, 2)], "k string, a int, b int")
    rows = {r["k"]: r.asDict() for r in evidence.interval_support(df, ["k"], "a", "b").collect()}
    assert (rows["x"]["supported"], rows["x"]["extent"], rows["x"]["max_gap"], rows["x"]["islands"], rows["x"]["reads"]) == (25, 30, 5, 2, 4)
    assert rows["y"]["breadth"] == 1.0


def test_bin_mask(spark):
    df = spark.createDataFrame([(0, 10, 640), (0, 640, 640), (630, 640, 640), (5, 16, 640)], "a int, b int, n int")
    found = [r[0] for r in df.select(evidence.bin_mask(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert found == [1, -1, -(1 << 63), 3]
    assert evidence.verify_k(31) == 19 and evidence.verify_k(21) == 11


def test_pair_rule_and_stability(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (1, 2), (0, 0), (3, 3), (0, 1)], "a int, b int")
    assert [r[0] for r in df.select(evidence.pair_kept(F.col("a"), F.col("b"))).collect()] == [False, False, True, True, True, True]
    assert [r[0] for r in df.select(evidence.pair_kept(F.col("a"), F.col("b"), True)).collect()] == [False, False, True, False, True, True]
    depths = spark.createDataFrame([([10, 10, 0, 12, 30],), ([0],), ([],)], "d array<int>")
    assert [r[0] for r in depths.select(evidence.depth_stability("d")).collect()] == [100 * 12 // 3, 0, 0]


# Selection -----------------------------------------------------------------------------------------------


def test_choose_exact():
    choose = selection.choose_exact
    assert choose({}, 100, 31, 50, 200, 6) == (None, None, 0)
    assert choose({40: 1000}, 100, 31, 50, 200, 6) == (None, None, 1000)
    assert choose({31: 20_000, 45: 15_000}, 100, 31, 50, 200, 6) == (33, None, 15_000)
    assert choose({31: 30_000}, 100, 31, 50, 200, 6) == (None, None, 30_000)
    k, interval, _ = choose({60: 40_000_000}, 1e6, 31, 50, 768, 6)
    assert k is not None and interval == 6


def test_small_loci_pass_through(spark):
    rows = [(1, i, 100, 40, 1, 2, 0, 0, 0, 1, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "locus int, id bigint, bases bigint, max_exact int, locus_count int, mates int, left_extension int, right_extension int, terminal_mask int, covered_bins bigint, bin int")
    found = selection.select_auto(df, 10.0)
    assert found.where("selected").count() == 20 and found.first()["mode"] == "pass_through"


def test_smallest_hashes_are_shared_by_a_taxon(spark):
    df = spark.createDataFrame([(t, f"{t}{s}", f"{i:03}") for t, n in (("x", 2), ("y", 1)) for s in range(n) for i in range(10)], "taxon string, sample string, h string")
    found = {r["sample"]: r["count"] for r in selection.smallest_hashes(df, "sample", "h", 6, "taxon").groupBy("sample").count().collect()}
    assert found == {"x0": 3, "x1": 3, "y0": 6}


# Graphs --------------------------------------------------------------------------------------------------


def test_components_and_bridges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (52, 51)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in (50, 51, 52)} == {50}
    parts = graph.bridge_components([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], list(range(7)))
    assert sorted(map(sorted, parts)) == [[0, 1, 2], [3, 4, 5], [6]]


def test_sketch_pairs_against_brute_force(spark):
    r = random.Random(6)
    sets = {i: sorted({r.randint(0, 30) + 100 * (i // 4) for _ in range(12)} | {7}) for i in range(24)}
    df = spark.createDataFrame(list(sets.items()), "id bigint, s array<bigint>")
    for cap in (128, 5):
        few = {v for v, n in Counter(v for s in sets.values() for v in s).items() if n <= cap}
        want = {(a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b]) & few and len(set(sets[a]) & set(sets[b])) >= 0.3 * len(set(sets[a]) | set(sets[b]))}
        assert {(x["a"], x["b"]) for x in graph.sketch_pairs(df, "id", "s", 0.3, cap).collect()} == want


def test_similar_pairs_of_a_group_beyond_any_cap(spark, monkeypatch):
    r = random.Random(8)
    base = r.sample(range(10**6), 30)
    sets = {i: set(base) for i in range(140)} | {i: set(base[:29]) | {10**6 + i} for i in range(140, 290)} | {290: set(), 291: set(), 292: {5}}
    sets |= {i: {r.randint(0, 14) + 100 * (i % 3) for _ in range(12)} for i in range(300, 400)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, s array<bigint>")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        found = graph.similar_pairs(df, "id", "s", least).collect()
        assert len(found) == len(want) and {(x["a"], x["b"]): x["jaccard"] for x in found} == want
        edges = graph.similarity_edges(df, "id", "s", least)
        rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        stars = {(rep[i], i): 1.0 for i in sets if rep[i] < i and sets[i]}
        rows = edges.collect()
        assert len(rows) == len({(x["a"], x["b"]) for x in rows})
        assert {(x["a"], x["b"]): x["jaccard"] for x in rows} == stars | {(a, b): j for (a, b), j in want.items() if rep[a] == a and rep[b] == b}
        part = graph.connected_components(edges)
        whole = graph.connected_components(spark.createDataFrame(list(want), "a bigint, b bigint"))
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))
        links = Counter(i for pair in want for i in pair)
        label = dict(map(tuple, whole.collect()))
        for block in (1024, 40) if least == 0.8 else ():
            monkeypatch.setattr(graph, "BLOCK_ROWS", block)
            rows = graph.similarity_links(df, "id", "s", least).collect()
            assert {r["id"]: (r["rep"], r["component"], r["links"]) for r in rows} == {i: (rep[i], label.get(i, i), links[i]) for i in sets if sets[i]} and len(rows) == sum(map(bool, sets.values()))
    assert graph.similar_pairs(df.limit(0), "id", "s", 0.8).collect() == [] and graph.similarity_links(df.limit(0), "id", "s", 0.8).collect() == []
    copies = spark.range(600).select("id", F.when(F.col("id") < 500, F.array(F.lit(7), F.lit(9))).otherwise(F.array("id")).cast("array<bigint>").alias("s"))
    assert sorted((x["a"], x["b"], x["jaccard"]) for x in graph.similarity_edges(copies, "id", "s", 0.8).collect()) == [(0, i, 1.0) for i in range(1, 500)]


def test_largest_components_and_read_cap(spark):
    labels = spark.createDataFrame([(i, c) for c, n in ((1, 3), (2, 5), (3, 5), (4, 2)) for i in range(n)], "node bigint, component bigint")
    assert [tuple(r) for r in graph.largest_components(labels, 3, 2).collect()] == [(1, 2, 5), (2, 3, 5)]
    assert graph.largest_components(labels.limit(0)).collect() == []
    reads = spark.createDataFrame([(0,), (selection.BLOCK_READS - 1,), (selection.BLOCK_READS,)], "n bigint")
    assert [selection.read_cap(reads, "n", blocks).count() for blocks in (0, 1, 2)] == [3, 2, 3]
    assert [r["n"] for r in selection.smallest_of_cohort(reads, ["n"], 2).collect()] == [0, selection.BLOCK_READS - 1]


def test_back_translation_and_alignment_qc(spark):
    df = spark.createDataFrame([("M-K-", "ATGAAACC"), ("MK", "ATGAA"), ("--", ""), ("", "ATG"), (None, "ATG"), ("M", None)], "a string, c string")
    assert [r[0] for r in df.select(sequences.back_translate("a", "c")).collect()] == ["ATG---AAA---", None, "------", "", None, None]
    rows = [("x", 1, "ACX-NA"), ("x", 2, "AC---A"), ("x", 3, "A-X--*"), ("y", 1, "AC"), ("y", 2, "ACG"), ("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, s string")
    found = lambda unit: {r["g"]: (r["columns"], r["effective"], r["fraction"]) for r in cohort.alignment_qc(df, ["g"], "s", "o", unit).collect()}
    assert found(1) == {"x": (6, 3, 0.5), "y": (2, 0, 0.0), "z": (0, 0, 0.0)}
    assert found(3) == {"x": (2, 0, 0.0), "y": (0, 0, 0.0), "z": (0, 0, 0.0)}


def test_transitions_and_mate_links(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "b"), (1, 5, "a")], "read int, o int, g string")
    assert [tuple(r) for r in graph.transitions(df, "read", "o", "g").collect()] == [("a", "b", 2)]
    hits = spark.createDataFrame([(1, "s", "x"), (1, "s", "x"), (1, "s", "y"), (2, "s", "x"), (2, "s", "y")], "read int, source string, target string")
    assert [tuple(r) for r in graph.mate_links(hits, "read", "source", "target").collect()] == [("s", "x", 1)]


# Alignment -----------------------------------------------------------------------------------------------


def naive_score(q, r, s):
    h = np.zeros((len(q) + 1, len(r) + 1))
    e = np.full_like(h, -1e9)
    f = np.full_like(h, -1e9)
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            e[i, j] = max(h[i, j - 1] + s.opening, e[i, j - 1] + s.extending)
            f[i, j] = max(h[i - 1, j] + s.opening, f[i - 1, j] + s.extending)
            h[i, j] = max(0, h[i - 1, j - 1] + (s.match if q[i - 1] == r[j - 1] else s.mismatch), e[i, j], f[i, j])
    return int(h.max())


@pytest.mark.parametrize("scores", [A.AFFINE, A.LINEAR, A.SHORT])
def test_local_alignment_against_naive(scores):
    for seed in range(40):
        a = dna(40, seed)
        b = a[3:15] + dna(seed % 5, seed + 1) + a[18:33] + dna(6, seed + 2)
        found = A.local_align(a, b, scores)
        assert found.score == naive_score(a, b, scores)
        assert found.query_end - found.query_start + found.reference_end - found.reference_start == 2 * (found.matches + found.mismatches) + found.gaps
    assert A.local_align("", "ACGT") == A.NONE and A.local_align("AAAA", "CCCC").score == 0


def test_gates_and_repeats():
    a = dna(300, 7)
    assert A.passes_gate(A.local_align(a[:60], a), 45, 0.8) and not A.passes_gate(A.local_align(a[:30], a), 45, 0.8) and A.passes_gate(A.NONE, 0, 0)
    assert A.has_long_inverted_repeat(a[:200] + dna(50, 1) + A.reverse_complement(a[:200])) and not A.has_long_inverted_repeat(a)
    assert A.best_diagonal(a[50:150], a)[:2] == (1.0, 1.0) and A.best_diagonal(a[50:150], a)[2] == 50
    assert A.foldback(a[:100] + A.reverse_complement(a[:100])) == 1.0 and A.foldback("ACGT") == 0.0
    assert A.unsupported_gap(a, [a[:120], a[180:]]) == 60 and A.unsupported_gap(a, [a]) == 0
    assert A.banded(a[100:150], a, 0, 100, 10).reference_start == 100


def test_own_and_foreign(spark):
    df = spark.createDataFrame([("q", "a", "a", 90), ("q", "a", "b", 40), ("p", "a", "b", 10)], "q string, own string, target string, score int")
    rows = {r["q"]: (r["best_score"], r["foreign_score"], r["score_delta"]) for r in A.best_and_foreign(df, "q", "own", "target").collect()}
    assert rows == {"q": (90, 40, 50), "p": (0, 10, -10)}


# Assembly ------------------------------------------------------------------------------------------------


def test_assembly_recovers_a_locus(spark):
    genome = dna(400, 11)
    reads = [genome[i : i + 100] for i in range(0, 301, 5)] + [A.reverse_complement(genome[i : i + 100]) for i in range(0, 301, 10)]
    refs = spark.createDataFrame([(1, genome[150:250]), (2, dna(100, 12))], "locus bigint, seq string")
    rows = {r["locus"]: r for r in G.assemble(spark.createDataFrame([(1, r) for r in reads], "locus bigint, seq string"), refs, 31).collect()}
    assert rows[1]["contig"] in (genome[5:-5], genome) or rows[1]["contig"] in genome or A.reverse_complement(rows[1]["contig"]) in genome
    assert rows[1]["accepted"] and rows[1]["selected_contig_length"] > 350 and rows[1]["slice_support_breadth"] > 0.95
    assert rows[2]["status"] == "no reads"


def test_kmer_counts_count_a_read_once():
    counts = G.kmer_counts(["ACGTACGTAA", "ACGTA"], 4)
    assert counts["ACGT"] == 2 and counts["GTAA"] == counts["TTAC"] == 1
    assert G.windows("ACNGTU", 2) == ["AC", "GT", "TT"]


def test_reference_places():
    found = G.reference_kmers(["AACCGGTTAC"], 4)
    assert found["AACC"][1] == 1000 and not found["AACC"][2] and found["GTTA"][0] >= 1


def test_unitigs_and_bubbles():
    a, b, c = dna(40, 1), dna(20, 2), dna(20, 3)
    d = dna(40, 4)
    words = {w for s in (a + b + d, a + c + d) for w in G.windows(s, 15)}
    paths, edges = G.unitigs(words, 15)
    assert len(paths) == 4 and len(edges) == 4 and sum(len(p) - 14 for p in paths) == len(words)
    path = G.resolve_path({i: (1, 1, len(p)) for i, p in enumerate(paths)}, dict.fromkeys(edges, 1))
    assert len(path) == 3 and [x[2] for x in G.bubbles(edges, path)] == ["simple"]
    ring = "ACGGTCAATG"
    circle, loops = G.unitigs({(ring * 2)[i : i + 5] for i in range(10)}, 5)
    assert len(circle) == 1 and loops == [(0, 0)]


def test_em_abundance(spark):
    share = G.em_abundance([((0,), 30), ((1,), 10), ((0, 1), 40)], 2)
    assert abs(share[0] - 0.75) < 1e-6 and abs(share.sum() - 1) < 1e-9
    df = spark.createDataFrame([(1, i, v) for i in range(4) for v in ("a", "b") if v == "a" or i == 3], "g int, f int, v string")
    rows = {r["v"]: (r["fragments"], r["diagnostic"]) for r in G.abundance(df, "g", "f", "v").collect()}
    assert rows == {"a": (4, 3), "b": (1, 0)}


# Cohort --------------------------------------------------------------------------------------------------


def test_consensus_ties_and_gaps(spark):
    rows = [(1, "A", 1), (1, "C", 1), (2, "A", 9), (2, "C", 1), (3, "-", 5), (3, "G", 5), (4, "-", 3)]
    found = {r["p"]: (r["coverage"], r["bases"], r["code"]) for r in cohort.threshold_consensus(spark.createDataFrame(rows, "p int, b string, n bigint"), ["p"], "b", "n", 0.75).collect()}
    assert found == {1: (2, "AC", "M"), 2: (10, "A", "A"), 3: (10, "-G", "g"), 4: (3, "-", "-")}


def test_pileup(spark):
    from helixframe.functions.sequences import cigar_ops

    df = spark.createDataFrame([("u", 0, "2M1I2M", "ACTGT"), ("u", 0, "2M200D2M", "ACGT")], "ref string, pos int, cigar string, seq string").withColumn("ops", cigar_ops("cigar"))
    found = {(r["position"], r["base"]): r["n"] for r in cohort.pileup(df, "ref", "pos", "ops", "seq").collect()}
    assert found == {(0, "A"): 2, (1, "C"): 2, (2, "G"): 1, (3, "T"): 1, (202, "G"): 1, (203, "T"): 1}


def test_supermatrix_and_partitions(spark):
    df = spark.createDataFrame([("s1", "a", "ACG"), ("s1", "b", "TT"), ("s2", "b", "GG")], "sp string, locus string, seq string")
    assert {r["sp"]: r["sequence"] for r in cohort.supermatrix(df, "sp", "locus", "seq").collect()} == {"s1": "ACGTT", "s2": "---GG"}
    assert [tuple(r) for r in cohort.partitions(df, "locus", "seq").orderBy("start").collect()] == [("a", 1, 3), ("b", 4, 5)]


def test_states(spark):
    df = spark.createDataFrame([(50, 9, 0), (200, 3, 1), (200, 0, 5), (200, 3, 9)], "e bigint, s bigint, a bigint")
    assert [r[0] for r in df.select(cohort.presence(F.col("e"), F.col("s"), F.col("a"))).collect()] == ["NA", "PRESENT", "ABSENT", "NA"]


def test_site_rules(spark):
    sites = spark.createDataFrame([("u1", 10, 1.0, 40, 10.0, 5.0), ("u1", 20, 0.5, 99, 10.0, 99.0)], "locus string, position bigint, call_rate double, gq int, dp double, qual double")
    assert population.one_site_per_locus(sites, "locus").first()["position"] == 10
    df = spark.createDataFrame([("0/1",), ("./.",), ("1|1",), ("0/.",)], "gt string")
    assert [r[0] for r in df.select(population.called(F.col("gt"))).collect()] == [True, False, True, False]


def test_linkage_and_components(spark):
    rows = [("c", 1, [0.0, 1.0, 2.0, 1.0]), ("c", 2, [0.0, 1.0, 2.0, 1.0]), ("c", 3, [0.0, 2.0, 0.0, 1.0]), ("c", 900, [0.0, 1.0, 2.0, 1.0])]
    kept = population.prune_linked(spark.createDataFrame(rows, "chrom string, pos bigint, d array<double>"), "chrom", "pos", "d", 0.5, 100)
    assert sorted(r["pos"] for r in kept.collect()) == [1, 3, 900]
    x = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = np.array([[r["pc1"], r["pc2"]] for r in population.principal_components(df, "v", 2).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


# Other workflows -----------------------------------------------------------------------------------------


def test_trim_and_clean(spark):
    seqs = spark.createDataFrame([("q", "AACCGGTT"), ("p", "ACGTACGTAC")], "id string, seq string")
    m = spark.createDataFrame([("q", 4, 8, "-"), ("p", 0, 3, "+"), ("p", 6, 10, "+")], "query string, query_start int, query_end int, strand string")
    text = lambda mode, r=0.0: {r_["id"]: r_["trimmed"] for r_ in cleaning.trim(seqs, m, "id", "seq", mode, r).collect()}
    assert text("longest") == {"q": "AACC", "p": "GTAC"} and text("all")["p"] == "ACGGTAC" and text("isoform")["p"] == "ACGNGTAC" and text("terminal")["p"] == "ACGTACGTAC"
    assert text("longest", 50.0) == {"p": "GTAC"}
    rows = [("a", "AAA--AAAA"), ("b", "AAA--AAAA"), ("c", "AAA--AAAA"), ("d", "TTT--TTTT")]
    assert cleaning.clean_rows(rows, 0.2, 2) == [(x, "AAAAAAA") for x in "abc"]
    df = spark.createDataFrame([("u", *r) for r in rows], "locus string, name string, seq string")
    assert cleaning.clean(df, "locus", "name", "seq").count() == 3


def test_organelle(spark):
    g = dna(200, 21)
    assert organelle.collapse([g[:120], g[80:], g[10:50]], 31) in ([g], [A.reverse_complement(g)])
    assert organelle.circle(g + g[:60]) == g and organelle.circle(g) is None
    assert organelle.least_rotation(g[50:] + g[:50]) == organelle.least_rotation(A.reverse_complement(g))
    assert organelle.junction_support(g, [g[-40:] + g[:40], g[:100]]) == 1 and organelle.junction_support(g, [g]) == 0
    assert organelle.standard_rotation(g[70:] + g[:70], g[:60]) == g
    assert organelle.bridge(g[:60], g[100:], [g[20:150]], 21, 300) == g[60:100]
    rows = organelle.merge_samples(spark.createDataFrame([("s", g[:150]), ("s", g[100:] + g[:60])], "sample string, seq string"), "sample", "seq").collect()
    assert [(r["length"], r["circular"]) for r in rows] == [(200, True)]


def test_rad(spark):
    assert rad.plurality(["ACGT", "ACGA", "ACGA"]) == "ACGA" and rad.plurality([]) == ""
    a, b, c, d = (dna(60, i) for i in (31, 32, 33, 34))
    arms = spark.createDataFrame([(1, a[:-1] + "A", b), (2, a, d), (3, c, d)], "id int, r1 string, r2 string")
    catalog = spark.createDataFrame([("x", a, b), ("y", c, d)], "locus string, r1 string, r2 string")
    assert {tuple(r) for r in rad.catalog_matches(arms, catalog).collect()} == {(1, "x"), (3, "y")}
    stacks = spark.createDataFrame([("k", "ACGT", i) for i in range(5)], "k string, seq string, h int")
    assert rad.bounded_stacks(stacks, ["k"], "h", 3).count() == 3
    assert tuple(rad.consensus(stacks, ["k"], "seq").first()) == ("k", 5, "ACGT")


def test_clades(spark):
    tree = "((A|1,OG|candidate_1)95:0.3,(C|1,D|1):0.3,A|2);"
    found = trees.select_clades(tree)
    assert len(found[0]) == 4 and len({x.split("|")[0] for x in found[0]}) == 4
    assert trees.select_clades(tree, frozenset({"OG"}))[0][0].startswith("A|") and trees.select_clades(tree, frozenset({"none"})) == []
    assert trees.clades(spark.createDataFrame([("f", tree)], "family string, nwk string"), "family", "nwk").count() >= 4


def test_repeats(spark):
    unit = dna(120, 41)
    counts = Counter(min(w, A.reverse_complement(w)) for w in G.windows(unit, 21))
    found = repeats.extend_fragment(unit[50:71], Counter({k: 5 * n for k, n in counts.items()}), 21)
    assert found in (unit, A.reverse_complement(unit))
    df = spark.createDataFrame([(2, 0.0, 9, 0.0, 0.0, 0.0, "X"), (170, 0.0, 9, 0.0, 0.0, 0.0, "X"), (0, 0.0, 9, 0.9, 0.7, 0.2, "LTR"), (0, 0.9, 9, 0.0, 0.0, 0.0, "X"), (0, 0.0, 9, 0.0, 0.0, 0.0, "X"), (0, 0.0, 1, 0.0, 0.0, 0.0, "X")], "p int, f double, s int, i double, c double, d double, k string")
    assert [r[0] for r in df.select(repeats.annotation(*(F.col(x) for x in "pfsicdk"))).collect()] == ["simple_repeat", "satellite", "LTR", "foldback", "unknown", "unsupported"]
    low, high = repeats.bootstrap_interval(100, 10_000)
    assert (low, high) == repeats.bootstrap_interval(100, 10_000) != repeats.bootstrap_interval(100, 10_000, seed=2)
    assert repeats.bootstrap_interval(10, 10) == (1e6, 1e6) and repeats.bootstrap_interval(0, 10) == (0.0, 0.0)
    first = next(repeats.xorshift(1))  # 1 -> 8193 -> 8193 ^ 64 -> shifted left by 17
    assert first == (((8193 ^ 64) ^ ((8193 ^ 64) << 17)) >> 11) / 2**53
    assert low < 10_000 < high and repeats.bootstrap_interval(1, 0) == (0.0, 0.0)


def test_workflow(spark, tmp_path):
    a, b = dna(150, 51), dna(150, 52)
    refs, frags = frames(spark, [(1, a), (2, b)], [(1, a[20:80]), (2, dna(30, 55) + b[:46] + dna(40, 53)), (3, dna(30, 56) + b[:30] + dna(40, 54))])
    found = {tuple(r) for r in workflow.auto_recruit(frags, refs, (31, 100)).collect()}
    assert (2, 2, "fallback") in found and not any(r[0] == 3 for r in found)
    gate = spark.createDataFrame([(100, 1.0, 1.0, 9, 0, False, 0), (300, 1.0, 1.0, 100, 96, False, 0), (300, 1.0, 1.0, 100, 5, False, 50), (300, 1.0, 1.0, 100, 5, False, 0)], "l int, c double, i double, t int, o int, r boolean, g int")
    assert [r[0] for r in gate.select(workflow.probe_gate(*(F.col(x) for x in "lcitorg"))).collect()] == ["too_short", "near_tie", "review", "accepted"]
    results = {10: "x", 20: "y", 40: "y"}
    assert workflow.doubling_budget(results.get) == (40, "y")
    rows = spark.createDataFrame([("1", "failed", None), (None, "success", False), ("", "success", True), ("no", "success", None)], "a string, s string, q boolean")
    assert [r[0] for r in rows.select(workflow.accepted_row(F.col("a"), F.col("s"), F.col("q"))).collect()] == [True, True, False, False]
    df = spark.range(5).toDF("n")
    assert [r["n"] for r in workflow.even_sample(df, "n", 3).orderBy("n").collect()] == [0, 2, 4]
    path = str(tmp_path / "table")
    workflow.publish(df, path)
    workflow.publish(df.limit(2), path)
    assert spark.read.parquet(path).count() == 2
    assert workflow.manifest({"k": 1}, {"d": df})["artifact_hash"] == workflow.manifest({"k": 1}, {"d": df.orderBy(F.desc("n"))})["artifact_hash"]
    profile = workflow.Profile()
    assert profile.run("one", lambda: df).count() == 5 and profile.rows[0]["status"] == "succeeded"


def test_stream(spark, tmp_path):
    from helixframe.streaming import recruit_stream

    a = dna(100, 61)
    refs, frags = frames(spark, [(1, a)], [(1, a[:40]), (2, dna(40, 62)), (3, a[30:90])])
    frags.repartition(2).write.parquet(str(tmp_path / "in"))
    recruit_stream.recruit_files(spark, str(tmp_path / "in"), "frag bigint, seq string", refs, 21, str(tmp_path / "out"), str(tmp_path / "cp"), files_a_batch=1).awaitTermination()
    batch = recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", 21), 21)
    assert [tuple(r) for r in recruit_stream.running_counts(spark, str(tmp_path / "out")).collect()] == [(1, batch.count())]


def test_exact_evidence_and_votes(spark):
    ref = dna(300, 71)
    reads = [(1, dna(20, 72) + ref[:60]), (2, A.reverse_complement(dna(20, 73) + ref[:60])), (3, ref[100:180]), (4, ref[250:] + dna(30, 74)), (5, ref[:50] + "N" + ref[51:90])]
    refs, frags = frames(spark, [(1, ref)], reads)
    hits = recruit.recruit(frags, "frag", ["seq"], recruit.reference_index(refs, "locus", "seq", 31), 31)
    match = evidence.maximal_matches(hits, frags, refs, 31)
    rows = {r["frag"]: (r["left_extension"], r["right_extension"], r["terminal_mask"]) for r in evidence.exact_evidence(match, frags, refs).collect()}
    assert rows[1] == rows[2] == (20, 0, 1) and rows[3] == (0, 0, 0) and rows[4] == (0, 30, 2)
    votes = {r["frag"]: r["orientation"] for r in evidence.orientation_votes(hits, frags, refs, 19).collect()}
    assert votes == {1: 1, 2: 2, 3: 1, 4: 1, 5: 0}


def test_candidates(spark):
    rows = [("u", 1, 100, 90, 0.02, 0.5, 2.0, 3, True), ("u", 2, 200, 150, 0.001, 3.0, 40.0, 9, True), ("u", 3, 300, 250, 0.02, 0.1, 2.0, 0, True), ("u", 4, 400, 400, 0.02, 0.1, 0.0, 5, False)]
    df = spark.createDataFrame(rows, "locus string, id int, length int, supported int, unique_density double, depth_cv double, depth_ratio double, unique_reads int, accepted boolean")
    keys = {"breadth": 0.5, "max_gap": 3, "reads": 9, "flank_balance": 0.5, "weight": 7}
    whole = df.withColumns({k: F.lit(v) for k, v in keys.items()})
    assert cohort.best_candidate(whole, "locus").first()["id"] == 4
    # Equal in all but one key, in its order: each of the later ones decides alone.
    same = dict(locus="u", length=100, supported=90, depth_cv=0.0, depth_ratio=0.0, unique_reads=50, **keys)
    for key, better in (("breadth", 0.6), ("max_gap", 2), ("reads", 10), ("flank_balance", 0.6), ("weight", 8)):
        pair = spark.createDataFrame([same | {"id": 1}, same | {"id": 2, key: better}])
        assert cohort.best_candidate(pair, "locus").first()["id"] == 2
    assert cohort.best_candidate(spark.createDataFrame([same | {"id": 2}, same | {"id": 1}]), "locus").first()["id"] == 1
    assert [cohort.population_reference(df, "locus", s).first()["id"] for s in ("longest", "density")] == [2, 1]
    assert cohort.population_reference(df, "locus").first()["candidate_count"] == 2
    with pytest.raises(ValueError):
        cohort.population_reference(df, "locus", "none")
    piles = spark.createDataFrame([("u", 1, "A", 6), ("u", 1, "C", 2), ("u", 2, "A", 5), ("u", 2, "-", 5)], "ref string, p int, b string, n bigint")
    assert [tuple(r) for r in cohort.minor_alleles(piles, ["ref", "p"], "b", "n").collect()] == [("u", 1, 8, 0.25)]
    refs = spark.createDataFrame([("u", "AC-NG"), ("u", "ACGTA")], "locus string, seq string")
    assert cohort.reference_lengths(refs, "locus", "seq").first()["mean_length"] == 4


def test_pseudo_alignment(spark):
    a, b = dna(80, 81), dna(80, 82)
    refs, frags = frames(spark, [(1, a), (2, a[:50] + b[:30])], [(1, a), (2, a[:45]), (3, a[:40] + dna(100, 83))])
    found = recruit.pseudo_align(frags, "frag", "seq", recruit.reference_index(refs, "locus", "seq", 15), 15)
    assert {(r["frag"], r["locus"]) for r in found.collect()} == {(1, 1), (2, 1), (2, 2)}
    support = {r["locus"]: r["ambiguity_status"] for r in recruit.marker_support(found, "frag", "locus").collect()}
    assert support == {1: "has_singleton_support", 2: "shared_only"}


def test_small_operators(spark):
    from helixframe.functions.sequences import trimmed_number, within_hamming

    df = spark.createDataFrame([("ACGT", "ACGA", 1.5), ("ACGT", "TCGA", 2.0), ("AC", "ACG", 0.125)], "a string, b string, x double")
    assert [r[0] for r in df.select(within_hamming("a", "b")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(trimmed_number("x", 2)).collect()] == ["1.5", "2", "0.13"]
    reads = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, "ACGTTGGGGG")], "id bigint, seq string")
    rows = {r["id"]: r["kmer"] for r in recruit.solid_minimizers(reads, ["id"], "seq", 5, 2).collect()}
    assert set(rows) == {1, 2} and rows[1] == rows[2]
    seeds = evidence.bait_seeds(dna(80, 91).encode())
    assert len(seeds) == len(set(seeds)) >= 3 and evidence.bait_seeds(b"ACGN" * 20) == []
    extra = spark.createDataFrame([("ACGT", "known")], "a string, status string")
    assert [r["status"] for r in cohort.enrich(df, [(extra, "a", {"status": "none"})]).orderBy("x").collect()] == ["none", "known", "known"]


def test_distinct_candidates(spark):
    a = dna(90, 92)
    rows = [("f", 1, a, 100), ("f", 2, A.reverse_complement(a), 100), ("f", 3, a[:60], 100), ("f", 4, a[:30], 30), ("g", 5, a[:60], 100)]
    df = spark.createDataFrame(rows, "family string, id int, seq string, n int")
    assert sorted(r["id"] for r in cohort.distinct_candidates(df, ["family"], "seq", "id", "n").collect()) == [1, 5]


def test_branches_and_unitig_paths():
    a, b, c, d = dna(40, 1), dna(20, 2), dna(20, 3), dna(40, 4)
    words = {w for s in (a + b + d, a + c + d) for w in G.windows(s, 15)}
    graph_ = {w: (3, 1 if w in a else 0, 0) for w in words}
    support = G.branch_support([(a[:30], a[20:] + b[:10]), (a[:30], dna(30, 9))], graph_, 15)
    assert list(support.values()) == [1]
    paths, _ = G.unitigs(words, 15)
    found = G.unitig_path(a + b + d, paths, 15)
    assert len(found) == 3
    places = G.coordinates(found, {i: len(p) for i, p in enumerate(paths)}, 15)
    assert places[0][1] == 0 and places[-1][2] == len(a + b + d)


def test_weights_and_automatic_k():
    assert G.hinges([1, 2, 3, 4, 5]) == (1.5, 3.0, 4.5) and G.hinges([7]) == (7.0, 7.0, 7.0)
    graph_ = {"A": (10, 2, 0), "B": (10, 0, 0), "C": (1, 2, 0), "D": (10, 6, 0), "E": (500, 0, 0)}
    found = G.weigh(graph_, 2)
    cap = int((G.hinges([10, 10, 1, 10, 500])[2] - 5.5) * 1.5 + 255)
    assert found["A"][1] == 2 * cap + 1 and found["C"][1] == 1 and found["D"][1] == 2 * cap // 5 + 1 and found["B"][1] == 0 and G.weigh({}, 1) == {}
    assert G.supported_stretches(np.array([1, 1, 0, 1], bool), 10) == [2, 1]
    assert G.supported_stretches(np.ones(10, bool), 10) == [10, 5] and G.supported_stretches(np.ones(16, bool), 10) == [10, 10, 6]
    genome = dna(400, 95)
    reads = [genome[i : i + 90] for i in range(0, 310, 2)]
    assert G.automatic_k([genome], reads, 81, 21, 51) > 41
    assert G.automatic_k([dna(100, 96)], reads, 81) == 21 and G.automatic_k([genome], reads, 10, 20) == 21


def test_pairs_rescue_kmers_beyond_the_reference():
    genome = dna(300, 97)
    pairs = [(genome[100:160], A.reverse_complement(genome[220:280]))] * 2
    core, assisted = G.rescued_graph(pairs, [genome[80:180]], 21, 3)
    beyond = set(G.windows(genome[220:280], 21))
    assert not beyond & set(core) and beyond <= set(assisted)
    assert G.fragment_support(pairs, G.reference_kmers([genome], 21), 21) == Counter()


def test_edit_pairs_spread_over_tasks(spark, monkeypatch):
    """Few bytes can make many pairs: pairs decide how many tasks there are, and copies of a text are compared once."""
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 500)
    rows = [(i, "AB"[i % 2], ["abc", "abd", "xyzw"][i % 3]) for i in range(120)] + [(120, "A", None), (121, None, "abc")]
    found = graph.edit_pairs(spark.createDataFrame(rows, "id int, block string, text string"), "id", "text", ["block"], 1)
    assert found.rdd.getNumPartitions() > 4
    want = sorted((a, b, int(x != y)) for a, p, x in rows for b, q, y in rows if a < b and p and p == q and x and y and (x == y or x != "xyzw" != y))
    assert sorted(map(tuple, found.collect())) == want


def test_select_auto_and_even_sample_spread_rows(spark, monkeypatch):
    """Ranks are over ranges and loci of a bounded number of rows a task, not over what few tasks a small table gets."""
    monkeypatch.setattr(workflow, "ROWS_A_RANGE", 50)
    df = spark.createDataFrame([((i * 7919) % 1009, str(i)) for i in range(1009)], "v int, s string")
    found = workflow.even_sample(df, "v", 11)
    assert sorted(r["v"] for r in found.collect()) == [i * 1008 // 10 for i in range(11)]
    assert found.rdd.getNumPartitions() > 4
    monkeypatch.setattr(selection, "ROWS_A_TASK", 50)
    rows = spark.range(1000).selectExpr("id % 40 AS locus", "id", "1L AS bases", "31L AS max_exact", "1L AS locus_count", "1L AS mates", "0L AS left_extension", "0L AS right_extension", "0 AS terminal_mask", "1L AS covered_bins", "0 AS bin")
    chosen = selection.select_auto(rows, 150.0)
    assert chosen.rdd.getNumPartitions() == 20 and chosen.where("selected").count() == 1000


def test_parts_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(recruit, "BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["abcd", "abcd", "abcd", None, "a" * 30, "", "ab"])], names=["id", "seq"])
    parts = list(recruit._parts(iter([batch])))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3], [4], [5, 6]]
    assert [p.num_rows for p in recruit._parts(iter([batch]), 1)] == [1] * 7


def test_extend_fragments_of_numbers_is_that_of_texts(spark):
    """Also for a group whose deepest k-mer no path may follow."""
    r = random.Random(3)
    texts = {1: "".join(r.choice("ACGT") for _ in range(300)), 2: "".join(r.choice("ACGT") for _ in range(40))}
    code = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    rows = [(g, w, r.randint(2, 9) if g == 1 else 2) for g, t in texts.items() for w in sorted({repeats.canonical_text(t[i : i + 9]) for i in range(len(t) - 8)})]
    found = [{tuple(x) for x in repeats.extend_fragments(df, "g", "kmer", "depth", 9).collect()} for df in (spark.createDataFrame(rows, "g int, kmer string, depth bigint"), spark.createDataFrame([(g, code(w), n) for g, w, n in rows], "g int, kmer bigint, depth bigint"))]
    assert found[0] == found[1] and len(found[0]) == 2


def test_tiers_read_fragments_once(spark, monkeypatch):
    """One reading for all tiers gives what the joins of a large index give; pairs and empty references too."""
    r = random.Random(8)
    refs = [(i, "".join(r.choice("ACGT") for _ in range(80))) for i in range(5)]
    cut = lambda n: (lambda s: s[(a := r.randint(0, 80 - n)) : a + n])(r.choice(refs)[1])
    rows = [(i, "N" + cut(r.choice((17, 21, 27, 33))) + "N", cut(18) if i % 3 else None) for i in range(60)]
    frags, loci = spark.createDataFrame(rows, "frag bigint, r1 string, r2 string"), spark.createDataFrame(refs, "locus bigint, seq string")
    found = lambda loci: sorted(map(tuple, recruit.recruit_tiered(frags, "frag", ["r1", "r2"], loci, "locus", "seq", [31, 25, 16]).collect()))
    joined, tables = [], recruit.stored
    monkeypatch.setattr(recruit, "stored", lambda df, **o: (joined.append(df), tables(df, **o))[1])
    got = found(loci)
    assert len(joined) == 3 and {k for _, _, k in got} == {31, 25, 16} and found(loci.limit(0)) == []
    monkeypatch.setattr(recruit, "MOST_BROADCAST", 0)
    assert found(loci) == got


@pytest.mark.parametrize(("k", "most", "counters"), [(21, 5, 1 << 25), (21, 40, 8), (31, 5, 8), (5, 3, 1 << 25), (21, 100_000, 1 << 25)])
def test_deepest_kmers(spark, monkeypatch, k, most, counters):
    """Few counters hold many k-mers each, so that the first cut is not the last; rows with a k-mer twice, null and short ones."""
    monkeypatch.setattr(recruit, "MOST_COUNTERS", counters)
    r = random.Random(most)
    common = ["".join(r.choices("ACGT", k=k + 9)) for _ in range(4)]
    texts = [(i, "".join(r.choices("ACGT", k=40)) + common[0] * (i % 3) + common[i % 4] + "N" + common[i * i % 4]) for i in range(60)]
    rows = spark.createDataFrame([*texts, (60, None), (61, ""), (62, "ACG")], "id int, seq string").repartition(3)
    all_ = sorted(((-n, x) for x, n in recruit.kmer_depth(rows, ["id"], "seq", k).collect() if n >= 2))
    found = recruit.deepest_kmers(rows, "seq", k, most)
    assert sorted((-n, x) for x, n in found.collect())[:most] == all_[:most]
    if most == 5 and counters > 8:
        assert found.count() < len(all_)  # the others are not even counted


def test_kmers_that_cannot_be_deep_are_not_shuffled(spark):
    """1,000 texts of their own and one that 20 rows share: the rows of the shuffle by k-mer are the shared ones alone."""
    r = random.Random(1)
    shared = "".join(r.choices("ACGT", k=60))
    rows = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=300)) + (shared if i < 20 else "")) for i in range(1000)], "id int, seq string")
    found = recruit.deepest_kmers(rows, "seq", 21, 40)
    assert {n for _, n in found.collect()} >= {20} and found.count() < 2000


def test_deepest_kmers_of_no_rows(spark):
    assert recruit.deepest_kmers(spark.createDataFrame([], "id int, seq string"), "seq", 21, 5).collect() == []


def test_unitig_graph():
    """As unitigs() has them, for words of paths, branches, circles and single bases."""
    r = random.Random(8)
    number = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    for i in range(200):
        k, texts = r.choice([2, 3, 5, 7]), ["".join(r.choices("ACGT"[: r.randint(1, 4)], k=r.randint(0, 40))) for _ in range(r.randint(0, 4))]
        ring = "".join(r.choices("ACGT", k=9))
        words = {t[j : j + k] for t in [*texts, ring * 2 if i % 3 else ""] for j in range(len(t) - k + 1)}
        paths, edges = G.unitigs(words, k)
        sizes, found = G.unitig_graph(np.array(sorted(map(number, words)), np.int64), k)
        assert sizes.tolist() == [len(p) for p in paths] and [tuple(e) for e in found.tolist()] == edges


def test_resolve_path_takes_time_by_edges():
    """A chain of 20,000 nodes with a side branch each took the square of their number."""
    n = 20_000
    edges = {(i, i + 1): 1 for i in range(n - 1)} | {(i, n + i): 1 for i in range(n)}
    nodes = {i: (1, 1, 30 if i < n else 5) for i in range(2 * n)}
    began = time.process_time()
    assert G.resolve_path(nodes, edges) == [*range(n), 2 * n - 1]
    ring = {(i, (i + 1) % n): 1 for i in range(n)}
    assert len(G.resolve_path({i: (1, 1, 9) for i in range(n)}, ring)) == n
    assert time.process_time() - began < 5


def test_resolve_path_by_all_paths():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 7)
        nodes = {i: (r.randint(0, 1), r.randint(1, 2), r.randint(1, 2)) for i in range(n)}
        edges = {(a, b): r.randint(0, 2) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        paths = [[i] for i in nodes]
        for p in paths:
            paths += [[*p, b] for b in nodes if edges.get((p[-1], b))]
        figures = lambda p: (sum(nodes[i][0] for i in p), min(nodes[i][1] for i in p), sum(edges[x] for x in zip(p, p[1:], strict=False)), sum(nodes[i][2] for i in p))
        best = G.resolve_path(nodes, edges)
        assert figures(best)[0] == max(figures(p)[0] for p in paths)
        assert best in paths
