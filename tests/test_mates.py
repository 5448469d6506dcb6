"""Mate-pair graphs against counts by hand, and the guard of the length on made rows."""

import random

import pytest
from test_search import K, back, bases, windows

from helixframe.operators import mates, search
from helixframe.operators.tables import stored

LIMIT = 2


def made(seed):
    """locus -> (pairs, references): mates around a reference, with errors, missing mates, other letters and repeated rows."""
    r, loci = random.Random(seed), {}
    for locus in range(1, 4):
        ref = bases(r, 40)
        genomes = [bases(r, 30) + ref + bases(r, 30), bases(r, 30) + ref[:25] + bases(r, 30)]
        pairs = []
        for genome in genomes * 2:
            for at in range(0, len(genome) - 40, 5 + locus):
                pairs.append((genome[at : at + 14], back(genome[at + 22 : at + 38])))
        pairs += [(genomes[0][20:40], None), (None, genomes[0][25:45]), (None, None), ("", ref[:12]), (ref[:9] + "N" + ref[9:18], ref[20:30]), (ref[5:20], ref[5:20]), (bases(r, 20), bases(r, 20))]
        loci[locus] = (pairs, [ref])
    return loci


def frames(spark, loci):
    pairs = spark.createDataFrame([(i, n, *p) for i, (rows, _) in loci.items() for n, p in enumerate(rows)], "locus int, frag int, r1 string, r2 string")
    refs = spark.createDataFrame([(i, s) for i, (_, refs) in loci.items() for s in refs], "locus int, seq string")
    return pairs, refs


def both(words):
    return {x for w in words for x in (w, back(w))}


def by_hand(pairs, refs):
    """(depth, fragments) of each word, and the kept pairs with what stands on the reference."""
    known = both(w for s in refs for w in windows(s))
    depth, fragments, kept = {}, {}, []
    for p in pairs:
        mine = [both(windows(s)) if s else set() for s in p]
        on = [bool(m & known) for m in mine]
        if not any(on):
            continue
        kept.append((p, on))
        for s, m in zip(p, mine, strict=True):
            for w in m if s is not None else ():
                depth[w] = depth.get(w, 0) + 1
        for i in (0, 1):
            if on[1 - i] and not on[i]:
                for w in mine[i]:
                    fragments[w] = fragments.get(w, 0) + 1
    return depth, fragments, kept, known


@pytest.fixture(scope="module")
def counted(spark):
    loci = made(7)
    pairs, refs = frames(spark, loci)
    anchored = search.stored(mates.anchored_pairs(pairs, refs, K))
    return loci, refs, anchored, search.stored(mates.assisted_graph(anchored, refs, K, LIMIT))


def test_words_and_both_graphs(counted):
    loci, _, anchored, graph = counted
    found = {}
    for r in mates.mate_words(anchored, K).collect():
        found[r["locus"], r["word"]] = (r["depth"], r["fragments"])
    want, rescued, core = {}, set(), set()
    for i, (pairs, refs) in loci.items():
        depth, fragments, kept, known = by_hand(pairs, refs)
        assert sorted((r["on1"], r["on2"]) for r in anchored.where(f"locus = {i}").collect()) == sorted((a, b) for _, (a, b) in kept)
        want |= {(i, w): (d, fragments.get(w, 0)) for w, d in depth.items()}
        core |= {(i, w) for w, d in depth.items() if d > LIMIT or w in known}
        rescued |= {(i, w) for w, d in depth.items() if d <= LIMIT and w not in known and fragments.get(w, 0) >= 2}
    assert found == want
    rows = graph.collect()
    assert {(r["locus"], r["word"]) for r in rows if not r["rescued"]} == core
    assert {(r["locus"], r["word"]) for r in rows if r["rescued"]} == rescued
    assert rescued and core


def test_support_of_branches(counted):
    loci, _, anchored, graph = counted
    words = {i: set() for i in loci}
    for r in graph.collect():
        words[r["locus"]].add(r["word"])
    want = {}
    for i, (pairs, refs) in loci.items():
        for w in words[i]:
            after = [w[1:] + b for b in "ACGT" if w[1:] + b in words[i]]
            if len(after) > 1:
                want |= {(i, w, x): 0 for x in after}
        for p, on in by_hand(pairs, refs)[2]:
            over = set()
            for s, other in zip(p, on[::-1], strict=True):
                for text in (s, back(s)) if s and other else ():
                    over |= {(i, e[:-1], e[1:]) for e in windows(text, K + 1)}
            for e in over & set(want):
                want[e] += 1
    found = {(r["locus"], r["word"], r["next"]): r["fragments"] for r in mates.branch_support(anchored, graph, K).collect()}
    assert found == want
    assert any(want.values()) and not all(want.values())


def test_contigs_are_no_shorter_than_those_of_the_core(spark, counted):
    loci, refs, anchored, graph = counted
    pairs, _ = frames(spark, loci)
    got = {r["locus"]: r for r in mates.mate_contigs(pairs, refs, K, 11, LIMIT, budget=50, most=3).collect()}
    assert set(got) == set(loci)
    core = graph.where("NOT rescued")
    seeds = search.stored(search.best_seeds(core))
    slices = search.stored(search.read_slices(mates._mates(anchored), 11))
    sides = search.best_sides(search.search_paths(core, search.stored(search.choices(core)), seeds, 50), slices, 11, 3)
    alone = search.best_contigs(search.contig_support(search.stored(search.combine_sides(seeds, sides)), slices, core, 11, K))
    for r in alone.collect():
        mine = got[r["locus"]]
        assert mine["core_length"] == r["length"] <= mine["length"]
        if not mine["assisted"]:
            assert mine["contig"] == r["contig"]


def test_guard(spark):
    """locus 1: the assisted row is better and longer; 2: better but shorter; 3: equal; 4: worse."""
    fields = "locus struct<locus: int, assisted: boolean>, candidates bigint, left bigint, right bigint, contig string, value bigint, length bigint, unique_reads bigint, multi_reads bigint, supported_bases bigint, max_gap bigint, flank_balance double, median_depth double, depth_cv double, depth_ratio double"
    row = lambda i, a, n, s: ((i, a), 1, 1, 1, "A" * n, 5, n, 9, 0, s, 0, 1.0, 2.0, 0.0, 1.0)
    rows = [row(1, False, 50, 40), row(1, True, 60, 60), row(2, False, 50, 40), row(2, True, 45, 45), row(3, False, 50, 50), row(3, True, 50, 50), row(4, False, 50, 50), row(4, True, 60, 10)]
    got = {r["locus"]: (r["assisted"], r["guarded"], r["core_length"], r["assisted_length"], len(r["contig"])) for r in mates.guarded(spark.createDataFrame(rows, fields)).collect()}
    assert got == {1: (True, False, 50, 60, 60), 2: (False, True, 50, 45, 50), 3: (False, False, 50, 50, 50), 4: (False, False, 50, 60, 50)}


def test_empty_tables(spark):
    pairs, refs = frames(spark, {})
    assert mates.mate_contigs(pairs, refs, K, 11).collect() == []
    _, refs = frames(spark, made(1))
    assert mates.mate_contigs(pairs, refs, K, 11).collect() == []


def test_jobs_do_not_grow_with_the_branches_of_a_path(spark):
    jobs = []
    for n in (3, 24):
        r = random.Random(n)
        parts = [bases(r, 12) for _ in range(n)]
        texts = ["".join(parts), "".join(p[:5] + ("C" if p[5] != "C" else "A") + p[6:] for p in parts)]
        pairs = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(texts)], "locus int, frag bigint, r1 string, r2 string")
        refs = spark.createDataFrame([(1, texts[0])], "locus int, seq string")
        spark.sparkContext.setJobGroup(f"mates{n}", "")
        assert len(mates.mate_contigs(pairs, refs, 9, 11, 0, budget=8, most=2).collect()) == 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"mates{n}")))
        spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] <= jobs[0] + 20, jobs


def test_tables_of_words_are_never_broadcast(spark):
    """However few bytes a stored table of words has, compressed, the driver doesn't hold it."""
    words = stored(spark.createDataFrame([(1, "AAC", 2, 1, 5, False), (1, "ACG", 2, 1, 6, False)], "locus int, word string, depth bigint, weight bigint, place int, rescued boolean"))
    support = stored(spark.createDataFrame([(1, "AAC", "ACG", 2)], "locus int, word string, next string, fragments bigint"))
    for edges in (search.choices(words, support), search.graph_edges(words.select("locus", "word"))):
        assert "BroadcastHashJoin" not in edges._jdf.queryExecution().sparkPlan().toString()
        assert [(r["word"], r["next"]) for r in edges.collect()] == [("AAC", "ACG")]
