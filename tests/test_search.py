"""The search against a walk with backtracking in plain Python, and its parts against counts by hand."""

import random
from statistics import median

import pytest

from helixframe.operators import search

COMPLEMENT = str.maketrans("ACGT", "TGCA")
K, SIZE = 7, 11


def back(s):
    return s[::-1].translate(COMPLEMENT)


def windows(s, k=K):
    return [w for w in (s[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set("ACGT")]


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def graph_by_hand(reads, refs, limit):
    depth, known, place = {}, {}, {}
    for s in reads:
        for w in {x for y in windows(s) for x in (y, back(y))}:
            depth[w] = depth.get(w, 0) + 1
    for s in sorted(refs):
        n = max(len(s) - K, 1)
        for i, w in enumerate(windows(s)):
            for x, p in ((w, 1000 * (n - i) // n if len(s) > K else 0), (back(w), 1000 * i // n)):
                known[x] = known.get(x, 0) + 1
                place.setdefault(x, p)
    kept = {w: d for w, d in depth.items() if d > limit or w in known}
    v = sorted(kept.values())
    half = len(v) // 2
    q1, q3 = (median(v[:half]), median(v[-half:])) if len(v) > 1 else (v[0], v[0])
    cap = int((q3 - q1) * 1.5 + q3)
    weight = lambda w: 0 if w not in known else len(refs) * cap // (abs(known[w] - len(refs)) + 1) + 1 if kept[w] > limit else 1
    return {w: (min(d, cap), weight(w), place.get(w, 1023)) for w, d in kept.items()}


def sides_by_hand(graph, seed, budget):
    """The first `budget` dead ends of a search that takes the best choice first and goes back to the latest branch."""
    found = []

    def bonus(a, b):
        (d0, w0, p0), (d1, w1, p1) = graph[a], graph[b]
        n = 0
        if 0 < p0 < 1000 and 0 < p1 < 1000:
            n = 8 if abs(p0 - p1) <= 2 else -8 if w0 and w1 else 0
        limit = max(4 * max(d0, 2), 8)
        return n - ((d1 - limit) // 2 if not w1 and d1 > limit else 0)

    todo = [([seed], 0)]
    while todo and len(found) < budget:
        path, value = todo.pop()
        here = path[-1]
        options = [w for w in (here[1:] + b for b in "ACGT") if w in graph and w not in path]
        if not options:
            found.append(("".join(w[-1] for w in path[1:]), value))
            continue
        gain = {w: graph[w][0] + graph[w][1] + (bonus(here, w) if len(options) > 1 else 0) for w in options}
        todo += [([*path, w], value + gain[w]) for w in sorted(options, key=lambda w: (-gain[w], w))[::-1]]
    return found


def made(seed):
    """locus -> (reads, references): texts of few letters have many branches and circles."""
    r, loci = random.Random(seed), {}
    for locus in range(1, 4):
        refs = [bases(r, 40), bases(r, 25)][: 1 + locus % 2]
        middle = refs[0]
        texts = [bases(r, 12) + middle + bases(r, 12) for _ in range(3)]
        texts += [middle[:20] + bases(r, 12) + middle[8:30], back(texts[0]), middle, middle[:15] + "N" + middle[15:]]
        texts += ["".join(r.choice("AC") for _ in range(16)) + middle[:12] for _ in range(locus % 2)]
        loci[locus] = (texts, refs)
    return loci


def frames(spark, loci):
    reads = spark.createDataFrame([(i, s) for i, (texts, _) in loci.items() for s in [*texts, None, ""]], "locus int, seq string")
    refs = spark.createDataFrame([(i, s) for i, (_, refs) in loci.items() for s in refs], "locus int, seq string")
    return reads, refs


@pytest.mark.parametrize("limit, budget", [(0, 3), (1, 8192)])
def test_search_is_that_of_a_walk_with_backtracking(spark, limit, budget):
    loci = made(3)
    reads, refs = frames(spark, loci)
    graph = search.stored(search.weighted_graph(reads, refs, K, limit))
    got = {}
    for r in graph.collect():
        got.setdefault(r["locus"], {})[r["word"]] = (r["depth"], r["weight"], r["place"])
    want = {i: graph_by_hand(texts, references, limit) for i, (texts, references) in loci.items()}
    assert got == want
    seeds = search.stored(search.best_seeds(graph))
    paths = search.search_paths(graph, search.stored(search.choices(graph)), seeds, budget)
    found = {}
    for r in sorted(paths.collect(), key=lambda r: r["key"]):
        found.setdefault((r["locus"], r["side"]), []).append((r["bases"], r["value"]))
    expected = {}
    for r in seeds.collect():
        seed = min((w for w in want[r["locus"]] if want[r["locus"]][w][1]), key=lambda w: (-want[r["locus"]][w][1], -want[r["locus"]][w][0], w))
        assert r["seed"] == seed
        expected[r["locus"], "right"] = sides_by_hand(want[r["locus"]], seed, budget)
        expected[r["locus"], "left"] = sides_by_hand(want[r["locus"]], back(seed), budget)
    assert found == expected
    if budget > 1:
        assert max(map(len, found.values())) > 1


def test_contigs_are_the_best_of_all_sides(spark):
    loci = made(5)
    reads, refs = frames(spark, loci)
    slices = search.read_slices(reads, SIZE)
    counts = {i: {} for i in loci}
    for i, (texts, _) in loci.items():
        for s in texts:
            if len(s) >= SIZE:
                a = (len(s) - SIZE) // 2
                for x in {s[a : a + SIZE], back(s)[a : a + SIZE]}:
                    counts[i][x] = counts[i].get(x, 0) + 1
    rows = slices.collect()
    assert {i: {r["slice"]: r["n"] for r in rows if r["locus"] == i} for i in loci} == counts
    got = {r["locus"]: r for r in search.search_contigs(reads, refs, slices, K, SIZE, 0, 20, 3).collect()}
    assert set(got) == set(loci)
    for i, (texts, references) in loci.items():
        graph = graph_by_hand(texts, references, 0)
        seed = min((w for w in graph if graph[w][1]), key=lambda w: (-graph[w][1], -graph[w][0], w))
        halves = []
        for start in (back(seed), seed):
            ends = sides_by_hand(graph, start, 20)
            least = max(v for _, v in ends) >> 2
            held = lambda s: sum(counts[i].get(x, 0) for x in set(windows(s, SIZE)))
            halves.append(sorted(((s, v) for s, v in ends if v > least), key=lambda e: (-len(e[0]), -held(e[0]), -e[1], e[0]))[:3] or [("", 0)])
        contigs = [support_by_hand(back(a) + seed + b, va + vb, counts[i], graph) for a, va in halves[0] for b, vb in halves[1]]
        best = max(contigs, key=lambda c: c[0])
        r = got[i]
        assert (r["candidates"], r["contig"], r["value"], r["unique_reads"], r["multi_reads"], r["supported_bases"], r["max_gap"]) == (len(contigs), *best[1])
        assert (r["median_depth"], r["flank_balance"]) == best[2]


def support_by_hand(contig, value, slices, graph):
    places = {}
    for a, x in enumerate(windows(contig, SIZE)):
        if x in slices:
            places.setdefault(x, []).append(a)
    unique = sum(slices[x] for x, at in places.items() if len(at) == 1)
    multi = sum(slices[x] for x, at in places.items() if len(at) > 1)
    covered = [any(a <= p < a + SIZE for at in places.values() if len(at) == 1 for a in at) for p in range(len(contig))]
    gaps = "".join("x" if c else " " for c in covered).split("x")
    gap, bases_ = max(map(len, gaps)), sum(covered)
    low, high = (len(gaps[0]), len(gaps[-1])) if bases_ else (0, 0)
    balance = 0.0 if not bases_ else 1.0 if low == high == 0 else min(low, high) / max(low, high)
    depth = [graph[w][0] for w in windows(contig)]
    mean = sum(depth) / len(depth)
    cv = round((sum((d - mean) ** 2 for d in depth) / len(depth)) ** 0.5 / mean, 9)
    n = len(contig)
    score = bases_ * min(unique / n / 0.01, 1) / (1 + cv) * min(10 / max(round(max(depth) / median(depth), 9), 1), 1)
    return (round(score, 6), bases_ / n, unique / n, -gap / n, n, unique, unique + multi, balance, value, contig), (contig, value, unique, multi, bases_, gap), (median(depth), balance)


def test_empty_tables(spark):
    reads, refs = frames(spark, {})
    assert search.search_contigs(reads, refs, search.read_slices(reads, SIZE), K, SIZE).collect() == []


@pytest.mark.parametrize("chunk", [5, 4_000_000])
def test_stretches_and_walks_are_the_same_in_chunks_of_any_size(spark, monkeypatch, chunk):
    """Numbers in place of texts, words of a locus in several chunks; a long row of branches takes no job for each."""
    monkeypatch.setattr(search, "CHUNK", chunk)
    r = random.Random(8)
    k, parts = 9, [bases(r, 11) for _ in range(25)]
    texts = ["".join(parts), "".join(p[:5] + ("C" if p[5] != "C" else "A") + p[6:] for p in parts)]
    reads = spark.createDataFrame([(1, t) for t in texts], "locus int, seq string")
    refs = spark.createDataFrame([(1, parts[0] + parts[1])], "locus int, seq string")
    graph = search.stored(search.weighted_graph(reads, refs, k, 0))
    seeds = search.stored(search.best_seeds(graph))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"walk{chunk}", "")
    words = search.in_numbers(graph, k, "word")
    got = search.search_paths(words, search.choices(words, k=k), seeds, 64, None, k).collect()
    n = len(jobs.getJobIdsForGroup(f"walk{chunk}"))
    spark.sparkContext.setJobGroup("other", "")
    by_word = {x["word"]: (x["depth"], x["weight"], x["place"]) for x in graph.collect()}
    seed = seeds.first()["seed"]
    for side, start in (("right", seed), ("left", back(seed))):
        mine = sorted((x["key"], x["bases"], x["value"]) for x in got if x["side"] == side)
        assert [x[1:] for x in mine] == sides_by_hand(by_word, start, 64)
    assert max(len(x["key"]) for x in got) > 20
    if chunk > 5:
        assert n < 60


def test_windows_of_long_texts_take_no_time_by_the_square(spark):
    r = random.Random(2)
    texts = [bases(r, n) for n in (0, 10, 11, search.PIECE + 10, search.PIECE + 11, 3 * search.PIECE + 4, 300_000)]
    got = spark.createDataFrame([(t,) for t in texts], "seq string").select("seq", search.text_windows("seq", 11).alias("w")).collect()
    assert all((x["w"] or []) == windows(x["seq"], 11) for x in got)


def test_windows_along_contigs_are_never_rows_of_text(spark, monkeypatch):
    """Slices of several parts of a number, some in two places of a contig, some that differ in one part alone or have other letters."""
    size, r = 70, random.Random(12)
    monkeypatch.setitem(globals(), "SIZE", size)
    contigs, slices, graphs = [], [], {}
    for locus in (1, 2, 3):
        twice, graph = bases(r, 90), {}
        for left in (0, 1):
            text = bases(r, 60) + twice + bases(r, 150 * locus) + twice + bases(r, 75)
            contigs.append((locus, left, 0, text, 5))
            graph |= {w: (r.randint(1, 9),) for w in windows(text)}
            cut = [text[i : i + size] for i in (3, 65, 70, 200, len(text) - size)]
            changed = [c[:i] + ("A" if c[i] != "A" else "C") + c[i + 1 :] for c in cut[:2] for i in (0, 33, 69)]
            slices += [(locus, x, r.randint(1, 9)) for x in {*cut, *changed}] + [(locus, cut[0].lower(), 3), (locus % 3 + 1, cut[0], 2), (locus, cut[0][:5] + "N" + cut[0][6:], 4)]
        graphs[locus] = graph
    slices = list({(i, x): n for i, x, n in slices}.items())
    frames_ = [
        spark.createDataFrame(contigs, "locus int, left bigint, right bigint, contig string, value bigint"),
        spark.createDataFrame([(i, x, n) for (i, x), n in slices], "locus int, slice string, n bigint"),
        spark.createDataFrame([(i, w, d) for i, g in graphs.items() for w, (d,) in g.items()], "locus int, word string, depth bigint"),
    ]
    monkeypatch.setattr(search, "text_windows", None)
    got = {(x["locus"], x["left"]): x for x in search.contig_support(*frames_, size, K).collect()}
    assert len(got) == len(contigs)
    for locus, left, _, text, value in contigs:
        want, x = support_by_hand(text, value, {s: n for (i, s), n in slices if i == locus}, graphs[locus]), got[locus, left]
        assert (x["contig"], x["value"], x["unique_reads"], x["multi_reads"], x["supported_bases"], x["max_gap"]) == want[1] and x["multi_reads"] and x["unique_reads"]
        assert (x["median_depth"], x["flank_balance"]) == want[2]
