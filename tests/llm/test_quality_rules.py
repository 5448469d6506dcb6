import re

from helixframe.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()} | {100: "a b c a b c a b c d", 101: "l\nl\n l\nl\n\n\n", 102: "# x | y <b> & $"}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.features(df).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_odd_rows(odd, none):
    rows = Q.judged(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r["kept"] for r in rows if r["n_words"] < Q.MIN_WORDS)
    assert Q.judged(none).collect() == []


def test_bad_host_drops_its_documents(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, clean if i % 10 == 0 else "short", "bad") for i in range(2000)] + [(i + 5000, clean, "good") for i in range(2000)]
    rows += [(9999, clean, None)]
    kept = {r["doc_id"]: r["kept"] for r in Q.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not kept[0] and kept[5000] and kept[9999]


def test_no_python_in_the_plan(odd):
    plan = Q.features(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
