import re

from helixframe.llm import licence_scan as S


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for t in S.BASE:
        found += [(i, t.label) for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
    return len(words), sorted(found)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "GNU General-Public\nLicense gnu general public license",
    "cc by-nc CC BY mit license. MIT License",
    "apache licenses; apachelicense; the mit. license",
    "license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
    "by cc by cc by",
    "ÉGNU general public license; gnu général public license",
]


def test_base_places_against_brute_force(spark, odd):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r["doc_id"] + 100, r["text"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_words"], sorted((m["at"], m["label"]) for m in r["matches"] if m["base"])) for r in S.scan(df).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_templates_add_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    labels = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in S.scan(df).collect()}
    assert labels[0] == {"apache", "apache-2.0"} and labels[5] == {"mit"} and labels[4] == set()
    assert "cc-by-nc" in labels[2] or "cc-by" in labels[2]


def test_every_key_phrase_is_found_in_its_template(spark):
    df = spark.createDataFrame([(i, " ".join(t.words)) for i, t in enumerate(S.TEMPLATES)], "doc_id bigint, text string")
    for r in S.scan(df).collect():
        t = S.TEMPLATES[r["doc_id"]]
        assert any(m["label"] == t.label and m["at"] == 0 and abs(m["score"] - 1) < 1e-9 for m in r["matches"])


def test_no_python_in_the_plan_and_empty_table(odd, none):
    plan = S.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert S.scan(none).collect() == []


def test_hundreds_of_templates(spark):
    words = [f"w{i % 211} x{i % 97} y{i}".split() for i in range(40)]
    made = [S._template(f"t{n}", " ".join([f"n{n}", *sum(words[n % 7 : n % 7 + 12], []), f"end{n % 5}"]), " ".join([f"n{n}", *words[n % 7][:2]])) for n in range(300)]
    df = spark.createDataFrame([(n, "before " + " ".join(t.words) + " after") for n, t in enumerate(made)], "doc_id bigint, text string")
    scan = S.scan(df, tuple(made))
    assert "from_json" not in scan._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: r["matches"] for r in scan.collect()}
    assert all([(m["label"], m["at"]) for m in rows[n]] == [(f"t{n}", 1)] and rows[n][0]["score"] > 0.999 for n in range(300))


def test_postings_must_agree_on_the_begin(spark):
    t = S._template("x", "alpha beta gamma delta epsilon", "alpha beta gamma")
    assert [[w for w, _ in p] for p in S.postings({"alpha": 1.0, "beta": 3.0, "gamma": 2.0, "delta": 9.0, "epsilon": 9.0}, (t,))] == [["beta", "gamma", "alpha"]]
    df = spark.createDataFrame([(1, "beta alpha gamma delta epsilon"), (2, "alpha beta gamma delta epsilon alpha beta gamma"), (3, "alpha beta x gamma")], "doc_id bigint, text string")
    got = {r["doc_id"]: [(m["at"], round(m["score"], 3)) for m in r["matches"]] for r in S.scan(df, (t,)).collect()}
    assert got[1] == got[3] == [] and got[2][0] == (0, 1.0)
