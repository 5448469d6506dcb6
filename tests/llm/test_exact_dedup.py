from collections import defaultdict

from helixframe.llm import exact_dedup as X
from helixframe.llm import simhash as S

IDS = "doc_id bigint, text string"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return sorted((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == max(groups[r[1] or ""])) for r in rows)


def test_odd_rows_and_brute_force(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.classes(odd).collect())
    assert got == brute(rows)
    assert X.deduplicated(odd).columns == odd.columns


def test_empty_table(none):
    assert X.classes(none).collect() == []
    assert X.deduplicated(none).collect() == []


def test_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, IDS)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.classes(df).collect())
    assert got == brute(rows)


def test_batches_by_falling_id_hold_every_row(spark):
    df = spark.createDataFrame([(i // 2, "x") for i in range(100)] + [(None, "y")], IDS)
    for n in (1, 2, 5):
        parts = [[r["doc_id"] for r in p.collect()] for p in X.batches(df, n)]
        assert sorted((x for p in parts for x in p), key=str) == sorted((r["doc_id"] for r in df.collect()), key=str)
        for high, low in zip(parts, parts[1:]):
            assert min(high) > max(x for x in low if x is not None)


def test_the_query_joins_later_batches_with_earlier_ones(spark, monkeypatch):
    seen = []
    unseen = X.DigestIndex.unseen

    def noted(self, groups):
        found = unseen(self, groups)
        seen.append((groups.count(), found.count(), found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(X.DigestIndex, "unseen", noted)
    rows = [(i, f"text {i % 40}") for i in range(100)]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.classes(spark.createDataFrame(rows, IDS)).collect())
    assert got == brute(rows)
    assert [x[:2] for x in seen] == [(40, 40), (40, 0)]
    for _, _, plan in seen:
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_index_keeps_earlier_batches(spark):
    index = X.DigestIndex(spark)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], IDS)
    second = spark.createDataFrame([(4, "a"), (5, "c"), (6, "c")], IDS)
    assert {r["doc_id"]: r["kept"] for r in X.classes(first, index).collect()} == {1: False, 2: True, 3: True}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.classes(second, index).collect()} == {4: (2, 1, False), 5: (6, 2, False), 6: (6, 2, True)}
    assert index.read().count() == 3


def test_index_is_reopened_by_name_and_by_path_with_other_settings(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], IDS)
    X.DigestIndex(spark, "kept_index", buckets=3)
    X.classes(first, X.DigestIndex(spark, "kept_index")).collect()
    path = X.DigestIndex(spark, "kept_index").path
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = X.DigestIndex(spark, "kept_index")
        assert (again.buckets, again.path) == (3, path)
        got = {r["doc_id"]: r["kept"] for r in X.classes(spark.createDataFrame([(3, "a"), (4, "c")], IDS), again).collect()}
        assert got == {3: False, 4: True} and again.read().count() == 3
        spark.sql("DROP TABLE kept_index")
        moved = X.DigestIndex(spark, "other_name", path)
        assert moved.buckets == 3 and moved.read().count() == 3
        got = {r["doc_id"]: r["kept"] for r in X.classes(spark.createDataFrame([(5, "c"), (6, "d")], IDS), moved).collect()}
        assert got == {5: False, 6: True} and moved.read().count() == 4
        spark.sql("DROP TABLE other_name")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    X.classes(spark.createDataFrame([(1, "a")], IDS)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_rows_that_repeat_an_id_are_told_apart(spark):
    a, b = "one text of some words here", "quite another text that shares nothing with it"
    for rows in ([(5, a), (9, a), (5, b), (5, b)], [(None, a), (5, a), (None, b), (None, b)]):
        df = spark.createDataFrame(rows, IDS)
        for found in (X.deduplicated(df), S.deduplicated(df)):
            got = sorted(r["text"] for r in found.collect())
            assert got == sorted({t for _, t in rows}), (rows, got)
