"""Host-level quality rules.

Each document gets counts that rules judge; rule failures are summed by host (the `source` column), the
failure rate of each host is shrunk with a beta prior fitted to all hosts by moments, and the host's
verdict is joined back to its documents.  DataFrame functions only.

A word is a longest run of characters other than space and \\x09-\\x0D.  Repeated three-word windows are
found in three steps within the row: each window's hash and position are packed into one long, sorted,
and windows that share the hash bits with a neighbour are compared as texts.

Defined results: a null or empty text has no words and fails; texts of up to 2^28 words are judged whole, each within its
row; a host at the bound itself is not rejected; a null source is no host, so that its
documents are judged by the base rules alone; rows that repeat a doc_id each count; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import let, table, written

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Low bits of a packed window that hold its position.
POSITION_BITS = 28
MIN_WORDS = 50
#: A host is rejected when its shrunk rate of failed documents exceeds this.
MAX_HOST_RATE = 0.75
#: Strength of the prior where hosts don't differ by more than chance, and its bounds.
FLAT_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 1000.0, 1.0, 1000.0


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _shared(key: Column, before: Column, after: Column) -> Column:
    return key.eqNullSafe(before) | key.eqNullSafe(after)


def repeated_words(w: Column) -> Column:
    """Words of the array w that lie in a three-word window found twice or more."""
    mask = (1 << POSITION_BITS) - 1
    high = lambda x: F.shiftright(x, POSITION_BITS)
    window = lambda p: F.concat_ws(" ", w[p], w[p + 1], w[p + 2])
    none = F.array().cast("array<bigint>")
    packed = F.when(
        F.size(w) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))),
    ).otherwise(none)
    alike = let(packed, lambda s: F.filter(s, lambda x, j: _shared(high(x), high(F.get(s, j - 1)), high(F.get(s, j + 1)))))
    texts = F.sort_array(F.transform(alike, lambda x: x.bitwiseAND(F.lit(mask)).cast("int")).cast("array<int>"))
    texts = F.sort_array(F.transform(texts, lambda p: F.struct(window(p).alias("window"), p.alias("at"))))
    same = let(texts, lambda s: F.filter(s, lambda x, j: _shared(x["window"], F.get(s, j - 1)["window"], F.get(s, j + 1)["window"])))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    cover = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end"))
    return F.aggregate(F.sort_array(F.transform(same, lambda x: x["at"].cast("bigint"))), start, cover, lambda a: a["n"])


def features(documents: DataFrame) -> DataFrame:
    """doc_id, source and the counts that rules judge."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    chars = F.length(F.regexp_replace(text, SEPARATORS, "")).cast("bigint")
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint")
    found = documents.select("doc_id", "source", by_word.alias("w"), chars.alias("word_chars"), symbols.alias("n_symbols"), by_line.alias("n_dup_lines"))
    return found.select("doc_id", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """source, n_docs, n_failed, host_rate (shrunk), host_failed for each host."""
    hosts = judged.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    moments = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"))
    mean = F.col("f") / F.col("n")
    # Between-host variance of rates by the usual one-way decomposition of binomial counts.
    spread = F.col("q") - F.col("f") * F.col("f") / F.col("n")
    freedom = F.col("n") - F.col("n2") / F.col("n")
    within = mean * (1 - mean)
    between = F.when(freedom > 0, (spread - (F.col("k") - 1) * within) / freedom)
    strength = F.when((between > 0) & (within > 0), F.least(F.greatest(within / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(F.lit(FLAT_STRENGTH))
    prior = moments.select(mean.alias("mean"), strength.alias("strength")).first()  # one row, whatever the input
    mean, strength = (F.lit(x).cast("double") for x in prior)
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", F.col("host_rate") > MAX_HOST_RATE)


def judged(documents: DataFrame) -> DataFrame:
    """features with base_failed, host_rate and kept for each row of documents."""
    rows = written(features(documents).withColumn("base_failed", base_failed()), "quality-features")
    hosts = host_verdicts(rows).select("source", "host_rate", "host_failed")
    # One row for each host on the right; where a source is hot, adaptive execution splits its left side.
    found = rows.join(hosts, "source", "left")
    return found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
f AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM j WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(f * f / n) AS q, sum(n * n) AS n2 FROM h),
v AS (SELECT f / n AS mean, f / n * (1 - f / n) AS within, CASE WHEN n - n2 / n > 0 THEN (q - f * f / n - (k - 1) * (f / n) * (1 - f / n)) / (n - n2 / n) END AS between_ FROM m),
p AS (SELECT mean, CASE WHEN between_ > 0 AND within > 0 THEN least(greatest(within / between_ - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {FLAT_STRENGTH} END AS strength FROM v),
s AS (SELECT source, (f + mean * strength) / (n + strength) > {MAX_HOST_RATE} AS failed FROM h, p)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(s.failed, FALSE) AS kept
FROM j LEFT JOIN s USING (source)
"""
