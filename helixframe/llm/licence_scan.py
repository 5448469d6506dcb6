"""Licence scan with a positional rare-token index.  DataFrame functions only.

Templates are licence texts, each with a key phrase that must stand word for word.  Their words form a vocabulary; the
number of texts with each of its words, counted over all texts, gives inverse document frequencies.  The index posts
each template under the POSTED words of its key phrase that are rarest by these, with their positions.  In a text that
has a template's rarest word, each place of a posted word looks up its postings; the place less the posted position is
where the template would begin.  Begins that all of a template's postings agree on are its candidates.  There the key
phrase is verified and the template's other words are compared by their relative positions; the score is the share of
the template's weight found.

Templates and index are data (one literal each), so that the plan is as long for ten templates as for hundreds.

The four base phrases are templates that are nothing but key phrase, so that each place of theirs is found.

Defined results: a null or empty text has no words, no labels and score 0; texts of any length are scanned whole; of
equally rare words the first in the phrase is posted, a word that a phrase repeats at each of its posted places, and a
place of several templates gives each of their labels; rows that repeat a doc_id each come out; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import let, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A template of the method's own counts from this share of its weight on.
LEAST_SHARE = 0.6
#: Words of a key phrase that are posted.
POSTED = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the key phrase's first word and the one after its last
    base: bool = False


def _template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, phrase = text.split(), key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, tuple(words), (at, at + len(phrase)), base)


#: The base phrases.
BASE = tuple(_template(label, text, text, True) for label, text in (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")))
#: Opening words of common licences, with the words that must stand.
TEMPLATES = BASE + tuple(
    _template(*x)
    for x in (
        ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
        ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
        ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
        ("lgpl", "gnu lesser general public license", "lesser general public license"),
        ("agpl", "gnu affero general public license", "affero general public license"),
        ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
        ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
        ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
        ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    )
)


def words(text: Column) -> Column:
    """Lower-cased words; beyond A-Z, lower-casing changes no word's being equal to a template's, which are ASCII without k."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def inverse_frequencies(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """log((texts + 1) / (texts with the word + 1)) of each word of the templates, over all texts."""
    known = vocabulary(templates)
    has = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, known)))
    # A row for each word at most, whatever the input; the empty word counts texts.
    rows = documents.select(F.explode(F.array_append(has, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in known}


def postings(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> list[list[tuple[str, int]]]:
    """For each template the rarest words of its key phrase with their positions, rarest first; of equally rare ones the first."""
    return [[(t.words[i], i) for i in sorted(range(*t.key), key=lambda i: (-idf[t.words[i]], i))[:POSTED]] for t in templates]


KIND = "array<struct<label:string,base:boolean,at:int,score:double>>"
INDEX = "map<string,array<struct<t:int,at:int,n:int>>>"
TABLE = "array<struct<label:string,base:boolean,first:int,last:int,words:array<string>,weights:array<double>,total:double>>"


def literal(value: object, kind: str) -> Column:
    """value as one literal: the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def matches(w: Column, idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> Column:
    """(label, base, at, score) of each place of a template in the words w."""
    posted = postings(idf, templates)
    index: dict[str, list[dict[str, int]]] = {}
    for t, words_ in enumerate(posted):
        for word, at in words_:
            index.setdefault(word, []).append({"t": t, "at": at, "n": len(words_)})
    rows = [{"label": t.label, "base": t.base, "first": t.key[0], "last": t.key[1] - 1, "words": t.words, "weights": [idf[x] for x in t.words], "total": sum(idf[x] for x in t.words)} for t in templates]
    table_, lookup = literal(rows, TABLE), literal(index, INDEX)
    rarest = sorted({x[0][0] for x in posted})

    # (template, begin, postings of the template) for each posting of each place of a posted word.
    places = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda p: p["word"].isin(sorted(index)))
    begins = F.flatten(F.transform(places, lambda p: F.transform(lookup[p["word"]], lambda q: F.struct(q["t"].alias("t"), (p["at"] - q["at"]).alias("at"), q["n"].alias("n")))))
    # Sorted, a begin stands as often as postings agree on it: it is a candidate if as many do as the template has.
    agreed = let(F.sort_array(begins), lambda s: F.filter(s, lambda x, i: F.get(s, i + x["n"] - 1).eqNullSafe(x)))

    def scored(c: Column) -> Column:
        """The candidate's match, null where the key phrase doesn't stand."""
        t = F.get(table_, c["t"])
        same = lambda t, j: F.coalesce(F.get(w, c["at"] + j) == F.get(t["words"], j), F.lit(False))
        numbers = lambda t: F.sequence(F.lit(0), F.size(t["words"]) - 1)
        stands = lambda t: (c["at"] + t["first"] >= 0) & F.forall(F.sequence(t["first"], t["last"]), lambda j: same(t, j))
        found = lambda t: F.aggregate(numbers(t), F.lit(0.0), lambda a, j: a + F.when(same(t, j), F.get(t["weights"], j)).otherwise(0.0))
        score = lambda t: F.when(t["base"] | (t["total"] <= 0), 1.0).otherwise(found(t) / t["total"])
        made = lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), c["at"].alias("at"), score(t).alias("score"))
        return let(t, lambda t: F.when(stands(t), made(t)))

    found = F.filter(F.transform(agreed, scored), lambda m: m.isNotNull() & (m["score"] >= LEAST_SHARE)).cast(KIND)
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, rarest))), found).otherwise(F.array().cast(KIND))


def scan(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and matches of each row."""
    idf = inverse_frequencies(documents, templates)
    found = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), matches(w, idf, templates).alias("matches")))
    return documents.select("doc_id", found.alias("found")).select("doc_id", "found.n_words", "found.matches")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("matches", lambda m: m["base"]))
    joined = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda m: m["at"].cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("matches").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 9).alias("score"),
    )


def _oracle() -> str:
    quoted = lambda x: "'" + x + "'"
    known = vocabulary(TEMPLATES)
    parts = []
    for t in TEMPLATES:
        same = lambda j: f"(i >= {-j} AND coalesce(w[i + {j + 1}] = {quoted(t.words[j])}, FALSE))"  # noqa: E731, B023
        phrase = " AND ".join(same(j) for j in range(*t.key))
        weight = "1.0::DOUBLE" if t.base else "(" + " + ".join(f"CASE WHEN {same(j)} THEN idf[{quoted(x)}] ELSE 0.0 END" for j, x in enumerate(t.words)) + ") / (" + " + ".join(f"idf[{quoted(x)}]" for x in t.words) + ")"
        parts.append(f"SELECT r, {quoted(t.label)} AS label, {str(t.base).upper()} AS base, i AS pos, {weight} AS score FROM places WHERE {phrase}")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
n AS (SELECT (SELECT count(*) FROM d) AS n),
df AS (SELECT word, (SELECT count(*) FROM d WHERE list_contains(w, word)) AS k FROM (SELECT unnest([{", ".join(map(quoted, known))}]) AS word)),
idfs AS (SELECT map(list(word), list(ln((n + 1)::DOUBLE / (k + 1)))) AS idf FROM df, n),
places AS (
  SELECT r, w, i, idf FROM (SELECT r, w, unnest(range(-{max(t.key[0] for t in TEMPLATES)}, len(w))) AS i FROM d WHERE list_has_any(w, ['license', 'cc', 'hereby', 'forms', 'unencumbered'])), idfs),
m AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM m WHERE score >= {LEAST_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
