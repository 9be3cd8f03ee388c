"""License scan with a positional index of licence templates, by DataFrame functions alone.

The index lists, for every word of the templates, the templates and places it stands in. Of each file the words that occur
in templates are ranked by inverse document frequency over the whole table, and the ANCHORS highest of every template whose
mandatory phrases it has the words of are looked up: each place of such a word and each of its postings say where the template would begin. Starts on which AGREE postings
agree are verified: the template's mandatory phrases must stand at their places. All of it happens inside a row, so no text is shuffled
and no file meets another; only document frequencies of template words (a fixed number of them) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rarest words of a template that are looked up, and postings that must agree on its start.
ANCHORS, AGREE = 4, 2
#: Room for the start of a template in a candidate's number.
_STARTS = 1 << 40


@dataclass(frozen=True)
class Template:
    """``label`` of the licence, its ``text`` in words, and ``phrases`` that must stand at their places in it."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> set[str]:
        return {w for phrase in self.phrases for w in phrase.split()}

    def places(self) -> list[tuple[int, list[str]]]:
        out = []
        for phrase in self.phrases:
            p, w = phrase.split(), self.words
            out.append((next(i for i in range(len(w)) if w[i:i + len(p)] == p), p))
        return out


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,))


# fixed values: the phrases that every scan reports
BASE = (
    _phrase("gpl", "gnu general public license"),
    _phrase("apache", "apache license"),
    _phrase("cc-by", "cc by"),
    _phrase("mit", "mit license"),
)
# fixed values: opening sentences and notices of public licences
NOTICES = (
    Template("gpl-2", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
             " license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
             " documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
             " following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and", "with or without fee")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, lower-cased; one empty word where there are none.

    ``lower`` maps other letters too, which moves no word's bounds; only the Kelvin sign would turn into an ASCII letter, so it is
    put aside first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    line = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.split(line, " ")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``words(w)``, and in how many each word of ``vocabulary`` occurs: one row a word reaches the driver."""
    found = words.select(F.explode(F.array_append(F.array_intersect(strings(vocabulary), "w"), F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE,
         notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` lists every verified place of a template: label, start (word, from 0), share (of the IDF weight of the template's words, what
    stands at its place). n_base counts the places of ``base`` templates, first_word and last_word are the smallest and largest of them,
    null without any. base_labels and labels (those of notices too) are distinct, sorted and joined by commas, empty
    without any. score is the greatest share, 0 without a match. A null text counts as empty: no words, no matches.
    Rows that repeat an id or a text have rows of their own; an empty table gives none. Other columns are not read.
    """
    templates = [*base, *notices]
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    total, counts = document_frequencies(rows.select("w"), vocabulary)
    weight = {w: math.log(1 + total / (1 + counts.get(w, 0))) for w in vocabulary}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}

    own = rows.select("*", F.array_intersect(strings(vocabulary), "w").alias("known"))
    nothing = F.array().cast("array<string>")
    # a file that lacks a word of a template's phrases needs no look at its others
    rarest = [F.when(F.size(F.array_except(strings(sorted(t.needed)), "known")) == 0,
                     F.slice(F.array_intersect(strings(sorted(set(t.words), key=rank.get)), "known"), 1, ANCHORS)).otherwise(nothing)
              for t in templates]
    looked = own.select("doc_id", "w", F.when(F.size("known") < AGREE, nothing)
                        .otherwise(F.array_distinct(F.flatten(F.array(*rarest)))).alias("anchors"))
    spots = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("anchors", x), i)), lambda i: i.isNotNull())
    placed = looked.select("doc_id", "w", F.when(F.size("anchors") > 0, spots).otherwise(F.array().cast("array<int>")).alias("spots"))

    postings = F.create_map(*[c for w in vocabulary for c in (F.lit(w), F.array(*[
        F.lit(k * _STARTS - at) for k, t in enumerate(templates) for at, x in enumerate(t.words) if x == w]))])
    starts = F.array_sort(F.flatten(F.transform("spots", lambda i: F.transform(
        F.element_at(postings, F.get("w", i)), lambda p: p + i))))
    voted = placed.select("doc_id", "w", starts.alias("votes"))
    agreed = F.filter("votes", lambda v, i: (F.get("votes", i + (AGREE - 1)) == v) & ((i == 0) | (F.get("votes", i - 1) != v)))
    # a start before the first word has its number below the template's own and is none
    named = F.filter(F.transform(agreed, lambda v: F.struct(F.floor(v / _STARTS).cast("int").alias("t"), (v % _STARTS).alias("start"))),
                     lambda c: c["start"] < F.size("w"))

    def verified(c: Column) -> Column:
        checks = [reduce(lambda a, b: a & b, [F.slice("w", (c["start"] + at + 1).cast("int"), len(p)) == strings(p) for at, p in t.places()])
                  for t in templates]
        return reduce(lambda rest, k: F.when(c["t"] == k, checks[k]).otherwise(rest), range(len(templates)), F.lit(False))

    held = voted.select("doc_id", "w", F.filter(named, verified).alias("found"))
    sheet = F.array(*[F.array(*[F.struct(F.lit(w).alias("word"), F.lit(weight[w]).alias("weight")) for w in t.words]) for t in templates])
    sums = F.array(*[F.lit(sum(weight[w] for w in t.words)) for t in templates])
    labels = strings([t.label for t in templates])

    def share(c: Column) -> Column:
        at_place = F.transform(F.element_at(sheet, c["t"] + 1), lambda p, j: F.when(
            F.get("w", (c["start"] + j).cast("int")) == p["word"], p["weight"]).otherwise(0.0))
        return F.aggregate(at_place, F.lit(0.0), lambda a, x: a + x) / F.element_at(sums, c["t"] + 1)

    matches = F.transform("found", lambda c: F.struct(
        c["t"].alias("t"), F.element_at(labels, c["t"] + 1).alias("label"), c["start"].alias("start"), share(c).alias("share")))
    out = held.select("doc_id", F.when(F.get("w", F.lit(0)) == "", 0).otherwise(F.size("w")).cast("long").alias("n_words"), matches.alias("matches"))
    basic = F.filter("matches", lambda m: m["t"] < len(base))
    join = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(basic).cast("long").alias("n_base"),
        F.array_min(F.transform(basic, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(basic, lambda m: m["start"])).alias("last_word"),
        join(basic).alias("base_labels"), join(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.transform("matches", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["share"].alias("share"))).alias("matches"))


def oracle_sql() -> str:
    """The digest of ``scan`` over ``documents`` in SQL, from the same templates."""
    templates = [*BASE, *NOTICES]
    listed = ", ".join(f"({k}, {j}, '{w}')" for k, t in enumerate(templates) for j, w in enumerate(t.words))
    phrased = ", ".join(f"({k}, {at}, {len(p)}, '{' '.join(p)}')" for k, t in enumerate(templates) for at, p in t.places())
    labelled = ", ".join(f"({k}, '{t.label}')" for k, t in enumerate(templates))
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
sheet AS (SELECT * FROM (VALUES {listed}) AS v(t, j, word)),
phrases AS (SELECT * FROM (VALUES {phrased}) AS v(t, place, size, phrase)),
names AS (SELECT * FROM (VALUES {labelled}) AS v(t, label)),
vocabulary AS (SELECT DISTINCT word FROM sheet),
words AS (SELECT r, i - 1 AS i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts) WHERE w[i] IN (FROM vocabulary)),
frequency AS (SELECT word, count(DISTINCT r) AS df FROM vocabulary LEFT JOIN words USING (word) GROUP BY word),
weights AS (SELECT word, df, ln(1 + (SELECT count(*) FROM texts) / (1.0 + df)) AS weight FROM frequency),
needed AS (SELECT DISTINCT t, unnest(string_split(phrase, ' ')) AS word FROM phrases),
possible AS (
  SELECT r, t FROM (SELECT DISTINCT r, word FROM words) JOIN needed USING (word) GROUP BY r, t
  HAVING count(*) = (SELECT count(*) FROM needed AS m WHERE m.t = needed.t)),
ranked AS (
  SELECT r, word, row_number() OVER (PARTITION BY r, t ORDER BY df, word) AS place
  FROM (SELECT DISTINCT r, word FROM words) JOIN (SELECT DISTINCT t, word FROM sheet) USING (word)
  JOIN weights USING (word) JOIN possible USING (r, t)),
anchors AS (SELECT DISTINCT r, word FROM ranked WHERE place <= {ANCHORS}),
votes AS (
  SELECT r, t, i - j AS start FROM words JOIN anchors USING (r, word) JOIN sheet USING (word)
  GROUP BY r, t, i - j HAVING count(*) >= {AGREE} AND i - j >= 0),
held AS (
  SELECT r, t, start FROM votes JOIN texts USING (r) JOIN phrases USING (t)
  GROUP BY r, t, start HAVING bool_and(array_to_string(w[start + place + 1:start + place + size], ' ') = phrase)),
shares AS (
  SELECT r, t, start, sum(CASE WHEN w[start + j + 1] = word THEN weight ELSE 0 END) / sum(weight) AS share
  FROM held JOIN texts USING (r) JOIN sheet USING (t) JOIN weights USING (word) GROUP BY r, t, start),
found AS (
  SELECT r, count(*) FILTER (t < {len(BASE)}) AS n_base, min(start) FILTER (t < {len(BASE)}) AS first_word,
         max(start) FILTER (t < {len(BASE)}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {len(BASE)}) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM shares JOIN names USING (t) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM texts LEFT JOIN found USING (r)"""
