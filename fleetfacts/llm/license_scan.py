"""License scan by a positional index of rare template words, in DataFrame functions only.

Method: templates are passages of licences. The numbers of documents of their words are counted over the whole table; the rarest words of each
template, with their places in it, are the index. In a file, the highest-IDF indexed words of each template are looked up; a
place in the file less a place in the template is where the template would begin, and beginnings on which two different words agree are
alignments. An alignment counts if the template's mandatory key phrase stands at its place there. Its score is the share of the template's
words that stand in place.

All of it is array work inside one row: no text is shuffled, and a long file is one row's linear work. The only result that comes to the driver are
the numbers of documents of template words, which the templates bound.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import read_table

# Names that the contract of the query looks for, and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Passages of public licences and usual notices, as words; the mandatory key phrase stands in brackets.
TEMPLATES = (
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"
            " the software to deal in the software without restriction"),
    ("apache", "licensed under the [apache license] version 2 0"),
    ("apache", "you may not use this file [except in compliance with the license] you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing [software distributed under the license] is distributed on an as is"
               " basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the [gnu general public license] version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software"
            " foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free"
             " software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the [gnu affero general public license] as published by the free"
             " software foundation"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following"
            " conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software [for any purpose with or without fee] is hereby granted provided"
            " that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by", "this work is licensed under a [creative commons attribution] 4 0 international license"),
    ("cc0", "to the extent possible under law the author has [waived all copyright] and related or neighboring rights to this work"),
    ("unlicense", "this is free and [unencumbered software released into the public domain]"),
    ("zlib", "in no event will the authors be held liable for any damages [arising from the use of this software]"),
    ("boost", "distributed under the [boost software license] version 1 0"),
)
# Of a template's different words, half are indexed, at most this many, the rarest first.
MOST_INDEXED = 8
# Of a file's indexed words of a template, so many are looked up, the rarest first; so many must agree on an alignment.
PROBES, AGREEING = 4, 2
# The score of a document with a base phrase, where no alignment has a higher one.
BASE_SCORE = 0.5

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def parse_template(label: str, passage: str) -> tuple[str, list[str], int, list[str]]:
    """label, words, place of the key phrase in words, the key phrase."""
    before, phrase, after = passage.replace("]", "[").split("[")
    return label, before.split() + phrase.split() + after.split(), len(before.split()), phrase.split()


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({word for label, passage in templates for word in parse_template(label, passage)[1]})


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of_text(text: Column) -> Column:
    """Words, A-Z lower-cased; null as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)
    return F.filter(F.split(lower, _BETWEEN), lambda w: w != "")


def document_numbers(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many rows of `docs` each word of the templates occurs; as many entries as the templates have words."""
    vocabulary = F.split(F.lit(" ".join(template_words(templates))), " ")
    found = docs.select(F.explode(F.array_intersect(words_of_text(F.col("text")), vocabulary)).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_token_index(numbers: dict[str, int], templates=TEMPLATES) -> list[tuple]:
    """Per template: label, words, place and words of the key phrase, indexed words with their places, rarest first.

    Words in equally many documents stand in alphabetical order.
    """
    out = []
    for label, passage in templates:
        label, words, start, phrase = parse_template(label, passage)
        different = sorted(set(words), key=lambda w: (numbers.get(w, 0), w))
        indexed = different[: min(MOST_INDEXED, -(-len(different) // 2))]
        out.append((label, words, start, phrase, [(w, [i for i, x in enumerate(words) if x == w]) for w in indexed]))
    return out


_INDEX = "array<struct<label: string, words: array<string>, start: int, phrase: array<string>, index: array<struct<word: string, places: array<int>>>>>"


def _literal(index: list[tuple]) -> Column:
    """The index as one constant of the plan."""
    names = ("label", "words", "start", "phrase")
    rows = [dict(zip(names, t)) | {"index": [{"word": w, "places": places} for w, places in t[4]]} for t in index]
    return F.from_json(F.lit(json.dumps(rows)), _INDEX)


def _alignments(template: Column, hits: Column, present: Column) -> Column:
    """Beginnings of the template on which at least two of its looked up words agree."""
    probes = F.slice(F.filter(template["index"], lambda v: F.array_contains(present, v["word"])), 1, PROBES)
    begins = F.flatten(F.transform(probes, lambda p: F.array_distinct(F.flatten(
        F.transform(F.filter(hits, lambda h: h["w"] == p["word"]), lambda h: F.transform(p["places"], lambda q: h["i"] - q))
    ))))
    # Each word brings a beginning once, so that one that stands `AGREEING` times in a row is agreed on.
    return let(F.array_sort(begins), lambda b: F.array_distinct(F.filter(b, lambda x, i: F.get(b, i - (AGREEING - 1)) == x)))


def _share(template: Column, words: Column, begin: Column) -> Column:
    """Share of the template's words in place, 0 if its key phrase isn't."""
    at = begin + template["start"]
    phrase = (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(template["phrase"])) == template["phrase"])
    in_place = F.filter(F.sequence(F.lit(0), F.size(template["words"]) - 1), lambda j: F.get(words, begin + j) == F.get(template["words"], j))
    return F.when(phrase, F.size(in_place) / F.size(template["words"])).otherwise(0.0)


def _places(phrase: list[str], label: str, words: Column, hits: Column) -> Column:
    """(place, label) of every place where the phrase stands; its first word is among the hits."""
    stands = lambda h: (h["w"] == phrase[0]) & (F.slice(words, h["i"] + 1, len(phrase)) == F.split(F.lit(" ".join(phrase)), " "))
    return F.transform(F.filter(hits, stands), lambda h: F.struct(h["i"].alias("place"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, base (place and label of every base phrase), found (label and score by template) and score of each row of `docs`.

    Numbers of documents are counted over all rows of `docs`. A null text has no words; a row without words has no labels and the score 0.
    Repeated rows are scanned each; a null doc_id stays null; other columns than doc_id, text and those in `keep` are not looked at.
    """
    index = rare_token_index(document_numbers(docs, templates), templates)
    vocabulary = sorted({w for t in index for w, _ in t[4]} | {phrase.split()[0] for phrase, _ in BASE_PHRASES})
    words = words_of_text(F.col("text"))

    def scanned(words):
        hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
        return let(hits, lambda hits: F.struct(F.size(words).alias("n_words"), based(words, hits).alias("base"), found(words, hits).alias("found")))

    def based(words, hits):
        return F.array_sort(F.concat(*[_places(phrase.split(), label, words, hits) for phrase, label in BASE_PHRASES]))

    def found(words, hits):
        def one(template, present):
            shares = F.transform(_alignments(template, hits, present), lambda b: _share(template, words, b))
            return F.struct(template["label"].alias("label"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"))

        present = F.array_distinct(F.transform(hits, lambda h: h["w"]))
        return let(present, lambda present: F.filter(F.transform(_literal(index), lambda t: one(t, present)), lambda f: f["score"] > 0))

    best = F.array_max(F.transform("scan.found", lambda f: f["score"]))
    return docs.select(F.col("doc_id"), *[F.col(f"`{c}`") for c in keep], let(words, scanned).alias("scan")).select(
        "doc_id", *[F.col(f"`{c}`") for c in keep], "scan.n_words", "scan.base", "scan.found",
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("scan.base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )


def op12_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    places = F.transform("base", lambda b: b["place"].cast("long"))
    base = F.transform("base", lambda b: b["label"])
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan_licenses(docs).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), named(base).alias("base_labels"),
        named(F.concat(base, F.transform("found", lambda f: f["label"]))).alias("labels"), "score",
    )


def _values() -> str:
    rows = []
    for k, (label, passage) in enumerate(TEMPLATES):
        label, words, start, phrase = parse_template(label, passage)
        rows.append(f"({k}, '{label}', '{' '.join(words)}', {start}, '{' '.join(phrase)}')")
    return ", ".join(rows)


_BASE_VALUES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in BASE_PHRASES)

SQL = rf"""
WITH templates AS (
  SELECT template, label, string_split(passage, ' ') AS words, start, string_split(phrase, ' ') AS phrase
  FROM (VALUES {_values()}) AS v(template, label, passage, start, phrase)
),
places AS (SELECT template, unnest(words) AS w, unnest(generate_series(0, len(words) - 1)) AS place FROM templates),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
e AS (SELECT r, unnest(words) AS w, unnest(generate_series(0, len(words) - 1)) AS i FROM d),
numbers AS (SELECT w, count(DISTINCT r) AS n FROM e WHERE w IN (SELECT w FROM places) GROUP BY w),
ranked AS (
  SELECT template, w, n, row_number() OVER (PARTITION BY template ORDER BY n, w) AS k, count(*) OVER (PARTITION BY template) AS different
  FROM (SELECT DISTINCT template, p.w, coalesce(n, 0) AS n FROM places p LEFT JOIN numbers ON numbers.w = p.w)
),
indexed AS (SELECT * FROM ranked WHERE k <= least({MOST_INDEXED}, (different + 1) // 2)),
probes AS (
  SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY n, w) AS place_in_file
  FROM (SELECT DISTINCT r, template, indexed.w, n FROM e JOIN indexed ON e.w = indexed.w)
),
begins AS (
  SELECT DISTINCT e.r, p.template, e.w, e.i - q.place AS b
  FROM e JOIN probes p ON e.r = p.r AND e.w = p.w JOIN places q ON q.template = p.template AND q.w = e.w
  WHERE p.place_in_file <= {PROBES}
),
aligned AS (SELECT r, template, b FROM begins GROUP BY r, template, b HAVING count(*) >= {AGREEING}),
scored AS (
  SELECT a.r, t.label, len(list_filter(generate_series(0, len(t.words) - 1), lambda j:
      a.b + j >= 0 AND coalesce(d.words[a.b + j + 1] = t.words[j + 1], false))) / len(t.words) AS score
  FROM aligned a JOIN templates t USING (template) JOIN d USING (r)
  WHERE a.b + t.start >= 0 AND d.words[a.b + t.start + 1 : a.b + t.start + len(t.phrase)] = t.phrase
),
base AS (
  SELECT e.r, e.i, p.label FROM (SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES {_BASE_VALUES}) AS v(phrase, label)) p
  JOIN e ON e.w = p.phrase[1] JOIN d USING (r) WHERE d.words[e.i + 1 : e.i + len(p.phrase)] = p.phrase
),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
s AS (SELECT r, max(score) AS score FROM scored GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM scored) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r) LEFT JOIN l USING (r)
"""
