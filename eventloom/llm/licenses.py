"""Licence scans by a positional rare-token index [native].

A template is a licence passage with a label and a mandatory key phrase within it; names of licences are passages that are
their own key phrase. Each template is posted in the index under its ``ANCHORS`` words of the highest IDF (over the template
collection), with their places. A file's licence words are looked up; each posting proposes a start of its template (place in
the file less place in the template), and the proposals of all anchors of a template are intersected. At a start that all
agree on, and where the whole passage has room, the key phrase is verified word by word; the label holds if it stands there.
The score is the largest share of a found template's words that stand at their places in the file, 0 where none is found.

Every occurrence is looked up; nothing is capped. One projection does it all: no shuffle, no Python.

Null text counts as empty: no words, null first and last word, empty labels, score 0. Repeated rows stay; an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, so that other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ascii_lower

#: (label, phrase), fixed values of the contract.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: The method's own templates: (label, passage, key phrase within it); fixed values, from the licences' texts.
MORE = (
    ("apache", "apache license version", "apache license version"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("mit", "mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "terms of the mozilla public license"),
    ("bsd", "bsd license", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied", "without warranty of any kind"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("creative-commons", "creative commons attribution", "creative commons attribution"),
    ("notice", "licensed under the", "licensed under the"),
)
ANCHORS = 3
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    key_at: int
    anchors: tuple[tuple[str, int], ...]  # (word, place)


def build_index(passages, anchors: int = ANCHORS) -> list[Template]:
    """Templates of (label, passage, key phrase), each with its rarest words; a key phrase stands at its first place."""
    split = [(label, tuple(p.split()), tuple(k.split())) for label, p, k in passages]
    seen = Counter(w for _, words, _ in split for w in set(words))
    out = []
    for label, words, key in split:
        at = next((i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key), None)
        if at is None or not key:
            raise ValueError(f"the key phrase {' '.join(key)!r} is not in its passage")
        order = sorted(range(len(words)), key=lambda i: (-math.log(len(split) / seen[words[i]]), -len(words[i]), i))
        out.append(Template(label, words, key, at, tuple((words[i], i) for i in order[:anchors])))
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), DELIMITERS, -1), lambda w: w != "")


def _starts(t: Template, number: int) -> Column:
    """(template, start) wherever all anchors of a template agree on a start, from the file's licence words ``m`` (w, i)."""

    def proposed(word: str, at: int) -> Column:
        return F.transform(F.filter("m", lambda o: o["w"] == word), lambda o: o["i"] - at)

    agreed = reduce(F.array_intersect, [proposed(w, at) for w, at in t.anchors])
    return F.transform(agreed, lambda s: F.struct(F.lit(number).alias("t"), s.alias("s")))


def scan_licenses(docs: DataFrame, base=BASE, more=MORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best found template's matched share)."""
    templates = build_index([*((label, p, p) for label, p in base), *more])
    rare = sorted({w for t in templates for w, _ in t.anchors})
    lists = lambda of: F.array(*[F.array(*map(F.lit, of(t))) for t in templates])
    passages, keys = lists(lambda t: t.words), lists(lambda t: t.key)
    places, names = F.array(*[F.lit(t.key_at) for t in templates]), F.array(*[F.lit(t.label) for t in templates])
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    # the file's licence words with their places
    marked = F.filter(F.transform("w", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<t:int,s:int>>")
    candidates = F.when(F.size("m") > 1, F.concat(*[_starts(t, i) for i, t in enumerate(templates)])).otherwise(none)

    def holds(x: Column) -> Column:
        key = F.element_at(keys, x["t"] + 1)
        room = (x["s"] >= 0) & (x["s"] + F.size(F.element_at(passages, x["t"] + 1)) <= F.size("w"))
        return F.when(room, F.slice("w", x["s"] + F.element_at(places, x["t"] + 1) + 1, F.size(key)) == key).otherwise(False)

    def share(x: Column) -> Column:
        words = F.element_at(passages, x["t"] + 1)
        equal = F.aggregate(F.zip_with(F.slice("w", x["s"] + 1, F.size(words)), words, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, e: n + e)
        return equal / F.size(words)

    hits = rows.select("*", marked.alias("m")).select("doc_id", "w", candidates.alias("c"))
    hits = hits.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), F.when(F.size("c") > 0, F.filter("c", holds)).otherwise(F.col("c")).alias("h"))
    hits = hits.select("*", F.filter("h", lambda x: x["t"] < len(base)).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.element_at(names, x["t"] + 1)))), ",")
    return hits.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("b", lambda x: x["s"])).cast("long").alias("last_word"),
        joined("b").alias("base_labels"), joined("h").alias("labels"),
        F.coalesce(F.array_max(F.transform("h", share)), F.lit(0.0)).alias("score"),
    )


def op7_license_scans(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template_rows() -> str:
    """(template, label, is base, words, place, word, needed): a row for each word; needed: of the key phrase or an anchor."""
    rows = []
    for i, t in enumerate(build_index([*((label, p, p) for label, p in BASE), *MORE])):
        needed = set(range(t.key_at, t.key_at + len(t.key))) | {at for _, at in t.anchors}
        rows += [f"({i}, {_quoted(t.label)}, {str(i < len(BASE)).lower()}, {len(t.words)}, {at}, {_quoted(w)}, {str(at in needed).lower()})" for at, w in enumerate(t.words)]
    return ", ".join(rows)


#: Brute force: every start at which a word of a template stands is tried.
OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), t(t, label, base, size, place, word, needed) AS (VALUES {_template_rows()}
), k AS (SELECT t, count(*) FILTER (needed) AS need FROM t GROUP BY 1
), p AS (SELECT n, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), m AS (
  SELECT n, t.t, i - place AS s, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size, count(*) AS equal, count(*) FILTER (needed) AS got
  FROM p JOIN t USING (word) WHERE i >= place AND i - place + size <= n_words GROUP BY ALL
), h AS (SELECT m.* FROM m JOIN k USING (t) WHERE got = need
), g AS (
  SELECT n, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         list_sort(list(DISTINCT label) FILTER (base)) AS b, list_sort(list(DISTINCT label)) AS l, max(equal::DOUBLE / size) AS score
  FROM h GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (n)
"""
