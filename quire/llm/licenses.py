"""Operator 6: license scans by exact set-similarity join.

License templates are sets of words.  A text is cut into blocks of
``BLOCK_WORDS`` words that overlap by half, so that any passage of up to half
a block lies whole in one of them.  A block meets a template if it holds at
least ``CONTAINMENT`` of the template's words.  All such pairs are found:

* tokens are ordered by their frequency over the whole corpus, rare first;
* prefix filter: a template of m words of which o are needed must share one
  of its first m - o + 1 words with the block, and that word must be one of
  the block's first b - o + 1;
* length filter: the block holds at least o template words;
* positional filter: the first shared word at places i and j leaves room for
  o words in all.

Words outside all templates can share nothing and are left out of the block's
set.  Pairs that pass are verified on the sets.  Phrases that name a license
are found beside this (the base labels).

Native: texts are matched row by row against the templates, a small fixed
table; the one shuffle is the partial aggregate of word frequencies, at most
one row per template word.

Defined results: null, empty and wordless texts have no words, labels or
places and score 0; repeated rows are judged alike; a text shorter than a
block is one block; equal frequencies are ordered by the word; other columns
pass by.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read, words

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
BLOCK_WORDS = 240

# fixed values: phrases that name a license
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# fixed values: the passages by which licenses are known
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                 "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                 "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                 "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
            "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a "
                 "copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
)


def template_words(text: str) -> list[str]:
    return re.findall(TOKEN, text.translate({c: c + 32 for c in range(65, 91)}))


def text_words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), TOKEN)


def phrase_places(w: Column, phrases=PHRASES) -> list[tuple[str, Column]]:
    """(label, starts) of each phrase; texts without its words are not walked."""
    def places(own: list[str]) -> Column:
        have = _all([F.array_contains(w, x) for x in own])
        walk = F.filter(F.transform(w, lambda x, i: F.when(x == own[0], i)), lambda i: i.isNotNull())
        here = F.filter(walk, lambda i: _all([F.coalesce(F.get(w, i + k) == x, F.lit(False)) for k, x in enumerate(own)]))
        return F.when(have, here).otherwise(F.array().cast("array<int>"))

    return [(label, places(phrase.split(" "))) for phrase, label in phrases]


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def frequency_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words by the number of texts that hold them, rare first."""
    lit = F.array(*map(F.lit, vocabulary))
    got = (docs.select(F.explode(F.array_intersect(text_words(F.col("text")), lit)).alias("w"))
               .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())  # at most one row per template word
    n = {r["w"]: r["n"] for r in got}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


class Index:
    """Templates as sorted ranks, with what the filters need."""

    def __init__(self, order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT):
        self.order = order
        rank = {w: k for k, w in enumerate(order)}
        self.sets = []
        for label, text in templates:
            own = sorted({rank[w] for w in template_words(text)})
            need = ceil(containment * len(own) - 1e-9)
            self.sets.append((label, own, need))

    def prefix_words(self) -> list[str]:
        """Every text that meets a template holds one of these."""
        return sorted({self.order[k] for _, own, need in self.sets for k in own[: len(own) - need + 1]})

    def ranks(self, block: Column) -> Column:
        """Sorted ranks of the template words of a block."""
        vocabulary = F.array(*map(F.lit, self.order))
        return F.array_sort(F.transform(F.array_intersect(vocabulary, block), lambda w: F.array_position(vocabulary, w).cast("int") - 1))

    def test(self, k: int):
        """A function from a block's ranks to the share of template k in it."""
        return lambda ranks: self.containment(ranks, k)

    def containment(self, ranks: Column, k: int) -> Column:
        """The share of template k in a block, null unless it is met."""
        _, own, need = self.sets[k]
        m, lit = len(own), F.array(*map(F.lit, own))
        prefix = F.array(*map(F.lit, own[: m - need + 1]))
        b = F.size(ranks)
        first = F.get(F.array_intersect(F.slice(ranks, 1, F.greatest(b - need + 1, F.lit(1))), prefix), F.lit(0))
        # places of the first shared word leave room for the words needed
        room = 1 + F.least(F.lit(m) - F.array_position(lit, first), b - F.array_position(ranks, first))
        shared = F.size(F.array_intersect(ranks, lit))
        return F.when((b >= need) & first.isNotNull() & (room >= need) & (shared >= need), shared / F.lit(float(m)))


def blocks(w: Column) -> Column:
    """Blocks of ``BLOCK_WORDS`` words, each half a block after the last."""
    step = BLOCK_WORDS // 2
    last = F.greatest(F.ceil(F.size(w) / F.lit(step)).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, F.lit(BLOCK_WORDS)))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    index = Index(frequency_order(docs, vocabulary), templates)
    d = docs.select("doc_id", text_words(F.col("text")).alias("w"))
    found = phrase_places(F.col("w"), phrases)
    d = d.select("doc_id", "w", *[c.alias(f"at{k}") for k, (_, c) in enumerate(found)])
    # only texts with a word of some template's prefix are cut into blocks
    may = F.arrays_overlap(F.col("w"), F.array(*map(F.lit, index.prefix_words())))
    sets = F.when(may, F.transform(blocks(F.col("w")), index.ranks)).otherwise(F.array().cast("array<array<int>>"))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"), *[f"at{k}" for k in range(len(found))], sets.alias("sets"))
    shares = [F.array_max(F.transform("sets", index.test(k))) for k in range(len(index.sets))]
    d = d.select(*[c for c in d.columns if c != "sets"], F.concat(*[F.col(f"at{k}") for k in range(len(found))]).alias("at"),
                 *[c.alias(f"share{k}") for k, c in enumerate(shares)])
    base = F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(found)])
    own = F.array(*[F.when(F.col(f"share{k}").isNotNull(), F.lit(label)) for k, (label, _, _) in enumerate(index.sets)])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    best = F.greatest(F.lit(0.0), F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                      *[F.coalesce(f"share{k}", F.lit(0.0)) for k in range(len(index.sets))])
    return d.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
                    F.array_max("at").cast("long").alias("last_word"), joined(base).alias("base_labels"),
                    joined(F.concat(base, own)).alias("labels"), best.alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
