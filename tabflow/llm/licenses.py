"""Licence scans: an exact set-similarity join of blocks of words with licence templates.

A template is a set of words; it matches a block that holds at least the share `threshold` of them (containment). All
words of the templates are put in one order, the rarest in the corpus first, which takes one count over all documents.
In that order

- prefix filter: a block that matches has one of the template's first m - a + 1 words among its own first
  b - a + 1 (m and b: words of both, a: words that must be shared), so templates are looked up by their prefixes only;
- length filter: a block with fewer than a words of the templates cannot match;
- positional filter: words shared so far, and at most the fewer of those left on either side, must reach a.

What passes is counted exactly. Words outside the templates can be shared with none, so blocks leave them out.

Blocks are runs of words, sized by the template: a template of n words is sought in blocks of 2^k words that begin at every
2^(k-1)-th word, 2^(k-1) >= n, so that each run of n words of a text lies in one block. Blocks without a prefix word are
never made. Texts are cut once for the count and once for the join; the templates, whose number the caller sets, travel
with the tasks, and nothing is shuffled but one row per word of the templates and task.

Templates are like each other, so a notice often holds enough of several. Every match is given; of those whose blocks
overlap, the ones with the greatest containment, and of these with the most shared words, are marked as the best.

Beside the templates, phrases are found wherever their words stand one after the other.

Defined results: a null text is empty and has no words; an empty text matches nothing; long texts are cut whole; rows that
occur twice are scanned twice; if several templates match, all are given; an empty table gives an empty one; extra columns
are carried as `row`, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import kept_by_worker, packed
from tabflow.runtime import col

THRESHOLD = 0.8

#: Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label and the text of its usual notice; fixed values, public texts of the licences.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

#: ASCII but letters and digits separates words; letters are lower-cased within ASCII.
_APART = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_APART).split()


class Template(NamedTuple):
    """A template's words in the common order; `least` of them must be shared."""

    label: str
    tokens: np.ndarray
    least: int
    half: int


def _half(n: int) -> int:
    """The step of the blocks for a template of n words."""
    return 1 << max(0, n - 1).bit_length()


class Scanner:
    """Templates under a common order of their words, looked up by prefix."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], counts: dict[bytes, int], threshold: float):
        used = {w for _, text in templates for w in words(text)} | {w for p in phrases for w in words(p)}
        self.rank = {w: i for i, w in enumerate(sorted(used, key=lambda w: (counts.get(w, 0), w)))}
        self.phrases = [(label, np.array([self.rank[w] for w in words(p)])) for p, label in phrases.items()]
        self.scales: dict[int, dict[int, list[tuple[Template, int]]]] = {}
        self.prefix: dict[int, np.ndarray] = {}
        for label, text in templates:
            split = words(text)
            tokens = np.unique([self.rank[w] for w in split])
            least = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            t = Template(label, tokens, least, _half(len(split)))
            index = self.scales.setdefault(t.half, {})
            for i, token in enumerate(tokens[: len(tokens) - least + 1].tolist()):
                index.setdefault(token, []).append((t, i))
        for half, index in self.scales.items():
            self.prefix[half] = np.zeros(len(self.rank) + 1, bool)
            self.prefix[half][list(index)] = True

    def codes(self, split: list[bytes]) -> np.ndarray:
        """Rank of each word; the last rank and one more for words of no template."""
        get, other = self.rank.get, len(self.rank)
        return np.fromiter((get(w, other) for w in split), np.int32, len(split))

    def places(self, codes: np.ndarray) -> list[tuple[str, int]]:
        """Label and first word of every place where a phrase's words follow each other."""
        out = []
        for label, phrase in self.phrases:
            at = np.flatnonzero(codes == phrase[0])
            at = at[at + len(phrase) <= len(codes)]
            for i in range(1, len(phrase)):
                at = at[codes[at + i] == phrase[i]]
            out += [(label, i) for i in at.tolist()]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def matches(self, codes: np.ndarray) -> list[tuple[str, int, int, float, bool]]:
        """Label, first word, number of words, containment and `best` of every block that holds enough of a template."""
        out = []
        for half, index in self.scales.items():
            hits = np.flatnonzero(self.prefix[half][codes]) // half
            for block in np.unique(np.concatenate([hits, np.maximum(hits - 1, 0)])).tolist():
                part = codes[block * half : (block + 2) * half]
                out += [(block * half, len(part), n / len(t.tokens), n, t.label) for t, n in self._join(np.unique(part), index)]
        return _with_best(sorted(out))

    def _join(self, block: np.ndarray, index: dict[int, list[tuple[Template, int]]]) -> Iterator[tuple[Template, int]]:
        """Templates of one scale contained in a block, and the words shared; the block's words are distinct and in order."""
        if len(block) and block[-1] == len(self.rank):
            block = block[:-1]
        seen: set[int] = set()
        for j, token in enumerate(block.tolist()):
            for t, i in index.get(token, ()):
                # The first shared word decides: were there one before, it would have brought the template up.
                if id(t) in seen:
                    continue
                seen.add(id(t))
                if len(block) < t.least or min(len(t.tokens) - i, len(block) - j) < t.least:
                    continue
                shared = len(np.intersect1d(block, t.tokens, assume_unique=True))
                if shared >= t.least:
                    yield t, shared


def _with_best(found: list[tuple[int, int, float, int, str]]) -> list[tuple[str, int, int, float, bool]]:
    """Matches (first word, words, containment, shared words, label), sorted, with whether no overlapping one is better."""
    best = [True] * len(found)
    for i, (at, n, *_) in enumerate(found):
        for j in range(i + 1, len(found)):
            if found[j][0] >= at + n:
                break
            if found[i][2:4] != found[j][2:4]:
                best[i if found[i][2:4] < found[j][2:4] else j] = False
    return [(label, at, n, share, b) for (at, n, share, _, label), b in zip(found, best, strict=True)]


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often the words of the templates occur in all documents; a row per word and task is shuffled."""
    known = {w: i for i, w in enumerate(sorted(vocabulary))}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for t in batch["t"]:
                get, split = known.get, words(t)
                sums += np.bincount(np.fromiter((get(w, len(known)) for w in split), np.int32, len(split)), minlength=len(sums))
        there = np.flatnonzero(sums[:-1])
        yield pd.DataFrame({"word": there, "n": sums[there]})

    counted = docs.select(col(text).alias("t")).mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    names = list(known)
    return {names[r["word"]]: r["n"] for r in counted.collect()}


FOUND = (
    "struct<n_words:bigint,place_label:array<string>,place_at:array<bigint>,"
    "match_label:array<string>,match_at:array<bigint>,match_words:array<bigint>,match_share:array<double>,"
    "match_best:array<boolean>>"
)


def scan(
    docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(row, n_words, places, matches): each document with the places of phrases and the blocks that match templates.

    places: array of (label, at), in order; matches: array of (label, at, n_words, share, best), the blocks by their first
    word and size. Words count from 0.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    used = {w for _, t in templates for w in words(t)} | {w for p in phrases for w in words(p)}
    counts = word_counts(docs, used, text)
    key = ("licences", threshold, tuple(templates), tuple(phrases.items()), tuple(sorted(counts.items())))

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = kept_by_worker(key, lambda: Scanner(templates, phrases, counts, threshold))
        for batch in batches:
            rows = []
            for t in batch:
                codes = scanner.codes(words(t))
                places, matches = scanner.places(codes), scanner.matches(codes)
                rows.append((len(codes), *_columns(places, 2), *_columns(matches, 5)))
            yield pd.DataFrame(rows, columns=["n_words", "place_label", "place_at", "match_label", "match_at", "match_words", "match_share", "match_best"])

    marked = packed(docs, F.pandas_udf(found, FOUND)(col(text)).alias("f"))
    places = F.arrays_zip(F.col("f.place_label").alias("label"), F.col("f.place_at").alias("at"))
    matches = F.arrays_zip(
        F.col("f.match_label").alias("label"), F.col("f.match_at").alias("at"),
        F.col("f.match_words").alias("n_words"), F.col("f.match_share").alias("share"),
        F.col("f.match_best").alias("best"),
    )
    return marked.select("row", F.col("f.n_words").alias("n_words"), places.alias("places"), matches.alias("matches"))


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in itertools.islice(zip(*rows, strict=True), width)] if rows else [[] for _ in range(width)]
