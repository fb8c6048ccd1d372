"""License scans: winnowed fingerprints pick candidates, alignment confirms.

Texts and templates are words of ASCII letters and digits, lower-cased.
Fingerprints are the least hash of every ``WINDOW`` consecutive shingles of
``SHINGLE`` words, so a text that shares ``SHINGLE + WINDOW - 1`` words in a
row with a template shares a fingerprint.  An inverted index leads from a
fingerprint to its places in templates.  Hits of one template with nearby
diagonals (place in the text less place in the template) are one candidate:
the words there are aligned locally with the template (match 1, mismatch and
gap -1) within ``BAND`` diagonals on each side (a sixteenth of a long
template), and a candidate whose aligned matches cover ``MIN_COVER`` of the
template is reported with its coverage and span.  Places whose words, in any
order, can't cover as much aren't aligned.

The templates are a parameter (a fixed, bounded list): by default notices and
standard headers, and the full texts in the folder ``licenses``.  Results: a null or
empty text has no licenses; of overlapping candidates, of one template or of
several, the one of the best alignment score stays (ties: the higher coverage,
then the first template).  Notices and headers (under ``SHORT`` words) differ
by a word or a number only, so the numbers and the words of ``TELLING`` in the
span have to be those of the template.
"""

from __future__ import annotations

import bisect
import re
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from factlens.llm.common import Shared, struct_udf, without

SHINGLE, WINDOW, BAND, MIN_COVER = 3, 2, 6, 0.7
SHORT = 120
TELLING = {"by", "nc", "sa", "nd", "mit", "bsd", "apache", "mozilla", "gpl", "lgpl", "agpl", "mpl"}
GENERAL = {"lesser", "library", "affero"}  # before "general"
WORD = re.compile(rb"[0-9a-z]+")
PLACED = re.compile("[0-9A-Za-z]+")
# fixed values: notices, headers and full texts of public licenses
_FSF = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the " \
       "Free Software Foundation; either version {2} of the License, or (at your option) any later version."
TEMPLATES = {
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                         "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                         'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
                 "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0 header": _FSF.format("program", "General Public License", "2"),
    "GPL-2.0-only header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                           "Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.0 header": _FSF.format("library", "Library General Public License", "2"),
    "LGPL-2.1 header": _FSF.format("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0 header": _FSF.format("program", "Lesser General Public License", "3"),
    "AGPL-3.0 header": _FSF.format("program", "Affero General Public License", "3"),
} | {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def told(words: list[str]) -> set[str]:
    """The words that tell notices apart."""
    return {w for w, after in zip(words, [*words[1:], ""], strict=True)
            if w in TELLING or w.isdigit() or w in GENERAL and after == "general"}


def winnowed(shingles: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints among ``shingles`` (hashes); the largest hash marks none."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    wide = np.concatenate([shingles, np.full(max(0, window - n), np.uint64(2**64 - 1))])
    views = np.lib.stride_tricks.sliding_window_view(wide, window)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    at = at[at < n]
    return at[shingles[at] != np.uint64(2**64 - 1)]


class Templates:
    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, window: int = WINDOW, band: int = BAND, cover: float = MIN_COVER):
        self.shingle, self.window, self.band, self.cover = shingle, window, band, cover
        self.names = list(templates)
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(t.encode().lower())], np.int32)
                      for t in templates.values()]
        self.bands = [max(band, len(w) // 16) for w in self.words]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.told = [told([x.lower() for x in PLACED.findall(t)]) if len(w) < SHORT else None
                     for t, w in zip(templates.values(), self.words, strict=True)]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            h = self.hashes(words)
            for at in winnowed(h, window).tolist():
                self.index.setdefault(int(h[at]), []).append((k, at))
        self.keys = np.array(sorted(self.index), np.uint64)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Hash of each shingle; the largest one where a word is unknown (-1)."""
        n = len(words) - self.shingle + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.shingle):
            w = words[k:k + n]
            known &= w >= 0
            h = (h ^ (w.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return np.where(known, h >> np.uint64(1), np.uint64(2**64 - 1))

    def may_cover(self, words: np.ndarray, k: int, diagonal: int) -> bool:
        """Whether the words around a diagonal, in any order, can cover template ``k``."""
        band = self.bands[k]
        near = words[max(0, diagonal - band):max(0, diagonal + band + len(self.words[k]))]
        kinds, wanted = self.bags[k]
        there = np.bincount(near[near >= 0], minlength=len(self.vocabulary))[kinds]
        return int(np.minimum(there, wanted).sum()) >= self.cover * len(self.words[k])

    def align(self, words: np.ndarray, k: int, diagonal: int) -> tuple[int, int, int, int]:
        """(score, matches, first word, end word) of the best local alignment
        of template ``k`` with ``words`` around a diagonal."""
        t, band = self.words[k], self.bands[k]
        width = 2 * band + 1
        d = np.arange(width)
        score, match = np.zeros(width, np.int64), np.zeros(width, np.int64)
        start = d + diagonal - band
        padded = np.concatenate([np.full(width, -2, np.int32), words, np.full(width, -2, np.int32)])
        best = (0, 0, 0, 0)
        for i, w in enumerate(t.tolist()):
            at = d + (i + diagonal - band)  # word of the text on each diagonal
            if at[0] >= len(words):
                break
            if at[-1] < 0:
                continue
            row = padded[at[0] + width:at[0] + 2 * width]
            same = row == w
            live = score > 0
            new = np.where(live, score, 0) + np.where(same, 1, -1)
            new_match = np.where(live, match, 0) + same
            new_start = np.where(live, start, at)
            # a template word without a word of the text: from the next diagonal
            skip = np.append(score[1:] - 1, -1)
            take = skip > new
            new, new_match = np.where(take, skip, new), np.where(take, np.append(match[1:], 0), new_match)
            new_start = np.where(take, np.append(start[1:], 0), new_start)
            # words of the text without a template word: from the best diagonal before
            level = new + d
            top = np.maximum.accumulate(level)
            source = np.maximum.accumulate(np.where(level == top, d, 0))
            new, new_match, new_start = top - d, new_match[source], new_start[source]
            score, match, start = np.where(row == -2, 0, np.maximum(new, 0)), new_match, new_start
            high = score.max()
            if high >= best[0]:
                e = int(np.lexsort((start, -match, -score))[0])
                if (int(score[e]), int(match[e])) > best[:2]:
                    best = (int(score[e]), int(match[e]), int(start[e]), int(at[e]) + 1)
        return best

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        get, out = self.vocabulary.get, []
        for text in texts:
            found: list[dict] = []
            words = np.array([get(w, -1) for w in WORD.findall(text.encode().lower())], np.int32) if text else np.empty(0, np.int32)
            h = self.hashes(words)
            if h.size and self.keys.size:
                at = winnowed(h, self.window) if (h != np.uint64(2**64 - 1)).any() else np.empty(0, np.int64)
                hits = [(k, p - q, p) for p in at.tolist() for k, q in self.index.get(int(h[p]), ())]
                if hits:
                    found = self._confirm(text, words, hits)
            out.append(found)
        return out

    def _candidates(self, text: str, places: list[tuple[int, int]], words: np.ndarray, k: int, hits: list[tuple[int, int]]):
        """(score, matches, first word, end word) of the copies of template
        ``k``; ``hits`` are (diagonal, word of the text).  Behind and before a
        copy the search goes on in what is left of the text."""
        open_ = [(hits, 0, len(words))]
        while open_:
            hits, lo, hi = open_.pop()
            while hits:
                first, band = hits[0][0], self.bands[k]
                part, centre = words[lo:hi], first - lo + band // 2
                score, n, a, b = self.align(part, k, centre) if self.may_cover(part, k, centre) else (0, 0, 0, 0)
                a, b = a + lo, b + lo
                if n < self.cover * len(self.words[k]):
                    hits = [h for h in hits if h[0] - first > band]  # the others are within its band
                    continue
                span = [text[x:y].lower() for x, y in places[a:b]] if self.told[k] is not None else []
                if self.told[k] is None or told(span) == self.told[k]:
                    yield score, n, a, b
                open_.append(([h for h in hits if h[1] + self.shingle <= a], lo, a))
                hits, lo = [h for h in hits if h[1] >= b], b

    def _confirm(self, text: str, words: np.ndarray, hits: list[tuple[int, int, int]]) -> list[dict]:
        places = [(m.start(), m.end()) for m in PLACED.finditer(text)]
        of: dict[int, list[tuple[int, int]]] = {}
        for k, diagonal, at in sorted(set(hits)):
            of.setdefault(k, []).append((diagonal, at))
        best = [(-score, -n / len(self.words[k]), k, a, b, n)
                for k, some in of.items() for score, n, a, b in self._candidates(text, places, words, k, some)]
        starts: list[int] = []  # of the kept spans, which don't overlap, in order
        kept: list[tuple[int, int, int, int]] = []
        for _, _, k, a, b, n in sorted(best):
            i = bisect.bisect_left(starts, b)
            if i == 0 or kept[i - 1][1] <= a:
                starts.insert(i, a)
                kept.insert(i, (a, b, k, n))
        return [{"license": self.names[k], "matched": n, "coverage": n / len(self.words[k]), "start": places[a][0], "end": places[b - 1][1]}
                for a, b, k, n in kept]


def _templates(sent: dict) -> Templates:
    return Templates(sent)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``licenses``: array of (license, matched words, coverage of
    the template, start and end of the span in code points)."""
    shared = Shared(docs.sparkSession, TEMPLATES if templates is None else templates)
    row = StructType([StructField("license", StringType()), StructField("matched", LongType()), StructField("coverage", DoubleType()),
                      StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("licenses", ArrayType(row))])

    def make():
        index = shared.build(_templates)
        return lambda texts: [index.scan(texts)]

    done = docs.withColumn("_lic", struct_udf(schema, make)(F.col(text)))
    return without(done, "licenses").select("*", "_lic.licenses").drop("_lic")
