"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans.

The word pairs of each template are hashed and winnowed: of each window of
consecutive hashes the smallest is kept. Any run of ``GRAM + WINDOW - 1`` template words
found in a text holds a kept pair, so looking all pairs of the text up in the
inverted index finds it. Hits near one diagonal are a candidate; there, template and text are
aligned inside a band, and the alignment's coverage and span are reported.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.stores import prepare

GRAM, WINDOW = 2, 2
WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id bigint, license string, start bigint, end bigint, coverage double, matched_words int, template_words int"

# Words that tell licenses apart: a passage has all those of its template, as well as its version's
# digits, and of VARIANTS no others
VARIANTS = {"lesser", "affero", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives"}
NAMES = VARIANTS | {"apache", "mit", "mozilla", "gnu", "cc", "creative", "attribution"}

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS {0}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General "
           "Public License as published by the Free Software Foundation")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Notices as their licenses prescribe them, and licenses of up to some 200 words.
_FIRST: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *_FIRST,
    *((name, f"This work is licensed under the GNU {kind}General Public License, version {version}.") for name, kind, version in (
        ("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    ("LGPL-header", _HEADER.format("Lesser")),
    ("AGPL-header", _HEADER.format("Affero")),
    *((f"CC-{k}-{v}-short", f"Licensed under CC {k} {v}.") for k in _CC for v in ("4.0", "3.0") if (k, v) != ("BY-NC", "4.0")),
    *((f"CC-{k}-{v}" if (k, v) != ("BY-NC", "4.0") else f"CC-{k}-{v}-notice",
       f"This work is licensed under a Creative Commons {name} {v} {kind} License.")
      for k, name in _CC.items() for v, kind in (("4.0", "International"), ("3.0", "Unported")) if (k, v) != ("BY", "4.0")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT-full", _FIRST[3][1] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
     "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. " + _AS_IS.format("OR COPYRIGHT HOLDERS ")),
    ("ISC-full", _FIRST[4][1] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
     "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
     "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission. ")),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("warranty-disclaimer", _AS_IS.format("OR COPYRIGHT HOLDERS ")),
)


def _hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first.astype("u8") << np.uint64(32) | second.astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the last smallest of each window of consecutive hashes."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(template: Sequence[int], text: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Longest common subsequence of ``template`` and ``text`` within ``band`` of the diagonal ``shift``.

    Returns the matched (template, text) positions. Among equally long ones the
    path with the fewest steps aside is taken, from the end.
    """
    width = 2 * band + 1
    best = np.zeros((len(template) + 1, width + 1), int)  # column c: text position i + shift + c - band
    for i in range(len(template) - 1, -1, -1):
        for c in range(width - 1, -1, -1):
            at = i + shift + c - band
            down = best[i + 1, c - 1] if c else 0          # skip a template word
            score = max(down, best[i, c + 1] if c + 1 < width else 0)  # or skip a text word
            if 0 <= at < len(text) and text[at] == template[i]:
                score = max(score, best[i + 1, c] + 1)
            best[i, c] = score
    i, c, out = 0, int(np.argmax(best[0, :width] - np.abs(np.arange(width) - band) / (4 * width))), []
    while i < len(template) and c < width and best[i, c]:
        at = i + shift + c - band
        if 0 <= at < len(text) and text[at] == template[i] and best[i, c] == best[i + 1, c] + 1:
            out.append((i, at))
            i += 1
        elif c and best[i, c] == best[i + 1, c - 1]:
            i, c = i + 1, c - 1
        elif c + 1 < width and best[i, c] == best[i, c + 1]:
            c += 1
        else:
            break
    return out


def _best(found: list[tuple]) -> list[tuple]:
    """Of overlapping passages those that match most words, then cover most of their template."""
    starts: list[int] = []
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[4], -f[3], f[2] - f[1], f[0], f[1])):
        at = bisect(starts, f[2])
        if not at or kept[at - 1][2] < f[1]:
            starts.insert(at, f[1])
            kept.insert(at, f)
    return kept


class Scanner:
    """The inverted index of a set of templates, and the scan of one text."""

    def __init__(self, templates: Sequence[tuple[str, str]], coverage: float, band: int):
        self.coverage, self.band = coverage, band
        self.names = [n for n, _ in templates]
        words = [WORD.findall(t.lower()) for _, t in templates]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.templates = [np.array([self.vocabulary[w] for w in t]) for t in words]
        names = {self.vocabulary[w] for w in NAMES if w in self.vocabulary}
        self.variants = {self.vocabulary[w] for w in VARIANTS if w in self.vocabulary}
        digits = {i for w, i in self.vocabulary.items() if w.isdigit() and int(w)}
        # of licenses with numbered paragraphs digits are no version
        self.needed = [{w for w in t.tolist() if w in names or (len(t) <= 40 and w in digits)} for t in self.templates]
        rows, self.least = [], []
        for number, t in enumerate(self.templates):
            hashes = _hash(t[:-1], t[1:])
            kept = winnow(hashes)
            # what a text must hit: a share of the pairs that grows with what the coverage asks for
            self.least.append(max(1, ceil(len(kept) * max(0.0, 2 * coverage - 1) / 2)))
            rows += [(int(hashes[q]), number, int(q)) for q in kept]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], "u8")
        self.entries = [r[1:] for r in rows]

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, int]]:
        """(license, start, end, coverage, matched words, template words) of each passage found."""
        low = text.lower()
        ids = np.array([self.vocabulary.get(w, 0) for w in WORD.findall(low)], "i8")
        pair = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if not len(pair):
            return []
        hashes = _hash(ids[pair], ids[pair + 1])
        left, right = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        hits: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(right > left):
            for number, q in self.entries[left[k]:right[k]]:
                hits.setdefault(number, []).append((int(pair[k]), q))
        found = []
        for number, places in hits.items():
            found += self._passages(number, places, ids)
        if not found:
            return []
        found = _best(found)
        spans = [m.span() for m in WORD.finditer(low)]
        if len(low) == len(text):
            return sorted((n, spans[a][0], spans[b][1], c, k, size) for n, a, b, c, k, size in found)
        lengths = np.cumsum([0] + [len(c.lower()) for c in text])  # lower case may be longer
        back = lambda at: int(np.searchsorted(lengths, at, side="right")) - 1
        return sorted((n, back(spans[a][0]), back(spans[b][1] - 1) + 1, c, k, size) for n, a, b, c, k, size in found)

    def _passages(self, number: int, places: list[tuple[int, int]], ids: np.ndarray) -> list[tuple]:
        template, out, used = self.templates[number], [], -1
        # chains of hits that one alignment can hold: both positions rise, near one diagonal
        chains: list[list[tuple[int, int]]] = []
        open_: list[list[tuple[int, int]]] = []
        for p, q in sorted(places):
            open_ = [c for c in open_ if p - c[0][0] <= len(template) + self.band]
            fits = [c for c in open_ if q > c[-1][1] and p > c[-1][0]
                    and abs((p - q) - (c[0][0] - c[0][1])) <= self.band]
            if fits:
                max(fits, key=lambda c: c[-1][0]).append((p, q))
            else:
                open_.append([(p, q)])
                chains.append(open_[-1])
        shifts = [int(np.median([p - q for p, q in c])) for c in chains if len(c) >= self.least[number]]
        needed = self.needed[number]
        for shift in shifts:
            if not needed <= set(ids[max(0, shift - self.band):shift + len(template) + self.band].tolist()):
                continue
            match = align(template.tolist(), ids, shift, self.band)
            if len(match) >= self.coverage * len(template) and match[0][1] > used:
                if not needed <= {int(template[i]) for i, _ in match}:
                    continue
                inside = ids[match[0][1]:match[-1][1] + 1]
                if any(int(w) in self.variants and int(w) not in needed for w in inside):
                    continue
                out.append((self.names[number], match[0][1], match[-1][1], len(match) / len(template), len(match),
                            len(template)))
                used = match[-1][1]
        return out


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = 0.75,
                  band: int = 8) -> DataFrame:
    """One row per passage of ``docs`` that covers at least ``coverage`` of a template's words.

    ``license``, ``start`` and ``end`` (characters of the text), ``coverage``,
    ``matched_words``, ``template_words``. Words are compared without case and
    punctuation; up to ``band`` words may be inserted or left out before the
    alignment leaves its diagonal. Words of NAMES and versions must match. Of overlapping
    passages the one that matches most words is reported. The list of templates goes to every task. Null and empty texts
    have no rows; repeated rows each have theirs; a null id stays null. Whole texts
    are read, of any length. Columns other than ``doc_id`` and ``text`` are not.
    """
    prepare(docs.sparkSession)
    scanner = Scanner([t for t in templates if len(WORD.findall(t[1])) >= GRAM], coverage, band)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, *f) for doc, text in batch[["doc_id", "text"]].itertuples(index=False) for f in scanner.scan(text)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, FOUND)
