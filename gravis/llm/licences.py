"""Operator 9: license scan by patience alignment.

A text region and a template are aligned on the words unique to both: their
longest increasing subsequence gives anchors, equal words next to an anchor are
taken along, and the gaps between anchors are aligned the same way. Coverage is
the share of template words aligned.

Regions: a window of ``STRETCH`` template lengths can only be covered to
``MIN_COVERAGE`` if that share of it, counted in template words, are words of
the template; every such window of the whole text is aligned (the densest of
each neighbourhood first), so repeated notices do not hide each other's anchors
and no part of a long text is left out.

Templates of different licenses that are much alike are told apart by their own
words: where a template aligns with another license's to at least ``ALIKE`` of its
words, ``MIN_COVERAGE`` of the words left over (one word: that word) must be aligned in
the text too. So a notice without its license's name or version is none, and the
two-clause text is not the three-clause one. A notice of fewer than ``SHORT`` words
must stand in one piece: a word inside it makes it another notice.

Defined results: null or empty text has no license (coverage 0); of equally
covered templates the longer wins, then the smaller name; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gravis.llm.common import table
from gravis.llm.registry import register

MIN_COVERAGE = 0.8
STRETCH = 1.5
ALIKE = 0.5
SHORT = 12

_GPL = ("This {it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_CC = "Licensed under CC BY{more} 4.0."

# Notices, headers and short whole texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause-text": _BSD.format(third=""),
    "BSD-3-Clause-text": _BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used "
                                           "to endorse or promote products derived from this software without specific prior "
                                           "written permission. "),
    "CC-BY-4.0": _CC.format(more=""),
    "CC-BY-NC-4.0": _CC.format(more="-NC"),
    "CC-BY-NC-ND-4.0": _CC.format(more="-NC-ND"),
    "CC-BY-NC-SA-4.0": _CC.format(more="-NC-SA"),
    "CC-BY-ND-4.0": _CC.format(more="-ND"),
    "CC-BY-SA-4.0": _CC.format(more="-SA"),
    "AGPL-3.0-header": _GPL.format(it="program", name="Affero General Public License", version=3),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GPL.format(it="program", name="General Public License", version=2),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GPL.format(it="program", name="General Public License", version=3),
    "ISC": "Released under the ISC License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": _GPL.format(it="library", name="Lesser General Public License", version=2.1),
    "LGPL-3.0-header": _GPL.format(it="library", name="Lesser General Public License", version=3),
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-text-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                      "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                      "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                      "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                      "following conditions: The above copyright notice and this permission notice shall be included in all "
                      "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
                      "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
                      "PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                      "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                      "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                      "binary, for any purpose, commercial or non-commercial, and by any means.",
}
_PART = re.compile(r"-(header|text|text-whole)$")  # of one license
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[p], top_at[p] = v, i
        back[i] = top_at[p - 1] if p else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text, template) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        n_text, n_temp = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if n_text[w] == 1}
        both = [(j, place[w]) for j, w in enumerate(template[c:d], c) if n_temp[w] == 1 and w in place]
        if not both:
            continue
        anchors = [both[i] for i in increasing([x for _, x in both])]
        left_t, left_c = a, c
        for j, i in anchors:
            todo.append((left_t, i, left_c, j))
            out.append((i, j))
            left_t, left_c = i + 1, j + 1
        todo.append((left_t, b, left_c, d))
    return sorted(out)


class LicenseScanner:
    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, stretch: float = STRETCH):
        self.names = list(templates)
        self.vocab: dict[str, int] = {}
        self.templates = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)] for t in templates.values()]
        self.min_coverage, self.stretch = min_coverage, stretch
        self.member = np.zeros((len(self.templates), len(self.vocab) + 1), bool)  # the last slot: any other word
        for t, ids in enumerate(self.templates):
            self.member[t, ids] = True
        self.counts = [Counter(t) for t in self.templates]
        self.own = [self._own_words(t) for t in range(len(self.templates))]

    def _own_words(self, t: int) -> list[set[int]]:
        """Per template of another license that is much alike: the places of t's words it lacks."""
        mine, out = self.templates[t], []
        for u, other in enumerate(self.templates):
            if mine and _PART.sub("", self.names[u]) != _PART.sub("", self.names[t]):
                left = set(range(len(mine))) - {j for _, j in align(other, mine)}
                if left and len(mine) - len(left) >= ALIKE * len(mine):
                    out.append(left)
        return out

    def holds(self, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether an alignment covers the template, in one piece if it is short, and
        the words that tell it from other licenses."""
        if len(pairs) < self.min_coverage * len(self.templates[t]):
            return False
        if len(self.templates[t]) < SHORT and pairs[-1][0] - pairs[0][0] + 1 > len(pairs):
            return False
        got = {j for _, j in pairs}
        return all(len(left & got) >= self.min_coverage * len(left) for left in self.own[t])

    def scan(self, text: str) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Number of words, and (license, coverage, first word, last word) of
        every covered region, best first."""
        words = words_of(text)
        other = len(self.vocab)
        get = self.vocab.get
        ids = [get(w, other) for w in words]
        have = Counter(ids)
        found = []
        for t, template in enumerate(self.templates):
            need = self.min_coverage * len(template)
            if not template or sum(min(n, have[w]) for w, n in self.counts[t].items() if w in have) < need:
                continue  # too few of its words anywhere
            width = max(int(self.stretch * len(template)), len(template))
            flags = self.member[t, np.array(ids)]
            total = np.concatenate([[0], np.cumsum(flags)])
            ends = np.minimum(np.arange(len(ids)) + width, len(ids))
            dense = total[ends] - total[:-1]
            starts = np.flatnonzero((dense >= need) & flags)  # a region may as well begin with a template word
            at = 0
            while at < len(starts):
                near = starts[at:np.searchsorted(starts, starts[at] + len(template))]
                best = None
                for s in near[np.argsort(-dense[near], kind="stable")][:len(template)]:
                    pairs = align(ids[s:s + width], template)
                    holds = self.holds(t, pairs)
                    if best is None or (holds, len(pairs)) > (best[0], len(best[2])):
                        best = holds, int(s), pairs
                    if holds and len(pairs) == len(template):
                        break
                holds, s, pairs = best
                if holds:
                    first, last = s + pairs[0][0], s + pairs[-1][0]
                    found.append((self.names[t], len(pairs) / len(template), first, last))
                    at = int(np.searchsorted(starts, last + 1))
                else:
                    at += len(near)
        size = dict(zip(self.names, map(len, self.templates)))
        kept: list[tuple[str, float, int, int]] = []  # of overlapping regions the best stays
        for f in sorted(found, key=lambda f: (-f[1], -size[f[0]], f[0], f[2])):
            if all(f[3] < k[2] or k[3] < f[2] for k in kept):
                kept.append(f)
        return len(words), kept


def scan_licenses(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, license (best or null), coverage, first_word,
    last_word, n_regions, regions (license:first:last in order of place)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = LicenseScanner(templates)
        for pdf in batches:
            rows = []
            for text in pdf["_text"]:
                n, found = scanner.scan(text) if isinstance(text, str) else (0, [])
                b = found[0] if found else None
                listed = ",".join(f"{k}:{i}:{j}" for k, _, i, j in sorted(found, key=lambda f: (f[2], f[3], f[0])))
                rows.append((n, b[0], b[1], b[2], b[3], len(found), listed) if b else (n, None, 0.0, None, None, 0, ""))
            out = pd.DataFrame(rows, columns=["n_words", "license", "coverage", "first_word", "last_word", "n_regions", "regions"])
            out = out.astype({"first_word": "Int64", "last_word": "Int64"})
            yield pd.concat([pdf[["_id"]].reset_index(drop=True), out], axis=1)
    return df.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInPandas(
        run, f"_id {kind}, n_words long, license string, coverage double, first_word long, last_word long, "
             "n_regions int, regions string").withColumnRenamed("_id", id_col)


@register("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
