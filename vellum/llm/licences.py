"""Licence scan with a generalised suffix automaton.

The automaton holds every run of words of every licence template. A text is
streamed through it: the matching statistic at a word is the length of the
longest run ending there that some template holds. Maximal long runs are chained
per template - in text and template order, small gaps allowed - into a covered
span, and a template that is covered well enough gives its label.

Words outside the template vocabulary reset the automaton, and a word that
does not continue a template's word pair starts a run of length 1; both are
found for a whole block of texts with array operations, so the automaton only
walks through text that looks like a licence.

Base phrases are found exactly as stated, at every place.

Nulls: a null text is the empty text, with 0 words, no label and score 0.
Repeated rows are scanned like any others; an empty table gives an empty
result; only the two named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import blocks, key_and_text

#: Phrases that always count, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Passages of public licence texts and of the notices that name them.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "Licensed under the BSD 3-Clause License",
        "Licensed under the BSD 2-Clause License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "licensed under the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        "licensed under the GNU Lesser General Public License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "reserved": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission",
    ],
}
#: A run is long from this many words on; shorter templates must match whole.
MIN_RUN = 4
#: Words that may lie between two chained runs, in the text or in the template.
MAX_GAP = 8
#: Share of a template's words that a span must cover to give the label.
MIN_COVER = 0.5

_OTHER = bytes(c for c in range(128) if not (chr(c).isalnum()))
#: Byte map: lower-cases A-Z and blanks all ASCII but letters and digits; bytes of other characters stay.
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + _OTHER, bytes(range(0x61, 0x7B)) + b" " * len(_OTHER))

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans string")


def fold(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences (each ended by a separator of its own). A state
    knows one place (sequence, end) where its longest run ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for s, seq in enumerate(sequences):
            last = 0
            for end, c in enumerate(seq, 1):
                last = self._extend(last, c)
                self.places[last].append((s, end))
        # a run that ends at a place also ends there with each of its suffixes
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            self.places[self.link[v]].extend(self.places[v])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the run (longest of p) + c, split off from a longer one."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def statistics(self, words: Iterable[int]) -> list[tuple[int, int]]:
        """(state, length) after each word: the longest run ending there."""
        out, state, length = [], 0, 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                state = length = 0
            out.append((state, length))
        return out


class Scanner:
    """Vocabulary, word pairs and automaton of the templates; scans blocks of texts."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self.labels, sequences, self.words = [], [], {}
        for label, texts in templates.items():
            for t in texts:
                self.labels.append(label)
                sequences.append([self.words.setdefault(w, len(self.words) + 1) for w in fold(t.encode())])
        self.base = [([self.words.setdefault(w, len(self.words) + 1) for w in fold(p.encode())], label) for p, label in base.items()]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        n = len(self.words) + 1
        self.pairs = np.zeros((n, n), bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True

    def base_places(self, ids: np.ndarray) -> list[tuple[np.ndarray, str]]:
        found = []
        for phrase, label in self.base:
            n = len(ids) - len(phrase) + 1
            hit = np.ones(max(n, 0), bool)
            for k, w in enumerate(phrase):
                hit &= ids[k:k + n] == w
            found.append((np.flatnonzero(hit), label))
        return found

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the stretches whose neighbouring words are template pairs."""
        near = np.concatenate(([False], self.pairs[ids[:-1], ids[1:]], [False]))
        edges = np.flatnonzero(near[1:] != near[:-1])
        return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2])]

    def spans(self, ids: np.ndarray, lo: int, hi: int) -> list[tuple[str, int, int, float]]:
        """(label, start, end, cover) of the templates covered in one text's words lo..hi."""
        matches: dict[int, list[tuple[int, int, int]]] = {}
        shortest = min(MIN_RUN, min(self.sizes))
        for a, b in self.runs(ids[lo:hi]):
            stats = self.automaton.statistics(ids[lo + a:lo + b].tolist())
            for i, (state, n) in enumerate(stats):
                if n < shortest or (i + 1 < len(stats) and stats[i + 1][1] > n):
                    continue  # not long, or not yet at its full length
                for t, end in set(self.automaton.places[state]):
                    if n >= min(MIN_RUN, self.sizes[t]):
                        matches.setdefault(t, []).append((a + i + 1 - n, end - n, n))
        found = []
        for t, runs in matches.items():
            for start, end, covered in chains(sorted(set(runs))):
                if covered >= MIN_COVER * self.sizes[t]:
                    found.append((self.labels[t], start, end, covered / self.sizes[t]))
        return found

    def scan(self, text: bytes) -> tuple:
        words = fold(text)
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        base = [(int(p), label) for places, label in self.base_places(ids) for p in places]
        spans = self.spans(ids, 0, len(ids)) if len(ids) > 1 else []
        # of spans in the same place, the template it covers best names it
        best: list[tuple[str, int, int, float]] = []  # disjoint, by start
        for s in sorted(spans, key=lambda s: (-s[3] * (s[2] - s[1]), s[1], s[0])):
            k = bisect_left(best, s[1], key=lambda b: b[1])
            if (k == 0 or best[k - 1][2] <= s[1]) and (k == len(best) or best[k][1] >= s[2]):
                best.insert(k, s)
        base_labels = sorted({label for _, label in base})
        score = max([1.0 if base else 0.0, *(min(1.0, c) for *_, c in best)])
        return (len(words), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None),
                ",".join(base_labels), ",".join(sorted({*base_labels, *(s[0] for s in best)})), float(score),
                ",".join(f"{label}:{a}:{b}" for label, a, b, _ in best))


def chains(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (text start, template start, length) of one template, sorted, as
    chains (text start, text end, words covered): each run joins the open chain
    it follows within MAX_GAP words of text and template, else opens one. A chain
    that ends more than MAX_GAP words before a run is closed: none after it joins."""
    open_: list[list[int]] = []  # text start, text end, template end, covered
    closed: list[list[int]] = []
    for a, t, n in runs:
        if any(a - c[1] > MAX_GAP for c in open_):
            closed += [c for c in open_ if a - c[1] > MAX_GAP]
            open_ = [c for c in open_ if a - c[1] <= MAX_GAP]
        for c in open_:
            skip_a, skip_t = a - c[1], t - c[2]
            if -n < skip_a <= MAX_GAP and -n < skip_t <= MAX_GAP:
                new = n + min(0, skip_a, skip_t)
                if new > 0:
                    c[1], c[2], c[3] = a + n, t + n, c[3] + new
                    break
        else:
            open_.append([a, a + n, t + n, n])
    return [(a, b, covered) for a, b, _, covered in closed + open_]


@lru_cache(maxsize=2)
def _scanner(templates: tuple, base: tuple) -> Scanner:
    return Scanner({k: list(v) for k, v in templates}, dict(base))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None,
                  base: dict | None = None) -> DataFrame:
    """One row per document: SCHEMA; spans are label:start:end in words."""
    key = tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items())
    phrases = tuple((BASE_PHRASES if base is None else base).items())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        scanner = _scanner(key, phrases)
        for ids, texts in blocks(batches):
            rows = [(i, *scanner.scan(t)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return key_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
