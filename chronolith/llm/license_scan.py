"""License scans with a generalised suffix automaton of license tokens.

All templates go into one suffix automaton over words. A file streams through it
once: after each word the state and length say the longest stretch of any template
that ends there (matching statistics), in constant amortised time a word. Base
phrases are templates too; a phrase ends at a word if its state is on the suffix
chain and the length reaches it, which each state knows beforehand. Long maximal
matches are chained, in template order and with small gaps, into spans; a span that
covers enough of its template gives the template's label. A match that runs on past
the end of a template, into another one, counts for the template that ends there too.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .media import _pieces

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licenses, by label; several notices may share a label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MIN_MATCH = 4
MAX_GAP = 5
MIN_SHARE = 0.6


def words_of(text: str) -> list[str]:
    """Runs of digits, letters a-z and non-ASCII characters, after A-Z are lower-cased."""
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


class SuffixAutomaton:
    """A generalised suffix automaton of word lists, with the templates' positions and phrases at its states."""

    def __init__(self, templates: list[list[str]], phrases: list[list[str]]):
        self.templates, self.phrases = templates, phrases
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*templates, *phrases] for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (template, end) of a state's strings
        for k, t in enumerate([*templates, *phrases]):
            last = 0
            for end, w in enumerate(t, 1):
                last = self._extend(last, self.words[w])
                if k < len(templates):
                    self.places[last].append((k, end))
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]
        self.places[0] = []
        own: dict[int, list[tuple[int, int]]] = {}
        for p, t in enumerate(phrases):
            s = 0
            for w in t:
                s = self.next[s][self.words[w]]
            own.setdefault(s, []).append((p, len(t)))
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.size]  # (phrase, length) on the suffix chain
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.ending[s] = own.get(s, []) + self.ending[self.link[s]]
        self.closing: list[dict[int, int]] = [{} for _ in self.size]  # template that ends here -> longest of its ends on the suffix chain
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            here = {k: self.size[s] for k, end in self.places[s] if end == len(templates[k])}
            self.closing[s] = {k: n for k, n in (self.closing[self.link[s]] | here).items() if n >= MIN_MATCH}

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the string is there already, from another template
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, size: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.size.append(size)
        self.link.append(link)
        self.places.append([])
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[str], ends: list[tuple[int, int, int]] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases (phrase, first word), and the maximal matches of MIN_MATCH words at least (end, length, state).

        `ends` gets what stands before each end of a template, maximal or not (end, length, template).
        """
        arcs, link, size, ending, closing, known = self.next, self.link, self.size, self.ending, self.closing, self.words.get
        found, matches = [], []
        s = n = 0
        for at, word in enumerate(words):
            w = known(word)
            if w is None:
                if n >= MIN_MATCH:
                    matches.append((at, n, s))
                s = n = 0
                continue
            t = arcs[s].get(w)
            if t is None:
                if n >= MIN_MATCH:
                    matches.append((at, n, s))
                while s and t is None:
                    s = link[s]
                    t = arcs[s].get(w)
                n = size[s]
                if t is None:
                    s = n = 0
                    continue
            s, n = t, n + 1
            if ending[s]:
                found += [(p, at + 1 - m) for p, m in ending[s] if n >= m]
            if ends is not None and n >= MIN_MATCH and closing[s]:
                ends += [(at + 1, min(n, m), k) for k, m in closing[s].items()]
        if n >= MIN_MATCH:
            matches.append((len(words), n, s))
        return found, matches

    def spans(self, matches: list[tuple[int, int, int]], ends: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, covered words) of chains: matches in template order with gaps of MAX_GAP words at most.

        With `ends`, also the chains of a template with its ends in them, where no chain without them covers as much.
        """
        places = [(end, n, self.places[state]) for end, n, state in matches]
        out = self._chains(places)
        if ends:
            closed = {k for _, _, k in ends}
            own = [(end, n, [x for x in p if x[0] in closed]) for end, n, p in places]
            own += [(end, n, [(k, len(self.templates[k]))]) for end, n, k in ends]
            known: dict[int, list[tuple[int, int, int]]] = {}
            for k, *x in out:
                known.setdefault(k, []).append(tuple(x))
            for k, *x in set(self._chains(sorted(own, key=lambda x: x[0]))).difference(out):  # at one end, the maximal match is first
                i, j, c = x
                if not any(a < j and i < b and m >= c for a, b, m in known.get(k, ())):
                    known[k] = [y for y in known.get(k, ()) if not (i <= y[0] and y[1] <= j)] + [(i, j, c)]
            out = sorted((k, *x) for k, xs in known.items() for x in xs)
        return out

    @staticmethod
    def _chains(matches: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int]]:
        open_: dict[int, list[int]] = {}  # template -> first, end, covered, end in template
        out = []
        for end, n, places in matches:
            options: dict[int, list[int]] = {}
            for k, t_end in places:
                options.setdefault(k, []).append(t_end)
            for k, t_ends in options.items():
                c = open_.get(k)
                if c:
                    fits = [t for t in t_ends if 0 <= t - n - c[3] <= MAX_GAP] if 0 <= end - n - c[1] <= MAX_GAP else []
                    if fits:
                        c[1], c[2], c[3] = end, c[2] + n, min(fits)
                        continue
                    if end - n < c[1] and n <= c[2]:
                        continue  # overlaps the open chain and is no longer
                    out.append((k, *c[:3]))
                open_[k] = [end - n, end, n, min(t_ends)]
        return out + [(k, *c[:3]) for k, c in open_.items()]


_built: dict[tuple, SuffixAutomaton] = {}


def automaton(templates, base) -> SuffixAutomaton:
    key = (tuple(templates), tuple(base))
    if key not in _built:
        _built[key] = SuffixAutomaton([words_of(t) for _, t in templates], [words_of(p) for p in base])
    return _built[key]


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, base=None, min_share: float = MIN_SHARE) -> DataFrame:
    """`df` (without `text`) with n_words long, base array<struct<label,start>>, spans array<struct<label,start,end,covered,share>>.

    base: every place where a base phrase's words stand consecutively. spans: chained
    matches that cover at least `min_share` of a template. Null or empty text: no
    words, empty arrays. Other columns pass through.
    """
    base = BASE if base is None else base
    names, phrases, labels = list(base), list(base.values()), [k for k, _ in templates]
    inner = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "base", "spans")))
    out = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields if x.name != text), "n_words long, base array<struct<label:string,start:bigint>>, spans array<struct<label:string,start:bigint,end:bigint,covered:bigint,share:double>>"])
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        a = automaton(templates, names)
        for b in _pieces(batches, 512):
            n, places, spans = [], [], []
            for x in b.column(text).to_pylist():
                words = words_of(x or "")
                ends: list[tuple[int, int, int]] = []
                found, matches = a.stream(words, ends)
                n.append(len(words))
                places.append([{"label": phrases[p], "start": i} for p, i in found])
                chains = ((labels[k], i, j, c, c / len(a.templates[k])) for k, i, j, c in a.spans(matches, ends))
                spans.append([dict(zip(("label", "start", "end", "covered", "share"), c, strict=True)) for c in chains if c[4] >= min_share])
            kept = [c for c in b.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(places, base_type), pa.array(spans, span_type)], [*kept, "n_words", "base", "spans"])

    return inner.mapInArrow(run, out)
