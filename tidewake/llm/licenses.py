"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A file's tokens are
streamed through it, which gives at each token the length of the longest run
that ends there and stands in some template (matching statistics). Base phrases
are templates too: a phrase ends at a token exactly when its state is on the
suffix-link path of the current state and the current length reaches the
phrase's, so all its places come out of the same scan. Matches of
``MIN_MATCH`` tokens or more are then chained, template by template, in the
order of both file and template into covered spans: every chain that covers
``MIN_COVER`` of its template, as long as none overlaps another of the template,
or else the best one. Such a chain adds the template's label; one that doesn't
hold the template's version adds the label without its version.

Only tokens of the templates' own vocabulary can stand in a match of two or
more, and only pairs that are next to each other in a template; runs of other
tokens leave the automaton at its root and are skipped.

Null and empty texts have no words, no places and empty label strings; an empty
table gives no rows. Repeated rows give a result each. Only the id and text columns
are read. Very long texts are hashed in blocks and their matches chained whole; what
a chain looks back on is bounded by its template's length. Of chains of one template
that overlap, the one of more tokens stays, then that with the version, then the
shorter, then the first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import LETTERS_DIGITS, hash_words, slices, words

MIN_MATCH = 4
MIN_COVER = 0.6

#: The phrases whose every consecutive place is reported, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Grants, notices, conditions and disclaimers of public licences, lower-case words only.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software", "isc"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you should have received a copy of the gnu affero general public license along with this program", "agpl"),
]


def version_place(tokens: list[str], label: str) -> int | None:
    """Where a template of a versioned label holds the version."""
    version = label.rpartition("-")[2]
    return tokens.index(version) if version.isdigit() and version != label and version in tokens else None


class Automaton:
    """Generalised suffix automaton over template tokens."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.templates = [(t.split(), label) for t, label in templates]
        texts = [t for t, _ in self.phrases + self.templates]
        vocabulary = sorted({w for t in texts for w in t})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        hashes = hash_words(vocabulary)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of each state: (template, end) of the places that its runs end at.
        self.ends: list[list[tuple[int, int]]] = [[]]
        coded = [[self.ids[w] for w in t] for t in texts]
        self.pairs = np.zeros((len(vocabulary),) * 2, bool)
        for number, tokens in enumerate(coded):
            self.pairs[tokens[:-1], tokens[1:]] = True
            state = 0
            for end, token in enumerate(tokens, 1):
                state = self._extend(state, token)
                self.ends[state].append((number, end))
        # A state's runs also end wherever those of its link children do.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.phrase_ends: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for number, tokens in enumerate(coded[: len(self.phrases)]):
            state = 0
            for token in tokens:
                state = self.next[state][token]
            self.phrase_ends[state].append((number, len(tokens)))
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrase_ends[state] = self.phrase_ends[state] + self.phrase_ends[self.link[state]]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, token: int) -> int:
        """The state of state's longest run and token, set apart from longer runs."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state != -1 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._split(state, token)
        return new

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Template vocabulary ids of word hashes, -1 for other words."""
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        return np.where(self._hashes[at] == hashes, self._order[at], -1)

    def scan(self, tokens: list[int], start: int):
        """Of one run of tokens: base places (phrase, first word) and maximal matches (state, length, end word)."""
        state = length = 0
        places, matches = [], []
        moves, link, size = self.next, self.link, self.length
        held = None
        for position, token in enumerate(tokens, start):
            before = length
            while state and token not in moves[state]:
                state = link[state]
                length = size[state]
            if token in moves[state]:
                state = moves[state][token]
                length += 1
            if length <= before and held:
                matches.append(held)
            held = (state, length, position) if length >= MIN_MATCH else None
            for number, words_ in self.phrase_ends[state]:
                if words_ <= length:
                    places.append((number, position - words_ + 1))
        if held:
            matches.append(held)
        return places, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """(label, covered part, first word, last word) of each template's chains over MIN_COVER, or of its best."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for state, length, last in matches:
            for number, end in self.ends[state]:
                if number >= len(self.phrases):
                    by_template.setdefault(number, []).append((last - length + 1, end - length, length))
        spans = []
        for number, found in by_template.items():
            tokens, label = self.templates[number - len(self.phrases)]
            place = version_place(tokens, label)
            for total, whole, begin, last in _chains(sorted(found), len(tokens), place):
                spans.append((label if whole else label.rpartition("-")[0], min(1.0, total / len(tokens)), begin, last))
        return spans


def _chained(found: list[tuple[int, int, int]], size: int, place: int | None, taken: list[tuple[int, int]]) -> list[tuple[int, bool, int, int]]:
    """(tokens covered, with the version, first word, last word) of the best chain that ends in each match."""
    reach = 2 * size
    out: list[tuple[int, bool, int, int]] = []
    ends: list[tuple[int, int, int]] = []  # template end, first word of the last match, taken spans before it
    for first, at, length in found:
        gap = bisect_left(taken, (first,))
        whole = place is None or at <= place < at + length
        best = (length, whole, first, first + length - 1)
        for (total, had, begin, end), (template_end, last_first, last_gap) in zip(reversed(out), reversed(ends)):
            if first - last_first > reach + size or last_gap != gap:
                break  # no match is longer than its template
            file_end = end + 1
            overlap = max(0, file_end - first, template_end - at)
            if first + length > file_end and at + length > template_end and first - file_end <= reach and length > overlap:
                best = max(best, (total + length - overlap, had or whole, begin, first + length - 1))
        out.append(best)
        ends.append((at + length, first, gap))
    return out


def _chains(found: list[tuple[int, int, int]], size: int, place: int | None) -> list[tuple[int, bool, int, int]]:
    """Chains over MIN_COVER of one template that don't overlap, best first, or else the best chain."""
    taken: list[tuple[int, int]] = []  # first and last words, in order
    kept: list[tuple[int, bool, int, int]] = []
    while found:
        chains = sorted(set(_chained(found, size, place, taken)), key=lambda c: (-c[0], -c[1], c[3] - c[2], c[2]))
        before = len(kept)
        for chain in chains:
            total, _, begin, last = chain
            if total < MIN_COVER * size:
                break
            i = bisect_left(taken, (begin,))
            if (i == 0 or taken[i - 1][1] < begin) and (i == len(taken) or last < taken[i][0]):
                taken.insert(i, (begin, last))
                kept.append(chain)
        if len(kept) == before:
            return sorted(kept, key=lambda c: c[2]) or chains[:1]
        # What overlaps no kept chain is chained again, between the kept ones.
        left = []
        for match in found:
            i = bisect_left(taken, (match[0] + 1,))
            if (i == 0 or taken[i - 1][1] < match[0]) and (i == len(taken) or match[0] + match[2] - 1 < taken[i][0]):
                left.append(match)
        found = left
    return sorted(kept, key=lambda c: c[2])


RESULT = "n_words long, places array<struct<label:string,first:long>>, spans array<struct<label:string,cover:double,first:long,last:long>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))


def scan_piece(automaton: Automaton, data: np.ndarray, offsets: np.ndarray):
    """Word counts, base places and covered spans of each text of a piece."""
    _, _, hashes, first = words(data, offsets, LETTERS_DIGITS)
    n_texts = len(offsets) - 1
    places: list[list] = [[] for _ in range(n_texts)]
    spans: list[list] = [[] for _ in range(n_texts)]
    code = automaton.code(hashes)
    joined = (code[:-1] >= 0) & (code[1:] >= 0) if len(code) > 1 else np.zeros(0, bool)
    joined &= automaton.pairs[code[:-1], code[1:]] if len(code) > 1 else True
    inner = first[1:-1]
    joined[inner[(inner > 0) & (inner < len(code))] - 1] = False  # runs end with their text
    edges = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
    begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(first, begins, side="right") - 1
    matches: dict[int, list] = {}
    for begin, stop, text in zip(begins.tolist(), stops.tolist(), owner.tolist()):
        if stop - begin < 2:
            continue  # two tokens: shorter than any phrase or match
        got, long = automaton.scan(code[begin : stop + 1].tolist(), begin - int(first[text]))
        places[text] += [{"label": automaton.phrases[n][1], "first": at} for n, at in got]
        if long:
            matches.setdefault(text, []).extend(long)
    for text, found in matches.items():
        spans[text] = [{"label": a, "cover": b, "first": c, "last": d} for a, b, c, d in automaton.chain(found)]
    return np.diff(first), places, spans


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None) -> DataFrame:
    """(id, n_words, places, spans) of every whole text; words count from 0."""
    phrases, templates = phrases or BASE_PHRASES, templates or TEMPLATES
    if any(len(p.split()) < 3 for p, _ in phrases):
        raise ValueError("a phrase needs three words or more")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases, templates)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n, places, spans = scan_piece(automaton, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(spans, _SPANS)],
                    names=[id_col, "n_words", "places", "spans"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")


def digest(scanned: DataFrame, id_col: str = "doc_id", min_cover: float = MIN_COVER) -> DataFrame:
    """Counts, first and last base place, label strings and a score a text."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    good = F.filter("spans", lambda s: s["cover"] >= min_cover)
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.transform(good, lambda s: s["label"]))))
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.first")).alias("first_word"),
        F.array_max(F.col("places.first")).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans.cover")), F.lit(0.0))).alias("score"),
    )
