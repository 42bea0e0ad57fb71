"""Licence scans: matching statistics of texts against licence templates, chained into covered spans."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that always count, and the public licence notices looked for besides.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    (
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    ),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
    ),
    (
        "public-domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software""",
    ),
    (
        "warranty",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ),
]

#: Words in a match that may join a chain.
LEAST = 5

#: Words of the text between two matches of one chain.
GAP = 32

#: A template is found where a chain covers this share of its words.
COVERED = 0.8

#: Bytes of a text split into words at a time.
PIECE = 1 << 16

_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_SPELLED = bytes(
    lower if (lower := b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256)
)


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, as UTF-8, some at a time.

    A to Z are lower-cased; words are runs of 0 to 9, a to z and characters
    beyond ASCII.
    """
    data = text.encode("utf-8", "surrogatepass").translate(_SPELLED)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class Automaton:
    """A generalised suffix automaton: every run of words that stands in one of ``sequences`` is a path from state 0."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, place) a state's runs end at
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extended(last, symbol)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])

    def _new(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state of runs of ``target`` no longer than one more than ``state``'s: itself, or a part cut off."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._new(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = part
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = part
            state = self.link[state]
        return part

    def _extended(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # an earlier sequence has this run
            return self._split(last, symbol, self.next[last][symbol])
        fresh = self._new({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(state, symbol, self.next[state][symbol])
        return fresh

    def statistics(self, symbols: Iterator[int]) -> Iterator[tuple[int, int]]:
        """After each symbol: the state and the length of the longest run that ends there."""
        following, link, length = self.next, self.link, self.length
        state = run = 0
        for symbol in symbols:
            target = following[state].get(symbol)
            while target is None and state:
                state = link[state]
                run = length[state]
                target = following[state].get(symbol)
            if target is not None:
                state, run = target, run + 1
            yield state, run


class Match(NamedTuple):
    """Words ``start`` to ``end`` of a text, both included, that stand in a template from ``place`` on."""

    template: int
    start: int
    end: int
    place: int


class Span(NamedTuple):
    label: str
    first: int
    last: int
    covered: int
    length: int


class Scanner:
    """Phrases and templates compiled for scanning; small, made once in each task."""

    def __init__(self, phrases: Mapping[str, str], templates: list[tuple[str, str]]):
        spelled = [[w for piece in words_of(t) for w in piece] for t in [*phrases.values(), *[t for _, t in templates]]]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in spelled]
        self.labels = [*phrases, *[label for label, _ in templates]]
        self.n_phrases = len(phrases)
        self.automaton = auto = Automaton(self.sequences)
        self.least = min([LEAST, *[len(s) for s in self.sequences[self.n_phrases :]]])
        # by state: phrases that end there, and the templates its runs stand in, with the longest run of each
        self.phrases: list[list[int]] = [[] for _ in auto.next]
        self.places: list[dict[int, tuple[int, list[int]]]] = [{} for _ in auto.next]
        for state in sorted(range(1, len(auto.next)), key=auto.length.__getitem__):
            above = auto.link[state]
            self.phrases[state] = list(self.phrases[above])
            own: dict[int, list[int]] = {}
            for number, place in auto.ends[state]:
                size = len(self.sequences[number])
                if number < self.n_phrases:
                    if place == size - 1 and auto.length[above] < size <= auto.length[state]:
                        self.phrases[state].append(number)
                else:
                    own.setdefault(number, []).append(place)
            self.places[state] = {
                **self.places[above],
                **{t: (auto.length[state], sorted(at)) for t, at in own.items()},
            }

    def scan(self, text: str) -> tuple[int, dict[int, list[int]], list[Span], float]:
        """Number of words; for each phrase found how often, its first and its last start; spans; best coverage."""
        found: dict[int, list[int]] = {}
        matches: list[Match] = []
        running: dict[int, tuple[int, list[int]]] = {}  # template: longest run that ends at the word before, its places
        n = 0
        get, phrases, least = self.vocabulary.get, self.phrases, self.least
        symbols = (get(w, -1) for piece in words_of(text) for w in piece)
        for n, (state, run) in enumerate(self.automaton.statistics(symbols), 1):
            if phrases[state]:
                for number in phrases[state]:
                    size = len(self.sequences[number])
                    if size <= run:
                        entry = found.setdefault(number, [0, n - size, n - size])
                        entry[0] += 1
                        entry[2] = n - size
            if running or run >= least:
                now = {t: (min(run, size), at) for t, (size, at) in self.places[state].items()} if run >= least else {}
                now = {t: (size, at) for t, (size, at) in now.items() if size >= min(LEAST, len(self.sequences[t]))}
                matches += self._ended(running, now, n - 2)
                running = now
        matches += self._ended(running, {}, n - 1)
        spans, best = self._chained(matches)
        return n, found, spans, 1.0 if found else best

    def _ended(self, before: dict, now: dict, end: int) -> Iterator[Match]:
        """Runs that ended at word ``end`` and don't go on."""
        for template, (size, places) in before.items():
            if now.get(template, (0,))[0] != size + 1:
                for place in places:
                    yield Match(template, end - size + 1, end, place - size + 1)

    def _chained(self, matches: list[Match]) -> tuple[list[Span], float]:
        """Spans of a text that cover a template, and the best coverage of any chain.

        A chain takes matches of one template in the order of both text and
        template, GAP words of the text apart at most; where two overlap, the
        later one adds what is beyond the earlier.  Of overlapping chains of a
        template the one that covers more stays, of equal ones the first.
        """
        by_template: dict[int, list[Match]] = {}
        for match in matches:
            by_template.setdefault(match.template, []).append(match)
        spans, best = [], 0.0
        for template, own in by_template.items():
            length = len(self.sequences[template])
            own.sort(key=lambda m: (m.end, m.place))
            ends = [m.end for m in own]
            covered, origin = [], []
            for i, m in enumerate(own):
                size = m.end - m.start + 1
                gained, start = size, m.start
                for j in range(bisect_left(ends, m.start - GAP - 1), i):
                    b = own[j]
                    tail = b.place + b.end - b.start  # last place the earlier match covers
                    skip = max(0, b.end - m.start + 1, tail - m.place + 1)
                    if skip < size and b.end < m.end and covered[j] + size - skip > gained:
                        gained, start = covered[j] + size - skip, origin[j]
                covered.append(gained)
                origin.append(start)
            best = max(best, max(covered) / length)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(own)), key=lambda i: (-covered[i], own[i].end, own[i].place)):
                if covered[i] < COVERED * length:
                    break
                first, last = origin[i], own[i].end
                at = bisect_left(taken, (first, last))
                if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
                    continue
                insort(taken, (first, last))
                spans.append(Span(self.labels[template], first, last, covered[i], length))
        return sorted(spans, key=lambda s: (s.first, s.last, s.label, -s.covered)), min(1.0, best)


_FOUND = pa.list_(
    pa.struct([("label", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
)
_SPANS = pa.list_(
    pa.struct(
        [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("length", pa.int64())]
    )
)


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES
) -> DataFrame:
    """doc_id, n_words, phrases, spans and score, one row per row of ``docs``; a narrow step without shuffle.

    ``phrases`` has label, number of places, first and last start (words from 0)
    of each phrase found; ``spans`` label, first and last word, words covered
    and words of each template found; ``score`` is 1 where a phrase stands,
    else the best share of a template's words that a chain covers.  Null texts
    are empty ones, without words, labels or score.  Whole texts are streamed
    through the automaton, whose size is that of the phrases and templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            counts, found, spans, scores = [], [], [], []
            for text in batch.column("text"):
                n, hits, covered, score = scanner.scan(text.as_py() or "")
                counts.append(n)
                named = sorted((scanner.labels[k], *v) for k, v in hits.items())
                found.append([dict(zip(("label", "n", "first", "last"), entry)) for entry in named])
                spans.append([span._asdict() for span in covered])
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(found, _FOUND),
                    pa.array(spans, _SPANS),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "n_words", "phrases", "spans", "score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, n_words bigint, phrases array<struct<label: string, n: bigint, first: bigint, last: bigint>>, "
        "spans array<struct<label: string, first: bigint, last: bigint, covered: bigint, length: bigint>>, score double",
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def document_licences(docs: DataFrame) -> DataFrame:
    """Per document: words, places of the fixed phrases, labels of phrases and of covered templates."""
    found = scan(docs)
    total = F.aggregate("phrases.n", F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.last").alias("last_word"),
        _joined(F.col("phrases.label")).alias("base_labels"),
        _joined(F.concat("phrases.label", "spans.label")).alias("labels"),
        "score",
    )
