"""Licence scans: matching statistics against a generalised suffix automaton of licence texts, chained into covered spans.

The templates (licence texts, notices of one line, base phrases) are sequences of words. One suffix automaton of all of them has
at most two states a word; a state stands for the word strings that end at the same places of the templates. A text's words
run through it once: after each word the automaton's state and a length say which is the longest string of words, ending here, that any
template has. That takes time in proportion to the text, and memory that doesn't grow with it, as texts are read in pieces.

A base phrase stands where the phrase's own state lies on the way of suffix links from the current state, with the current length no
less than the phrase's. Where the longest string can't be carried on, a match ends. Matches of ``LONG`` words or more (or of a whole
template that is shorter) are kept with the places where templates have them. For each template, matches that follow one
another in the text and in the template, at most ``GAP`` words apart in the text, form chains; the chain that covers the most words of the
template is its span, and the covered share its score. A template with a share of ``COVERED`` or more labels the text.

A document's score is the largest share of any template. Base phrases label a text by themselves and have no part in the score.

Defined results: a null or empty text has no words, no labels ('') and a score of 0; repeated rows are documents of their own; a
null id stays null; very long texts are scanned whole; of spans that cover as much, the one that ends first counts; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import pieces

#: Words of a text in UTF-8 after A-Z have been lower-cased: letters, digits and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a match that counts, words of a text between two matches of a chain, and the share of a template that labels a text.
LONG, GAP, COVERED = 6, 40, 0.6

#: Phrases that label a text wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence texts, standard headers and notices of one line, by the label that they give.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
    to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
    to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
    express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
    the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
    program. If not, see <https://www.gnu.org/licenses/>."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
    ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
    WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
    this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
    means."""),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclass
class Automaton:
    """A generalised suffix automaton. State 0 is the empty string; ``longest`` has the length of each state's longest string,
    ``ends`` the (sequence, place behind) where its strings end."""

    following: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])

    def _state(self, longest: int, following: dict, link: int) -> int:
        self.following.append(following)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.link) - 1

    def _divided(self, p: int, word) -> int:
        """The state of p's longest string and ``word``, which gets a state of its own where it shares one with longer strings."""
        q = self.following[p][word]
        if self.longest[q] == self.longest[p] + 1:
            return q
        own = self._state(self.longest[p] + 1, dict(self.following[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.following[p].get(word) == q:
            self.following[p][word] = own
            p = self.link[p]
        return own

    def _extended(self, last: int, word) -> int:
        if word in self.following[last]:  # an earlier sequence has this string
            return self._divided(last, word)
        new, p = self._state(self.longest[last] + 1, {}, 0), last
        while p >= 0 and word not in self.following[p]:
            self.following[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._divided(p, word)
        return new

    def add(self, number: int, sequence: list) -> None:
        last = 0
        for word in sequence:
            last = self._extended(last, word)
        at = 0  # states may have been divided meanwhile, so ends are noted on a second walk
        for place, word in enumerate(sequence, 1):
            at = self.following[at][word]
            self.ends[at].add((number, place))

    def finish(self) -> None:
        """Hands the places of each state to the states of its suffixes."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]


@dataclass
class Match:
    """Words ``start`` to ``end`` (behind) of a text, which templates have at ``places`` (sequence, place behind)."""

    start: int
    end: int
    places: tuple


class Scanner:
    """Templates and phrases as one automaton, and the scan of a text."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None):
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.labels, self.lengths = [label for label, _ in templates], []
        self.automaton = Automaton()
        for number, (_, text) in enumerate(templates):
            self.lengths.append(len(words_of(text)))
            self.automaton.add(number, words_of(text))
        split = [(words_of(phrase), label) for phrase, label in phrases.items()]
        for number, (ws, _) in enumerate(split, len(templates)):
            self.automaton.add(number, ws)
        self.automaton.finish()
        self._mark([(ws, label) for ws, label in split if ws])
        # places where matches count, and the least length that does: LONG words, or a whole template that is shorter
        self.places = [tuple(sorted((n, e) for n, e in ends if n < len(templates))) for ends in self.automaton.ends]
        self.least = [min((min(LONG, self.lengths[n]) for n, _ in p), default=1 << 60) for p in self.places]

    def _mark(self, phrases: list[tuple[list[bytes], str]]) -> None:
        """For each state, the (length, label) of phrases that end where its strings do; shorter matches of a state have fewer."""
        self.phrases: list[tuple] = [()] * len(self.automaton.link)
        own: dict[int, list] = {}
        for ws, label in phrases:
            state = 0
            for word in ws:
                state = self.automaton.following[state][word]
            own.setdefault(state, []).append((len(ws), label))
        for state in sorted(range(1, len(self.automaton.link)), key=lambda s: self.automaton.longest[s]):
            self.phrases[state] = (*self.phrases[max(0, self.automaton.link[state])], *own.get(state, ()))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[Match]]:
        """(number of words, base places as (start, label), matches that count) of a text."""
        following, link, longest, phrases, least = self.automaton.following, self.automaton.link, self.automaton.longest, self.phrases, self.least
        first = following[0].get
        state, length, n, base, matches = 0, 0, 0, [], []
        for piece in pieces(text):
            ws = WORD.findall(piece.lower())
            for k, known in enumerate(map(first, ws), n):
                if known is None:  # no template has this word
                    if state:
                        if length >= least[state]:
                            matches.append(Match(k - length, k, self.places[state]))
                        state = length = 0
                    continue
                word = ws[k - n]
                after = following[state].get(word)
                if after is None:
                    if length >= least[state]:
                        matches.append(Match(k - length, k, self.places[state]))
                    while after is None:
                        state = link[state]
                        length, after = longest[state], following[state].get(word)
                state, length = after, length + 1
                if phrases[state]:
                    base += [(k + 1 - size, label) for size, label in phrases[state] if size <= length]
            n += len(ws)
        if state and length >= least[state]:
            matches.append(Match(n - length, n, self.places[state]))
        return n, base, matches

    def spans(self, matches: list[Match]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, covered words) of the best chain of each template that matches."""
        chains: dict[int, list[tuple]] = {}  # of a template: (end, template's end, covered, start), ends ascending
        for m in matches:
            size = m.end - m.start
            for number, place in m.places:
                if size < min(LONG, self.lengths[number]):
                    continue
                own, covered, start = chains.setdefault(number, []), size, m.start
                for end, before, sum_, begin in reversed(own):
                    if m.start - end > GAP:
                        break
                    if end <= m.start and before <= place - size and sum_ + size > covered:
                        covered, start = sum_ + size, begin
                own.append((m.end, place, covered, start))
        out = []
        for number, own in sorted(chains.items()):
            end, _, covered, start = max(own, key=lambda c: (c[2], -c[0]))
            out.append((number, start, end, covered))
        return out

    def judge(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and spans as (label, start, end, share) of a text."""
        n, base, matches = self.scan(text)
        spans = [(self.labels[k], start, end, covered / self.lengths[k]) for k, start, end, covered in self.spans(matches)]
        found = {label for _, label in base}
        starts = [at for at, _ in base]
        labels = found | {label for label, *_, share in spans if share >= COVERED}
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), max((s[3] for s in spans), default=0.0), spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), _SPAN]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = list(zip(*(scanner.judge(text.as_py() or b"") for text in part.column(1)), strict=True))
                told[7] = [[dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans] for spans in told[7]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(told, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
