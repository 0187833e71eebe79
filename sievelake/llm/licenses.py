"""License scans by template markup.

A template is license wording with optional regions, ``<<beginOptional>> ... <<endOptional>>`` (they
may nest), and replaceable ones, ``<<var;name="...";original="...";match="...">>``, as in the SPDX
matching guidelines.  ``match`` is an alternation of wordings (``work|software library``) or ``.+``,
``.*`` or ``.{m,n}``, which stand for so many words; without a bound, for any number of them.  All
templates are compiled into one automaton over words, made deterministic as it is used.  Case, white
space and punctuation between words don't count; every mandatory word must be there, in its place.

For each template the leftmost longest matches that don't overlap are reported.

Scale: one narrow pass over the texts; a vectorised test of two-word beginnings leaves few places
where the automaton is run.

Defined results
* null, empty and wordless texts match nothing; a text without a match has no row;
* a region without a bound reaches as far as it can: copies of one license that has such regions count
  as one match where a region can span from one to the other;
* null doc_id is carried through; each of repeated rows has its own rows in the result;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_id
from .kernels import buffers, slices, span_hashes, words

UNBOUNDED = (1 << 31) - 1

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of
<<var;name="what";original="this software and associated documentation files (the Software)";match=".+">>, to deal in the
<<var;name="noun";original="Software";match="software|work|materials">> without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.<<endOptional>>"""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """ <<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="organization";original="the copyright holder";match=".+">> nor the names of
<<beginOptional>>its <<endOptional>>contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

_GNU = """This <<var;name="work";original="program";match="program|library|software|file">> is free software you can
redistribute it and/or modify it under the terms of the GNU %s as published by <<var;name="publisher";original="the Free Software Foundation";match=".+">>,
<<beginOptional>>either <<endOptional>>version %s of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>"""
_CC = """licensed under <<beginOptional>><<var;name="article";original="a";match="a|the">> <<endOptional>>Creative Commons %s %s<<beginOptional>> International<<endOptional>><<beginOptional>> Public<<endOptional>><<beginOptional>> License<<endOptional>>"""
#: Long texts are known by the words that they begin and end with.
_LONG = '%s<<var;name="body";original="body";match=".+">> %s'
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will
<<var;name="holder";original="the authors";match=".+">> be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
<<beginOptional>>(see the following) <<endOptional>>in the product documentation would be appreciated but is not required.
<<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution."""

TEMPLATES = {
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License<<endOptional>>',
    "MIT-notice": '<<var;name="verb";original="Released";match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the <<endOptional>>MIT License',
    "MIT": _MIT,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "Zlib": _ZLIB,
    "Apache-2.0": _LONG % ("Apache License Version 2.0, January 2004 <<beginOptional>>http://www.apache.org/licenses/ <<endOptional>>TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION ", "END OF TERMS AND CONDITIONS"),
    "GPL-2.0": _LONG % ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991 ", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": _LONG % ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 ", "END OF TERMS AND CONDITIONS"),
    "AGPL-3.0": _LONG % ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 ", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": _LONG % ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 ", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": _LONG % ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 ", "is permanent authorization for you to choose that version for the Library"),
    "GPL-2.0-header": _GNU % ("General Public License", "2"),
    "LGPL-2.1-header": _GNU % ("Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _GNU % ("Lesser General Public License", "3"),
    "AGPL-3.0-header": _GNU % ("Affero General Public License", "3"),
    "MPL-2.0": _LONG % ("Mozilla Public License Version 2.0 1. Definitions ", "Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0"),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC0-1.0-notice": '<<var;name="article";original="Creative Commons";match="creative commons|cc0">> <<beginOptional>>CC0 <<endOptional>>1.0 Universal',
    "ISC": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "GPL-3.0-notice": '<<beginOptional>>This <<var;name="work";original="work";match="work|program|software|library|file">> is <<endOptional>>licensed under the GNU General Public License, <<beginOptional>>either <<endOptional>>version 3<<beginOptional>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>',
    "GPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by <<var;name="publisher";original="the Free Software Foundation";match=".+">>, either version 3 of the License, or (at your option) any later version.',
    "CC-BY-NC-4.0-notice": '<<beginOptional>>This <<var;name="work";original="work";match="work|text|document">> is <<endOptional>>licensed under <<beginOptional>>a Creative Commons Attribution-NonCommercial 4.0 International License (<<endOptional>>CC BY-NC 4.0',
    "all-rights-reserved": '<<beginOptional>>Copyright <<var;name="holder";original="holder";match=".{1,12}">> <<endOptional>>All rights reserved',
}
TEMPLATES |= {f"CC-{kind}-{v}-license": _CC % (name, v) for kind, name in _CC_KINDS.items() for v in ("3.0", "4.0")}
TEMPLATES |= {f"CC-{kind}-{v}-notice": f"licensed under CC {kind} {v}" for kind in _CC_KINDS for v in ("3.0", "4.0") if (kind, v) != ("BY-NC", "4.0")}

_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_FIELD = re.compile(r'(\w+)="([^"]*)"')
_WILD = re.compile(r"\.(\+|\*|\{(\d+),(\d+)\})")


def split_words(text: str) -> list[str]:
    """The words that the scan sees: ASCII case folded."""
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in _WORD.findall(text)]


def parse(template: str) -> list:
    """Nested list of words, ("optional", [...]), ("any of", [[...], ...]) and ("wild", least, most); most is UNBOUNDED if there is no bound."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += split_words(template[at : mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            region = stack.pop()
            stack[-1].append(("optional", region))
        else:
            match = dict(_FIELD.findall(mark[1])).get("match", ".+")
            if wild := _WILD.fullmatch(match):
                least, most = (int(wild[2]), int(wild[3])) if wild[2] else (wild[1] == "+", UNBOUNDED)
                stack[-1].append(("wild", int(least), most))
            elif re.search(r"[][.*+?{}()\\^$]", match):
                raise ValueError(f"unsupported match: {match}")
            else:
                stack[-1].append(("any of", [split_words(x) for x in match.split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + split_words(template[at:])


class Automaton:
    """One automaton for all templates; states of the deterministic form are made as they are met."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.empty: list[list[int]] = []  # edges that read nothing
        self.edges: list[list[tuple[int, int]]] = []  # (word or -1 for any, next)
        self.accepts: dict[int, int] = {}
        begins = []
        for i, name in enumerate(self.names):
            begin = self._new()
            end = self._add(begin, parse(templates[name]))
            self.accepts[end] = i
            begins.append(begin)
        self.start = self._closure(begins)
        if any(w < 0 for s in self.start for w, _ in self.edges[s]) or any(s in self.accepts for s in self.start):
            raise ValueError("a template must begin with a word that it names")
        self.steps: dict[tuple[frozenset, int], frozenset] = {}

    def _new(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.edges) - 1

    def _word(self, state: int, word: int) -> int:
        after = self._new()
        self.edges[state].append((word, after))
        return after

    def _add(self, state: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, str):
                state = self._word(state, self.vocabulary.setdefault(part, len(self.vocabulary)))
            elif part[0] == "optional":
                end = self._add(state, part[1])
                after = self._new()
                self.empty[state].append(after)
                self.empty[end].append(after)
                state = after
            elif part[0] == "any of":
                after = self._new()
                for wording in part[1]:
                    self.empty[self._add(state, wording)].append(after)
                state = after
            else:
                _, least, most = part
                after = self._new()
                for k in range(least if most == UNBOUNDED else most):
                    if k >= least:
                        self.empty[state].append(after)
                    state = self._word(state, -1)
                self.empty[state].append(after)
                if most == UNBOUNDED:
                    self.edges[after].append((-1, after))
                state = after
        return state

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: int) -> frozenset:
        """``word``: its number in the vocabulary, or -1 for any other."""
        key = (states, word)
        if key not in self.steps:
            self.steps[key] = self._closure({n for s in states for w, n in self.edges[s] if w == word or w < 0})
        return self.steps[key]

    def beginnings(self) -> np.ndarray:
        """Whether a match may begin with two words, by their numbers; the last row and column: other words, or none."""
        n = len(self.vocabulary)
        out = np.zeros((n + 1, n + 1), bool)
        for first in range(n):
            if after := self.step(self.start, first):
                out[first] = any(s in self.accepts for s in after) or any(w < 0 for s in after for w, _ in self.edges[s])
                for s in after:
                    for w, _ in self.edges[s]:
                        if w >= 0:
                            out[first, w] = True
        return out


@dataclass
class Scanner:
    automaton: Automaton

    def __post_init__(self):
        vocabulary = list(self.automaton.vocabulary)
        data, off = buffers(pa.array(vocabulary))
        hashes = span_hashes(data, off[:-1], off[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.pairs = hashes[order], order, self.automaton.beginnings()

    def find(self, column):
        """(row, template, first word, words) of the matches in the texts of a batch."""
        data, off = buffers(column)
        other = len(self.hashes)
        for a, b in slices(off):
            part = data[off[a] : off[b]]
            start, end, row = words(part, off[a : b + 1] - off[a])
            hashes = span_hashes(part, start, end)
            at = np.minimum(np.searchsorted(self.hashes, hashes), other - 1)
            ids = np.where(self.hashes[at] == hashes, self.ids[at], other)
            following = np.r_[np.where(row[1:] == row[:-1], ids[1:], other), np.full(min(1, len(ids)), other)]
            free: dict[tuple[int, int], int] = {}
            for i in np.flatnonzero(self.pairs[ids, following]).tolist():
                r = int(row[i])
                stop = int(np.searchsorted(row, r, "right"))
                first = int(np.searchsorted(row, r))
                for t, n in self._longest(ids, i, stop).items():
                    if free.get((r, t), -1) <= i:
                        free[r, t] = i + n
                        yield a + r, t, i - first, n

    def _longest(self, ids, i, stop):
        reach = 64
        while True:  # most runs are short, so only so much is unpacked
            cut = min(stop, i + reach)
            part = [x if x < len(self.hashes) else -1 for x in ids[i:cut].tolist()]
            found, length = self._run(part)
            if length < len(part) or cut == stop:
                return found
            reach *= 8

    def _run(self, part):
        a, states, out = self.automaton, self.automaton.start, {}
        for k, w in enumerate(part):
            states = a.step(states, w)
            if not states:
                return out, k
            for s in states & a.accepts.keys():
                out[a.accepts[s]] = k + 1
        return out, len(part)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, words): where each template matches, counted in words of the text."""
    bounded_batches(docs.sparkSession)
    scanner = Scanner(Automaton(templates))

    def run(batches):
        for batch in batches:
            ids, found = batch.column("doc_id"), list(scanner.find(batch.column("text")))
            rows, t, start, n = zip(*found) if found else ([],) * 4
            cols = [ids.take(pa.array(rows, pa.int64())), pa.array([scanner.automaton.names[x] for x in t], pa.string()), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "start", "words"])

    texts = docs.select(whole_id().alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "doc_id long, license string, start long, words long")
