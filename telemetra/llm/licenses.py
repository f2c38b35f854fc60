"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is the wording of a license or notice. ``<<beginOptional>>`` ... ``<<endOptional>>`` encloses words that may
be missing (nesting is allowed), ``<<var;name="holder";words="0-30">>`` stands for that many words of any kind. All
other words are mandatory and must stand there exactly, in order, after normalisation (A-Z lower-cased; words of
digits, letters a-z and non-ASCII characters; whatever lies between words does not count).

Each template becomes an automaton over word numbers. It is run from every place where one of its openings (its first
literal words, in every form that the optional regions allow) stands in a text, so that texts without an opening cost a
few substring searches. Sets of states are made into single states as they occur and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, table
from telemetra.llm.decontaminate import NORMAL, WORD, words

#: phrases of the base and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and notices, with the regions that may differ.
_HOLDER = """<<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;name="holder";words="1-30">>
<<beginOptional>>All rights reserved<<endOptional>><<endOptional>>"""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """<<beginOptional>>3<<endOptional>> Neither the name of <<var;name="organization";words="1-20">> nor the
names of <<var;name="contributors";words="1-4">> may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;name="holders";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNDER = """<<beginOptional>><<beginOptional>>this <<var;name="work";words="1-3">> is<<endOptional>>
<<beginOptional>>released<<endOptional>><<endOptional>>"""
_VERSION = """<<beginOptional>>version <<var;name="version";words="1-2">><<endOptional>>"""
#: template name: (label, wording)
TEMPLATES = {
    "mit-text": ("mit", f"""<<beginOptional>>The MIT License<<endOptional>> {_HOLDER}
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name="liable";words="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    "mit-notice": ("mit", f"{_UNDER} <<beginOptional>>licensed<<endOptional>> under the MIT license"),
    "bsd-2-clause-text": ("bsd-2-clause", f"{_HOLDER} {_BSD_START} {_BSD_END}"),
    "bsd-3-clause-text": ("bsd-3-clause", f"{_HOLDER} {_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    "isc-text": ("isc", f"""<<beginOptional>>ISC License<<endOptional>> {_HOLDER}
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";words="1-12">> DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name="liable";words="1-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
        OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    "apache-header": ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        <<var;name="files";words="1-4">> except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0
        <<beginOptional>>.txt<<endOptional>><<endOptional>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    "apache-notice": ("apache", f"{_UNDER} <<beginOptional>>licensed<<endOptional>> under the Apache license {_VERSION}"),
    "gpl-header": ("gpl", """This <<var;name="program";words="1-6">> is free software<<beginOptional>>: you can<<endOptional>> redistribute it and/or modify it under the terms of the GNU
        <<beginOptional>><<var;name="kind";words="1-1">><<endOptional>> General Public License as published by the Free
        Software Foundation; either version <<var;name="version";words="1-2">> of the License, or (at your option) any
        later version."""),
    "gpl-notice": ("gpl", f"""{_UNDER} <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of
        the<<endOptional>> GNU General Public License {_VERSION}"""),
    "lgpl-notice": ("lgpl", f"""{_UNDER} <<beginOptional>>licensed<<endOptional>> under the GNU Lesser General Public
        License {_VERSION}"""),
    "agpl-notice": ("agpl", f"""{_UNDER} <<beginOptional>>licensed<<endOptional>> under the GNU Affero General Public
        License {_VERSION}"""),
    "mpl-header": ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at <<beginOptional>>http<<beginOptional>>s
        <<endOptional>>://<<endOptional>>mozilla.org/MPL/2.0/"""),
    "zlib-text": ("zlib", f"""{_HOLDER} This software is provided 'as-is', without any express or implied warranty. In no
        event will the authors be held liable for any damages arising from the use of this software. Permission is granted
        to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
        it freely, subject to the following restrictions: <<beginOptional>>1<<endOptional>> The origin of this software
        must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or
        altered from any source distribution."""),
    "unlicense-text": ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is
        free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    **{
        f"cc-{short}-notice": (f"cc-{short}", f"""{_UNDER} <<beginOptional>>licensed<<endOptional>> under
        <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> <<beginOptional>>CC
        <<endOptional>> {short} <<beginOptional>><<var;name="version";words="1-2">><<endOptional>>""")
        for short in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
    },
}

OPENING = 3
REMEMBERED = 50_000
TAG = re.compile(r"<<(.*?)>>", re.S)


class Automaton:
    """States of one template: literal moves by word, moves by any word, and moves without a word."""

    def __init__(self, markup: str):
        self.moves: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for k, part in enumerate(TAG.split(markup)):
            if k % 2 == 0:
                for word in words(part):
                    at = self._move(at, word)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                at = self._state(at)
                self.free[opened.pop()].append(at)
            elif part.startswith("var"):
                least, most = map(int, re.search(r'words="(\d+)-(\d+)"', part).groups())
                ends = []
                for i in range(most + 1):
                    if i >= least:
                        ends.append(at)
                    if i < most:
                        at = self._move(at, None)
                end = self._state(at)
                for s in ends[:-1]:
                    self.free[s].append(end)
                at = end
            else:
                raise ValueError(f"unknown region {part!r}")
        if opened:
            raise ValueError("an optional region has no end")
        self.end = at
        self.sets: dict[frozenset[int], int] = {}
        self.steps: list[dict[bytes | None, int]] = []
        self.members: list[frozenset[int]] = []
        self.start = self._number(self._closure({0}))

    def _new(self) -> int:
        self.moves.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _state(self, before: int) -> int:
        self.free[before].append(new := self._new())
        return new

    def _move(self, before: int, word: bytes | None) -> int:
        before = self._state(before)  # a state has one move of its own
        new = self._new()
        if word is None:
            self.any[before] = new
        else:
            self.moves[before][word] = new
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, out = [*states], set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.sets:
            self.sets[states] = len(self.members)
            self.members.append(states)
            self.steps.append({})
        return self.sets[states]

    def step(self, state: int, word: bytes) -> int:
        """The state after a word; -1 if nothing is left."""
        known = self.steps[state]
        if word in known:
            return known[word]
        own = self.members[state]
        literal = any(word in self.moves[s] for s in own)
        if not literal and None in known:
            return known[None]
        to = {self.moves[s][word] for s in own if word in self.moves[s]} | {self.any[s] for s in own if self.any[s] is not None}
        known[word if literal else None] = new = self._number(self._closure(to)) if to else -1
        return new

    def longest(self, tokens: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from ``at``; ``at`` itself if none is accepted."""
        if len(self.members) > REMEMBERED:
            start = self.members[self.start]
            self.sets, self.steps, self.members = {}, [], []
            self.start = self._number(start)
        state, end = self.start, at
        for k in range(at, len(tokens)):
            state = self.step(state, tokens[k])
            if state < 0:
                break
            if self.end in self.members[state]:
                end = k + 1
        return end

    def openings(self, size: int = OPENING) -> set[tuple[bytes, ...]]:
        """The first literal words of everything accepted: up to ``size``, fewer before an end or a word of any kind."""
        out, todo = set(), [((), self.members[self.start])]
        while todo:
            seen, states = todo.pop()
            if len(seen) == size or self.end in states or any(self.any[s] is not None for s in states):
                if not seen:
                    raise ValueError("a template must begin with mandatory or optional words, not with a variable")
                out.add(seen)
                continue
            for word in {w for s in states for w in self.moves[s]}:
                todo.append(((*seen, word), self._closure({self.moves[s][word] for s in states if word in self.moves[s]})))
        return out


class Scanner:
    """All templates, by opening."""

    def __init__(self, templates: dict[str, tuple[str, str]]):
        self.automata = {name: Automaton(markup) for name, (_, markup) in templates.items()}
        self.labels = {name: label for name, (label, _) in templates.items()}
        by_opening: dict[tuple[bytes, ...], list[str]] = {}
        for name, own in self.automata.items():
            for opening in own.openings():
                by_opening.setdefault(opening, []).append(name)
        self.phrases = [(b" " + b" ".join(o) + b" ", names) for o, names in sorted(by_opening.items())]
        self.base = [(b" " + p.encode() + b" ", label, len(p.split())) for p, label in BASE.items()]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple], list[tuple]]:
        """Base places (label, start, end) and accepted passages (label, template, start, end), in words.

        Of one template, passages are leftmost, then longest, and do not overlap. A passage that lies inside a longer
        one of another template (CC BY in CC BY-NC) is part of that wording and not listed.
        """
        line = b" " + b" ".join(tokens) + b" "
        base = [(label, at, at + size) for phrase, label, size in self.base for at in places(line, phrase)]
        starts: dict[str, set[int]] = {}
        for phrase, names in self.phrases:
            for at in places(line, phrase):
                for name in names:
                    starts.setdefault(name, set()).add(at)
        found = []
        for name, own in starts.items():
            free = 0
            for at in sorted(own):
                if at >= free and (end := self.automata[name].longest(tokens, at)) > at:
                    found.append((self.labels[name], name, at, end))
                    free = end
        return sorted(base, key=lambda x: x[1:]), outermost(found)


def outermost(found: list[tuple]) -> list[tuple]:
    """Passages (.., .., start, end) that lie inside no longer one, in order; equal ranges all stay."""
    out, end, widest = [], -1, None
    for x in sorted(found, key=lambda x: (x[2], -x[3], x[1])):
        if x[3] > end:
            end, widest = x[3], x[2:]
        if x[3] == end and x[2:] == widest:
            out.append(x)
    return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which a phrase stands in a line of words between single spaces."""
    at, seen, word = line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        yield word
        at = line.find(phrase, at + 1)


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of ranges."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_PLACE = pa.struct([("label", pa.string()), ("template", pa.string()), ("word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<label:string,template:string,word:long,end_word:long,start:long,end:long>>"


def _placed(text: str, places: list[tuple]) -> list[dict]:
    """Places with their code points in the original text."""
    if not places:
        return []
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.translate(NORMAL))]
    before = np.cumsum([0] + [b & 0xC0 != 0x80 for b in data])
    point = lambda a, b: {"start": int(before[at[a][0]]), "end": int(before[at[b - 1][1]])}
    return [{"label": x, "template": t, "word": a, "end_word": b} | point(a, b) for x, t, a, b in places]


_built: dict = {}


def _scan(templates: dict[str, tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(templates.items())
        if key not in _built:
            _built.clear()
            _built[key] = Scanner(templates)
        own = _built[key]
        for batch in batches:
            counts, base, found, scores = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                tokens = words(text)
                own_base, own_found = own.scan(tokens)
                counts.append(len(tokens))
                base.append(_placed(text, [(x, None, a, b) for x, a, b in own_base]))
                found.append(_placed(text, own_found))
                scores.append(covered([x[-2:] for x in [*own_base, *own_found]]) / len(tokens) if tokens else 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(base, pa.list_(_PLACE)),
                    pa.array(found, pa.list_(_PLACE)), pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "n_words", "base", "found", "score"],
            )

    return run


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, n_words, base, found, score`` of every row.

    ``base`` has every place of a base phrase, ``found`` every passage that a template accepts; both with label, words
    (from 0, end exclusive) and code points of the original text. ``score`` is the share of a text's words in any of
    them. Null and empty texts have no words, no places and score 0. Whole texts are read, repeated rows each on their
    own; an empty table gives no rows; further columns are left behind. Nothing is shuffled.
    """
    schema = f"doc_id long, n_words long, base {_SPANS}, found {_SPANS}, score double"
    return documents(docs).mapInArrow(_scan(TEMPLATES if templates is None else templates), schema)


def op13_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "found.label")).alias("labels"),
        "score",
        F.expr("transform(found, x -> struct(x.template, x.start, x.end))").alias("passages"),
    )
