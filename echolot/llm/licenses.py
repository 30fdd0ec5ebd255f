"""License scans: templates with optional and replaceable regions, compiled to automata over words.

A template is text with three kinds of markup, as license lists use it:

``<<beginOptional>> ... <<endOptional>>``
    may be missing; it may hold other markup.
``<<var;name="...";original="...";match="...">>``
    stands for words that ``match`` says, a small regular expression over words: ``.``
    is any word, ``*``, ``+``, ``?`` and ``{m,n}`` count words, and words, groups in
    parentheses and alternatives with ``|`` are allowed.
``<<notAfter;words="...">>``
    at the beginning: no match within three words after one of these.

All else is mandatory: its words must follow each other exactly, whatever the
case, white space and punctuation.  A text is accepted wherever a run of its words
is.  Rare runs of three mandatory words find the few texts that the automata run on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cached, only, text_batches
from .words import windows, words

FOUND = "doc_id long, license_id string, start int, end int, words int"

#: Spellings that count as one word.
EQUAL = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "acknowledgement": "acknowledgment", "whilst": "while"}

_MARK = re.compile(r"<<(.*?)>>", re.S)
_WORD = re.compile(r"[^\W_]+")


def spelled(text: str) -> list[str]:
    return [EQUAL.get(w, w) for w in _WORD.findall(text.lower())]


Node = tuple  # ("word", w) | ("any", least, most or None) | ("optional", [nodes]) | ("either", [[nodes], ...]) | ("after", {words})

_COUNT = re.compile(r"\*|\+|\?|\{(\d+),?(\d*)\}")
#: White space or its opposite, with how often; templates that were written as JSON may hold its backslash twice.
_SPACE = re.compile(r"\\+([sS])([*+?]?)")


def parse_match(form: str) -> list[Node]:
    """The nodes of a ``match``; ValueError for what isn't an expression over words."""

    def counted(at: int) -> tuple[int, int | None, int]:
        m = _COUNT.match(form, at)
        if not m:
            return 1, 1, at
        if m[1]:
            most = int(m[2]) if m[2] else None if "," in m[0] else int(m[1])
            return int(m[1]), most, m.end()
        return {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[0]] + (m.end(),)

    def choice(at: int, inside: bool) -> tuple[list[Node], int]:
        ways: list[list[Node]] = [[]]
        while at < len(form) and form[at] != ")":
            if form[at] == "|":
                ways.append([])
                at += 1
            elif form[at] == ".":
                least, most, at = counted(at + 1)
                ways[-1].append(("any", least, most))
            elif m := _SPACE.match(form, at):
                if m[1] == "S":
                    ways[-1].append(("any", int(m[2] == "+"), None if m[2] in ("*", "+") else 1))
                at = m.end()
            elif form[at] == "(":
                own, at = choice(at + (3 if form.startswith("(?:", at) else 1), True)
                if at >= len(form):
                    raise ValueError(f"unknown match: {form}")
                least, most, at = counted(at + 1)
                if most is None:
                    raise ValueError(f"only single words may come any number of times: {form}")
                ways[-1] += own * least + [("optional", own)] * (most - least)
            elif form[at] in "[]{}*+?^$":
                raise ValueError(f"unknown match: {form}")
            else:
                to = at
                while to < len(form) and form[to] not in "|.()[]{}*+?^$" and not _SPACE.match(form, to):
                    to += 2 if form[to] == "\\" else 1
                ways[-1] += [("word", w) for w in spelled(form[at:to])]
                at = to
        if inside != (at < len(form)):
            raise ValueError(f"unknown match: {form}")
        return (ways[0] if len(ways) == 1 else [("either", ways)]), at

    return choice(0, False)[0]


def parse(template: str) -> list[Node]:
    """The nodes of a template; ValueError where its markup isn't well formed."""
    stack: list[list[Node]] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += [("word", w) for w in spelled(template[at : m.start()])]
        at = m.end()
        kind, _, rest = m.group(1).partition(";")
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            own = stack.pop()
            stack[-1].append(("optional", own))
        elif kind == "var":
            match = re.search(r'match="([^"]*)"', rest)
            stack[-1] += parse_match(match.group(1) if match else ".*")
        elif kind == "notAfter" and stack == [[]] and (own := re.fullmatch(r'words="([^"]*)"', rest)):
            stack[-1].append(("after", frozenset(spelled(own[1]))))
        else:
            raise ValueError(f"unknown markup: {kind}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    stack[0] += [("word", w) for w in spelled(template[at:])]
    return stack[0]


@dataclass
class Automaton:
    """Per state: a word or None for any word, and the state after it; ``ways``: states that each leads to without a word.

    ``anchor``: mandatory neighbouring words of the template; without any such
    the automaton would have to run on every text, so a template must have one.
    """

    name: str
    steps: list[tuple[str | None, int]]
    ways: list[list[int]]
    final: int
    anchor: tuple[str, ...]
    barred: frozenset = frozenset()

    def longest(self, tokens: list[str], begin: int) -> tuple[int, int] | None:
        """The leftmost match from ``begin`` on, of those the longest, as (start, end) in words."""
        now: dict[int, int] = {}
        best = None
        for i in range(begin, len(tokens) + 1):
            if best is None:
                for s in self.ways[0]:
                    now.setdefault(s, i)
            if self.final in now and (best is None or now[self.final] <= best[0]) and now[self.final] < i:
                best = now[self.final], i
            if i == len(tokens) or best and not now:
                break
            after: dict[int, int] = {}
            for s, start in now.items():
                if s == self.final or best and start > best[0]:
                    continue
                word, to = self.steps[s]
                if word is None or word == tokens[i]:
                    for t in self.ways[to]:
                        if after.get(t, start) >= start:
                            after[t] = start
            now = after
        return best

    def all(self, tokens: list[str]) -> list[tuple[int, int]]:
        out, at = [], 0
        while (m := self.longest(tokens, at)) is not None:
            if self.barred.isdisjoint(tokens[max(0, m[0] - 3) : m[0]]):
                out.append(m)
            at = m[1]
        return out


def compiled(name: str, template: str, anchor_words: int = 3) -> Automaton:
    nodes = parse(template)
    barred = frozenset().union(*(n[1] for n in nodes if n[0] == "after"))
    nodes = [n for n in nodes if n[0] != "after"]
    steps: list[tuple[str | None, int]] = []
    free: list[list[int]] = []

    def state() -> int:
        steps.append((None, -1))
        free.append([])
        return len(steps) - 1

    def add(own: list[Node], at: int) -> int:
        for n in own:
            if n[0] == "word":
                to = state()
                steps[at] = (n[1], to)
                at = to
            elif n[0] == "optional":
                # Its own way begins at a state of its own, as ``at`` must keep both ways open.
                inner = state()
                free[at].append(inner)
                end = add(n[1], inner)
                to = state()
                free[end].append(to)
                free[at].append(to)
                at = to
            elif n[0] == "either":
                to = state()
                for way in n[1]:
                    inner = state()
                    free[at].append(inner)
                    free[add(way, inner)].append(to)
                at = to
            else:
                _, least, most = n
                for _ in range(least):
                    to = state()
                    steps[at] = (None, to)
                    at = to
                if most is None:
                    loop = state()
                    free[at].append(loop)
                    steps[loop] = (None, loop)
                    to = state()
                    free[loop].append(to)
                    at = to
                else:
                    ends = [at]
                    for _ in range(most - least):
                        to = state()
                        steps[at] = (None, to)
                        at = to
                        ends.append(at)
                    to = state()
                    for e in ends:
                        free[e].append(to)
                    at = to
        return at

    first = state()
    final = add(nodes, first)
    dead = state()
    steps = [(w, to) if to >= 0 else ("", dead) for w, to in steps]
    ways = []
    for s in range(len(steps)):
        seen, open_ = {s}, [s]
        while open_:
            for t in free[open_.pop()]:
                if t not in seen:
                    seen.add(t)
                    open_.append(t)
        ways.append(sorted(seen))
    runs: list[list[str]] = [[]]
    for n in nodes:
        if n[0] == "word":
            runs[-1].append(n[1])
        else:
            runs.append([])
    size = min(anchor_words, max(map(len, runs)))
    if not size:
        raise ValueError("a template must have a mandatory word")
    anchor = max((tuple(r[i : i + size]) for r in runs for i in range(len(r) - size + 1)), key=lambda a: sum(map(len, a)))
    return Automaton(name, steps, ways, final, anchor, barred)


def _spellings(anchor: tuple[str, ...]) -> list[tuple[str, ...]]:
    back: dict[str, list[str]] = {}
    for a, b in EQUAL.items():
        back.setdefault(b, []).append(a)
    out: list[tuple[str, ...]] = [()]
    for w in anchor:
        out = [o + (x,) for o in out for x in (w, *back.get(w, []))]
    return out


class Scanner:
    """Automata, and the hashes of their anchors that say which texts each must run on."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.automata = [compiled(k, v) for k, v in sorted(templates.items())]
        self.anchors: dict[int, dict[int, list[int]]] = {}
        for i, a in enumerate(self.automata):
            for s in _spellings(a.anchor):
                h = windows(words([" ".join(s)]).hash, len(s))[0]
                self.anchors.setdefault(len(s), {}).setdefault(int(h), []).append(i)
        self.sorted = {n: np.sort(np.array(list(h), np.uint64)) for n, h in self.anchors.items()}

    def scan(self, texts: list[str]) -> list[tuple[int, str, int, int, int]]:
        """(text, license, start, end, words) of each match."""
        w = words(texts)
        todo: set[tuple[int, int]] = set()
        for n, known in self.sorted.items():
            h = windows(w.hash, n)
            if not len(h) or not len(known):
                continue
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = np.flatnonzero((known[place] == h) & (w.row[: len(h)] == w.row[n - 1 :]))
            for i in at.tolist():
                todo |= {(int(w.row[i]), k) for k in self.anchors[n][int(h[i])]}
        out = []
        tokens: dict[int, list[str]] = {}
        for row, k in sorted(todo):
            a, b = int(w.first[row]), int(w.first[row + 1])
            if row not in tokens:
                tokens[row] = [EQUAL.get(x, x) for x in (texts[row][s:e].lower() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist()))]
            out += [(row, self.automata[k].name, int(w.start[a + s]), int(w.end[a + e - 1]), e - s) for s, e in self.automata[k].all(tokens[row])]
        return out


def matches(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license_id, start, end (characters; end exclusive) and words of each accepted run of words.

    Of a template's matches in a text, the leftmost and of those the longest is
    taken, then on from its end.  Matches of different templates may overlap.  Null
    and empty texts have none; texts of any length are read whole; no documents give no
    rows; repeated rows, and rows with a null id, each give theirs; other columns are
    ignored.  One narrow pass over two columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = cached("licenses", hash(tuple(sorted(shared.value.items()))), lambda: Scanner(shared.value))
        for keys, texts in text_batches(batches, "doc_id", "text"):
            hits = scanner.scan(texts)
            if hits:
                r, name, s, e, n = (list(x) for x in zip(*hits))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)).cast(pa.int64()), pa.array(name), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "license_id", "start", "end", "words"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, FOUND)


_HEAD = '<<beginOptional>>Copyright <<var;name="copyright";original="(c) <year> <holder>";match=".{0,40}">><<endOptional>>'
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,20}">> "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,20}">> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name="number";original="1.";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name="number";original="2.";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """
_NOT = '<<notAfter;words="not never no nor neither cannot isn aren unless without">>'
_VERB = '<<var;name="verb";original="licensed";match="licensed|released|distributed|redistributed|available|provided|published|relicensed|dual licensed|offered|issued|shared|covered|used|is|are|be|it|open sourced">>'
_UNDER = (
    _NOT + '<<beginOptional>>This <<var;name="work";original="work";match=".{1,2}">> is<<endOptional>> ' + _VERB + " under <<beginOptional>>the terms <<beginOptional>>and conditions<<endOptional>> of<<endOptional>> "
    '<<beginOptional>>either <<beginOptional>>of<<endOptional>> <<beginOptional>><<var;name="other";original="the";match=".{1,12}">> or<<endOptional>><<endOptional>> <<beginOptional>>the<<endOptional>> '
)
_GNU = """This <<var;name="program";original="program";match="program|library|file|software|package">> is free software<<var;name="mark";original=":";match=".{0,1}">> you can redistribute it and/or modify it under the terms of
    the GNU NAME as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version VERSION of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.
    This <<var;name="program";original="program";match="program|library|file|software|package">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>>NAME<<endOptional>> <<var;name="name";original="General Public License";match="|General Public License|Lesser General Public License|Library General Public License">> for more details"""


def _gnu(name: str, version: str) -> str:
    return _GNU.replace("NAME", name).replace("VERSION", version)


def _versions(name: str, short: str, major: str) -> str:
    """A notice: the name in words or in short, with a version such as 3, 3.0 or v3."""
    numbers = f"version {major}|version {major}\\.0|{major}|{major}\\.0|v{major}|v\\. {major}|v{major}\\.0"
    return _UNDER + f'<<var;name="name";original="{name}";match="{name}|{short}">> <<var;name="version";original="{major}";match="{numbers}">>'


#: Templates of whole licenses, of file headers, and of one-line notices, by name.
TEMPLATES = {
    "MIT": _HEAD + """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,20}">> BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": _HEAD + """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,10}">> DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name="holder";original="THE AUTHOR";match=".{1,10}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE.""",
    "BSD-2-Clause": _HEAD + _BSD_2 + _AS_IS_BSD,
    "BSD-3-Clause": _HEAD + _BSD_2 + """<<var;name="number";original="3.";match=".{0,1}">> Neither the name of
        <<var;name="organization";original="the copyright holder";match=".{1,20}">> nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. """ + _AS_IS_BSD,
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at <<var;name="scheme";original="http";match=".{1,1}">>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "all-rights-reserved-notice": "All rights reserved",
    "GPL-2.0-header": _gnu("General Public License", "2"),
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-header": _gnu("Affero General Public License", "3"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<var;name="scheme";original="https";match="http|https">>://mozilla.org/MPL/2.0/""",
    "EPL-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0 which
        <<beginOptional>>accompanies this distribution, and<<endOptional>> is available at <<var;name="scheme";original="https";match="http|https">>://www.eclipse.org/legal/epl-""",
    "MIT-notice": _UNDER + "MIT License",
    "Apache-2.0-notice": _UNDER + "Apache <<beginOptional>>Software<<endOptional>> License<<beginOptional>>, Version<<endOptional>> 2.0",
    "GPL-3.0-notice": _versions("GNU General Public License", "GPL|GNU GPL|GPL License", "3"),
    "GPL-2.0-notice": _versions("GNU General Public License", "GPL|GNU GPL|GPL License", "2"),
    "LGPL-3.0-notice": _versions("GNU Lesser General Public License", "LGPL|GNU LGPL", "3"),
    "LGPL-2.1-notice": _versions("GNU Lesser General Public License", "LGPL|GNU LGPL", "2\\.1"),
    "AGPL-3.0-notice": _versions("GNU Affero General Public License", "AGPL|GNU AGPL", "3"),
    "MPL-2.0-notice": _versions("Mozilla Public License", "MPL", "2"),
    "EPL-2.0-notice": _versions("Eclipse Public License", "EPL", "2"),
    "BSD-3-Clause-notice": _UNDER + '<<var;name="clauses";original="3";match="3|three|new|revised|modified">> <<beginOptional>>Clause<<endOptional>> BSD License',
    "BSD-2-Clause-notice": _UNDER + '<<var;name="clauses";original="2";match="2|two|simplified">> <<beginOptional>>Clause<<endOptional>> BSD License',
    "ISC-notice": _UNDER + "ISC License",
    "Unlicense-notice": _UNDER + "Unlicense",
    "CC0-1.0-notice": _UNDER + '<<beginOptional>>Creative Commons<<endOptional>> <<var;name="name";original="CC0";match="CC0|Zero|CC Zero">> <<var;name="version";original="1.0";match="1\\.0|version 1\\.0|v1\\.0">>',
    **{f"CC-{k}-4.0-notice": _UNDER + f'<<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> <<var;name="name";original="CC {k}";match="CC {" ".join(k.split("-"))}|{long}">> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>> 4.0'
       for k, long in {"BY": "Attribution", "BY-SA": "Attribution ShareAlike|Attribution Share Alike", "BY-NC": "Attribution NonCommercial|Attribution Non Commercial", "BY-ND": "Attribution NoDerivatives|Attribution NoDerivs", "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}.items()},
    # Whole texts of licenses that are long, one a file.
    **{p.stem: p.read_text() for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))},
}
