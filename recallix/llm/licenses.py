"""License scans: base phrases, and template markup compiled into token automata.

A template is wording with optional regions, `<<opt>> ... <</opt>>`, which may hold others, and replaceable ones,
`<<var:A-B>>`, which stand for A to B words of any kind. All other words are mandatory and must stand in the text exactly
and in order. Wording is read as texts are: words without case and marks. Templates, of notices and of whole licenses,
become automata over words; a text is accepted where one of them runs through to its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, short_batches, strings, with_struct

#: Fixed values of the base: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed values, the public license texts: label and wording, first of notices, then of whole licenses, whose copyright
#: lines, names of holders and list marks may be left out or replaced.
TEMPLATES = [
    ("mit", "<<opt>>released<</opt>> under the MIT license"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0 <<opt>>(the License)<</opt>>"),
    ("gpl-2", "licensed under the <<opt>>terms of the<</opt>> GNU General Public License <<opt>>as published by the Free Software Foundation; either<</opt>> version 2"),
    ("gpl-3", "licensed under the <<opt>>terms of the<</opt>> GNU General Public License <<opt>>as published by the Free Software Foundation; either<</opt>> version 3"),
    ("lgpl", "under the <<opt>>terms of the<</opt>> GNU Lesser General Public License <<var:0-8>> version <<var:1-2>>"),
    ("agpl", "under the <<opt>>terms of the<</opt>> GNU Affero General Public License <<var:0-8>> version <<var:1-2>>"),
    ("cc-by-nc", "licensed under <<opt>>the<</opt>> <<opt>>Creative Commons<</opt>> CC BY-NC <<opt>>SA<</opt>> <<opt>>ND<</opt>> 4.0"),
    ("cc-by-sa", "licensed under <<opt>>the<</opt>> <<opt>>Creative Commons<</opt>> CC BY-SA 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial <<opt>>ShareAlike<</opt>> <<opt>>NoDerivatives<</opt>> <<var:0-3>> license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<opt>>If a copy of the MPL was not distributed with this file, You can obtain one at http<<opt>>s<</opt>>://<<opt>>www.<</opt>>mozilla.org/MPL/2.0/.<</opt>>"),
    ("spdx", "SPDX-License-Identifier: <<var:1-2>>"),
    ("copyright", "copyright <<opt>>(c)<</opt>> <<var:1-8>> all rights reserved"),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http<<opt>>s<</opt>>://www.apache.org/licenses/LICENSE-2.0 <<opt>>html<</opt>> Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-notice",
        "This <<opt>>program<</opt>> <<opt>>file<</opt>> is free software<<opt>>:<</opt>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<opt>>,<</opt>> "
        "either version <<var:1-1>> of the License, or (at your option) any later version. <<var:0-4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. <<opt>>You should have received a copy of the GNU General Public License along with <<var:1-4>> If not, see <<var:1-6>><</opt>>",
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var:0-1>> Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. <<var:0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. <<opt>><<var:0-1>> Neither the name of <<var:1-16>> may be used to endorse or promote products derived from this software without specific prior "
        "written permission.<</opt>> THIS SOFTWARE IS PROVIDED BY <<var:1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted<<opt>>, provided that the above copyright notice and this permission notice appear in all "
        "copies<</opt>>. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var:1-10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-10>> BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var:0-1>> The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var:0-1>> Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. <<var:0-1>> This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. <<opt>>In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
        "rights to this software under copyright law.<</opt>>",
    ),
    (
        "boost-text",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
]

#: Markup of optional and replaceable regions.
_MARKUP = re.compile(r"<<opt>>|<</opt>>|<<var:\d+-\d+>>")

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """Words after A-Z are lower-cased: runs of 0-9, a-z and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States 0 to last; step[s] maps a word (or None: any word) to states; skip[s] are states reached without a word."""

    label: str
    first: bytes
    step: tuple[dict, ...]
    skip: tuple[tuple[int, ...], ...]
    need: tuple[int, ...]
    total: int

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """End of the longest match that starts at a word (or -1), and the largest share of mandatory words met."""
        last, now, end, share = len(self.step) - 1, self._closed({0}), -1, 0
        i = at
        while now:
            share = max(share, max(self.need[s] for s in now))
            if last in now:
                end = i
            if i == len(words):
                break
            word, then = words[i], set()
            for s in now:
                then.update(self.step[s].get(word, ()))
                then.update(self.step[s].get(None, ()))
            now, i = self._closed(then), i + 1
        return end, share / self.total

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states


def compiled(label: str, wording: str) -> Automaton:
    """A template as an automaton; its mandatory part must begin with a word."""
    step, skip, need, open_at, total = [{}], [[]], [0], [], 0

    def state() -> int:
        step.append({})
        skip.append([])
        need.append(total)
        return len(step) - 1

    tokens = [x for i, part in enumerate(re.split(f"({_MARKUP.pattern})", wording)) for x in ([part] if i % 2 else words_of(part))]
    for token in tokens:
        here = len(step) - 1
        if token == "<<opt>>":
            open_at.append(here)
        elif token == "<</opt>>":
            skip[open_at.pop()].append(here)
        elif isinstance(token, str):
            m = re.fullmatch(r"<<var:(\d+)-(\d+)>>", token)
            low, high = int(m[1]), int(m[2])
            ends = [here]
            for _ in range(high):
                s, t = len(step) - 1, state()
                step[s].setdefault(None, []).append(t)
                ends.append(t)
            for e in ends[low:-1]:
                skip[e].append(ends[-1])
        else:
            total += not open_at
            t = state()
            step[here].setdefault(token, []).append(t)
    if open_at:
        raise ValueError("an optional region is not closed")
    starts, todo = {0}, [0]
    while todo:
        for t in skip[todo.pop()]:
            if t not in starts:
                starts.add(t)
                todo.append(t)
    first = next(iter(step[max(starts)]), None)
    if not isinstance(first, bytes) or not total:
        raise ValueError("a template needs mandatory words, and one right after its leading optional regions")
    return Automaton(label, first, tuple(step), tuple(map(tuple, skip)), tuple(need), total)


class Scanner:
    """All automata, by the words that a match can begin with."""

    def __init__(self, templates=tuple(TEMPLATES), phrases=tuple(PHRASES.items())):
        self.by_first: dict[bytes, list[Automaton]] = {}
        for label, wording in templates:
            a = compiled(label, wording)
            for s in a._closed({0}):
                for word in a.step[s]:
                    self.by_first.setdefault(word, []).append(a)
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]

    def scan(self, text: str):
        """Number of words, starts of base phrases, base labels, (label, start, end) of accepted templates, score."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at, seen, word = joined.find(phrase), 0, 0
            while at >= 0:
                word, seen = word + joined.count(b" ", seen, at), at
                starts.append(word)
                base.add(label)
                at = joined.find(phrase, at + 1)
        found, score = [], 0.5 if base else 0.0
        here = {w for w in self.by_first if w in joined}  # where none stands, no template can begin
        for i, w in enumerate(words) if here else ():
            if w in here and w in self.by_first:
                for a in self.by_first[w]:
                    end, share = a.run(words, i)
                    score = max(score, share)
                    if end >= 0:
                        found.append((a.label, i, end))
        return len(words), starts, base, found, min(1.0, score)


def scan_licenses(df: DataFrame, text: str = "text", templates: tuple = tuple(TEMPLATES)) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and matches to every row.

    Whole texts are read; null counts as empty: no words, no labels, null positions, score 0. score is the largest
    share of a template's mandatory words that some place has in order (1 where one is accepted), at least 0.5 where a
    base phrase stands. matches lists label, first word and end of the accepted places. Repeated rows give equal
    results; extra columns stay; columns of df with the new names are replaced. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]

    @F.arrow_udf("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,matches:array<struct<label:string,start:bigint,end:bigint>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for t in strings(batch):
                n, starts, base, found, score = scanner.scan(t)
                every = base | {x[0] for x in found}
                out.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score, [{"label": a, "start": b, "end": c} for a, b, c in found]))
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return with_struct(df, run.asNondeterministic()(F.col(quoted(text))), names)
