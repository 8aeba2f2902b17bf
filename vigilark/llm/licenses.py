"""License scans by template markup.

A template is license wording with marked regions: `<<beginOptional>>...<<endOptional>>` may be
left out, `<<var;name=...;match=...;words=lo-hi>>` stands for `lo` to `hi` words that each match
a pattern (any word by default). Each template is compiled into an automaton over words and a
place in a text is accepted when the whole automaton can be walked there, so mandatory wording, from
the first clause to the last, has to stand exactly as written while marked regions may differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from vigilark.llm._arrow import map_texts

# Phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Marked regions that several templates have.
HOLDER = '<<var;name="holder";words="0-24">>'
COPYRIGHT = f"<<beginOptional>>copyright {HOLDER}<<endOptional>><<beginOptional>> all rights reserved<<endOptional>>"
GRANTED = '<<var;name="verb";match="(?:licensed|released|distributed|available|provided|published)";words="1-1">> under '
TERMS = "<<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>a <<endOptional>>"
WHERE = '<<var;name="address";words="1-12">>'

# Whole public license texts and their publishers' notices, with the regions that may
# differ marked. Case and punctuation do not count.
MIT_TEXT = f"""<<beginOptional>>the <<endOptional>><<beginOptional>>mit license <<endOptional>><<beginOptional>>mit <<endOptional>>{COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included
in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;name="authors";words="1-12">> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
BSD_START = f"""{COPYRIGHT} Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
<<beginOptional>>1 <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
<<beginOptional>>2 <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """<<beginOptional>>3 <<endOptional>>Neither the name of <<var;name="organisation";words="1-16">> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;name="provider";words="1-16">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL <<var;name="liable";words="1-16">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
ISC_TEXT = f"""{COPYRIGHT} Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";words="1-12">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";words="1-12">> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
ZLIB_TEXT = f"""{COPYRIGHT} This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
<<beginOptional>>1 <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>>2 <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
<<beginOptional>>3 <<endOptional>>This notice may not be removed or altered from any source distribution"""
APACHE_NOTICE = f"""{COPYRIGHT} Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at {WHERE} Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License"""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE"""
MPL_NOTICE = f"""This Source Code Form is subject to the terms of the Mozilla Public License, <<beginOptional>>v <<endOptional>>2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at {WHERE}"""

# The GNU licenses with their versions, and the Creative Commons licenses: terms, short and long names.
GNU = {
    "gpl": ("", ("1.0", "2.0", "3.0")), "lgpl": ("Lesser ", ("2.1", "3.0")), "lgpl-library": ("Library ", ("2.0",)),
    "agpl": ("Affero ", ("1.0", "3.0")),
}
CREATIVE_COMMONS = {
    "cc-by": "Attribution", "cc-by-sa": "Attribution ShareAlike", "cc-by-nd": "Attribution NoDerivatives", "cc-by-nc": "Attribution NonCommercial",
    "cc-by-nc-sa": "Attribution NonCommercial ShareAlike", "cc-by-nc-nd": "Attribution NonCommercial NoDerivatives",
}
CC_VERSION = '<<var;name="version";match="[0-9]+";words="1-2">>'
LATER = "<<beginOptional>>, or (at your option) any later version<<endOptional>>"


def _number(version: str) -> str:
    """A version in words: a final 0 may be left out."""
    major, minor = version.split(".")
    return f"{major}<<beginOptional>> 0<<endOptional>>" if minor == "0" else f"{major} {minor}"


def gnu_notice(name: str, version: str) -> str:
    """The notice that the publisher asks to put on every file."""
    return f"""<<var;name="program";words="1-8">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it
under the terms of the GNU {name}General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>
<<beginOptional>>either <<endOptional>>version {_number(version)}<<beginOptional>> of the License<<endOptional>>{LATER}
<<beginOptional>>as published by the Free Software Foundation <<endOptional>><<var;name="program";words="1-8">> is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU {name}General Public License for more details"""


def gnu_statement(name: str, version: str) -> str:
    return f"""{GRANTED}{TERMS}GNU {name}General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>
version {_number(version)}<<beginOptional>> of the License<<endOptional>>{LATER}"""


def cc_statement(short: str) -> str:
    return f"""{GRANTED}{TERMS}<<beginOptional>>creative commons <<endOptional>>{short.replace("-", " ")} {CC_VERSION}"""


def cc_long_statement(long: str) -> str:
    return f"""{GRANTED}{TERMS}<<beginOptional>>license <<endOptional>>Creative Commons {long} {CC_VERSION}<<beginOptional>> International<<endOptional>>
<<beginOptional>>Unported<<endOptional>>"""


#: Labels and templates: whole texts, standard notices, and one-line statements of a license.
TEMPLATES = {
    "mit-text": MIT_TEXT,
    "bsd-2-clause-text": f"{BSD_START} {BSD_END}",
    "bsd-3-clause-text": f"{BSD_START} {BSD_THIRD} {BSD_END}",
    "isc-text": ISC_TEXT,
    "zlib-text": ZLIB_TEXT,
    "unlicense-text": UNLICENSE_TEXT,
    "apache-2.0-notice": APACHE_NOTICE,
    "mpl-2.0-notice": MPL_NOTICE,
    "apache-2.0-statement": f"{GRANTED}{TERMS}apache license <<beginOptional>>version <<endOptional>>2 0",
    "mit-statement": f"{GRANTED}{TERMS}mit license",
    **{f"{k}-{v}-notice": gnu_notice(name, v) for k, (name, versions) in GNU.items() for v in versions},
    **{f"{k}-{v}-statement": gnu_statement(name, v) for k, (name, versions) in GNU.items() for v in versions},
    **{f"{k}-statement": cc_statement(k) for k in CREATIVE_COMMONS},
    **{f"{k}-named-statement": cc_long_statement(long) for k, long in CREATIVE_COMMONS.items()},
}

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """`text` in UTF-8 with words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` kept and A-Z lower-cased."""
    return text.encode().translate(_FOLD)


@dataclass(frozen=True)
class Step:
    """One move of an automaton: a word equal to `word`, or matching `like`, leads to `to`."""

    to: int
    word: bytes | None
    like: re.Pattern[bytes] | None


class Automaton:
    """A template as states 0..n with word moves and free moves; the last state accepts."""

    token = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;(?P<attrs>[^>]*)>>|(?P<words>[^<]+)")

    def __init__(self, label: str, markup: str) -> None:
        self.label = label
        self.moves: list[list[Step]] = [[]]
        self.free: list[list[int]] = [[]]
        depth: list[int] = []
        mandatory: list[bytes] = []
        for m in self.token.finditer(markup):
            if m["words"]:
                for w in fold(m["words"]).split():
                    self._add(w, None)
                    if not depth:
                        mandatory.append(w)
            elif m[0] == "<<beginOptional>>":
                depth.append(self._here())
            elif m[0] == "<<endOptional>>":
                self.free[depth.pop()].append(self._here())
            else:
                attrs = dict(a.split("=", 1) for a in m["attrs"].split(";"))
                low, high = map(int, attrs.get("words", '"1-1"').strip('"').split("-"))
                like = re.compile(attrs.get("match", '".+"').strip('"').encode())
                skips = []
                for k in range(high):
                    if k >= low:
                        skips.append(self._here())
                    self._add(None, like)
                for s in skips:
                    self.free[s].append(self._here())
        if depth or not mandatory:
            raise ValueError(f"template {label}: unbalanced optional region or no mandatory word")
        #: Every accepted text holds this word; texts without it are not walked.
        self.anchor = max(mandatory, key=len)
        self.start = self._closure({0})
        self.first = {s.word for q in self.start for s in self.moves[q]}

    def _here(self) -> int:
        return len(self.moves) - 1

    def _add(self, word: bytes | None, like: re.Pattern[bytes] | None) -> None:
        self.moves[-1].append(Step(len(self.moves), word, like))
        self.moves.append([])
        self.free.append([])

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def walk(self, words: list[bytes], begin: int) -> int | None:
        """End (exclusive) of the longest accepted run of words from `begin`, or None."""
        states, last, best = self.start, len(self.moves) - 1, None
        for k in range(begin, len(words)):
            w, after = words[k], set()
            for q in states:
                for s in self.moves[q]:
                    if s.word == w if s.like is None else s.like.fullmatch(w):
                        after.add(s.to)
            if not after:
                break
            states = self._closure(after)
            if last in states:
                best = k + 1
        return best

    def scan(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost accepted runs that do not overlap, each as long as possible."""
        found, k = [], 0
        while k < len(words):
            if (None in self.first or words[k] in self.first) and (end := self.walk(words, k)) is not None:
                found.append((k, end))
                k = end
            else:
                k += 1
        return found


HITS = "n_words bigint, hits array<struct<label:string,kind:string,first:bigint,last:bigint>>"


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`id_col`, `n_words` and `hits`: label, kind ('phrase' or 'template'), first and last word.

    Words are counted from 0 over the whole text; phrase hits are all places, overlapping ones
    too. A null or empty text has no words and no hits; repeated rows are scanned each; an empty
    table gives an empty result; other columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    schema = pa.list_(
        pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    )

    def make():
        wanted = [(fold(p).split(), label) for p, label in phrases.items()]
        automata = [Automaton(label, markup) for label, markup in templates.items()]
        anchors = {max(p, key=len) for p, _ in wanted} | {a.anchor for a in automata}

        def hits(folded: bytes, words: list[bytes]) -> list[dict]:
            out = []
            if not any(a in folded for a in anchors):
                return out
            present = set(words)
            for phrase, label in wanted:
                if present.issuperset(phrase):
                    n = len(phrase)
                    for k, w in enumerate(words):
                        if w == phrase[0] and words[k : k + n] == phrase:
                            out.append({"label": label, "kind": "phrase", "first": k, "last": k + n - 1})
            for a in automata:
                if a.anchor in present:
                    for k, end in a.scan(words):
                        out.append({"label": a.label, "kind": "template", "first": k, "last": end - 1})
            return out

        def work(texts: list[str]) -> list[pa.Array]:
            counts, rows = [], []
            for text in texts:
                folded = fold(text)
                words = folded.split()
                counts.append(len(words))
                rows.append(hits(folded, words))
            return [pa.array(counts, pa.int64()), pa.array(rows, schema)]

        return work

    return map_texts(docs, make, HITS, id_col, text_col)
