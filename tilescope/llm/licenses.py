"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>> ... <<end>>`` may be absent,
``<<var:a|b c|*3>>`` stands for one of the listed wordings or for up to that many
words of any kind; all other wording is mandatory.  A template is compiled into a
token automaton (states, word edges, any-word edges, empty edges); it accepts a
place in a text if the words from there on lead to its final state, that is, if
the mandatory wording matches exactly.  Automata run only where a text has one of
the word pairs that a match can begin with (everywhere, if that may be any word).

Templates come in three kinds: whole license texts, notices (sentences that name a
license) and openings (the first clause of a whole text, labelled ``-opening``: a text
that begins like the license, whatever follows).

Base phrases are found everywhere, overlaps included.

Defined results: a null text counts as empty; a text without words has no places
and score 0; texts of any length are read whole; repeated rows are rows like any
other; an empty table gives an empty result; other columns are not read; a template
whose markup is not balanced is an error.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

#: The base phrases and their labels.
PHRASES = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}

#: License wording.  The disclaimers of liability that the texts share.
_MIT_END = (
    "the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the <<var:software|work|*3>> "
    "the <<var:software|work|*3>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
    "<<opt>>title<<end>> and <<var:noninfringement|non infringement>> in no event shall <<opt>>the<<end>> <<var:authors or copyright holders|*8>> be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the <<var:software|work|*3>> or the use or other dealings in the <<var:software|work|*3>>"
)
_BSD_END = (
    "this software is provided by <<opt>>the<<end>> <<var:copyright holders and contributors|*12>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<opt>>the<<end>> <<var:copyright holder or contributors|copyright holders or contributors|copyright owner or contributors|*12>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted <<opt>>subject to the limitations in the disclaimer below<<end>> provided that the following conditions are met "
    "<<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "<<opt>>3<<end>> neither the <<var:name|names>> of <<opt>>the<<end>> <<var:copyright holder|*12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
#: label, template.  More can be handed in.
TEMPLATES = (
    ("mit-text", f"permission is hereby granted free of charge to any person obtaining a copy of this <<var:software and associated documentation files|*8>> the <<var:software|work|*3>> to deal in the <<var:software|work|*3>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var:software|work|*3>> and to permit persons to whom the <<var:software|work|*3>> is furnished to do so subject to the following conditions {_MIT_END}"),
    ("bsd-2-clause-text", _BSD_START + _BSD_END),
    ("bsd-3-clause-text", _BSD_START + _BSD_NAMES + _BSD_END),
    ("isc-text", "permission to use copy modify and or distribute this <<var:software|*3>> for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:the author|isc|*8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:the author|isc|*8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the <<var:authors|*8>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<<end>> this notice may not be removed or altered from any source distribution"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this <<var:file|work|*3>> except in compliance with the license you may obtain a copy of the license at <<var:http|https>> www apache org licenses license 2 0 <<opt>><<var:txt|html>><<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0-notice", "licensed under the apache license <<opt>>version<<end>> <<var:2.0|2>> <<opt>>the license<<end>>"),
    ("cc-by-nc-notice", "<<var:licensed|distributed|available>> under <<opt>>a<<end>> <<opt>>the<<end>> <<var:cc|creative commons>> <<var:by|attribution>> <<var:nc|noncommercial|non commercial>> <<opt>>international<<end>> <<opt>><<var:4 0|3 0|2 0>><<end>>"),
    ("cc-by-notice", "<<var:licensed|distributed|available>> under <<opt>>a<<end>> <<opt>>the<<end>> <<var:cc|creative commons>> <<var:by|attribution>> <<var:4 0|3 0|2 0>>"),
    ("gpl-notice", "<<var:licensed|distributed|released>> under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation either<<end>> version <<var:1|2|3>>"),
    ("lgpl-notice", "under the <<opt>>terms of the<<end>> gnu <<var:lesser|library>> general public license"),
    ("mit-notice", "<<var:licensed|distributed|released>> under the <<opt>>terms of the<<end>> <<var:mit|expat>> license"),
    ("mpl-notice", "subject to the terms of the mozilla public license <<opt>>v<<end>> <<var:2 0|1 1>>"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this <<var:*4>> and associated documentation files"),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted <<opt>>subject to the limitations in the disclaimer below<<end>> provided that the following conditions are met"),
    ("isc-opening", "permission to use copy modify and or distribute this <<var:*3>> for any purpose with or without fee is hereby granted"),
    ("unlicense-opening", "this is free and unencumbered software released into the public domain"),
)

#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z in lower case.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
ANY = None


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """edges[s]: (word or ANY, next); empty[s]: states reached without a word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for mark, wording in re.findall(r"<<([^>]*)>>|([^<]+)", template):
            if mark == "opt":
                opened.append(at)
            elif mark == "end":
                if not opened:
                    raise ValueError(f"<<end>> without <<opt>> in {template!r}")
                start, nxt = opened.pop(), self.state()
                self.empty[start].append(nxt)
                self.empty[at].append(nxt)
                at = nxt
            elif mark.startswith("var:"):
                nxt = self.state()
                for choice in mark[4:].split("|"):
                    if choice.startswith("*"):
                        here = at
                        for _ in range(int(choice[1:])):
                            here = self.step(here, ANY)
                            self.empty[here].append(nxt)
                    else:
                        self.empty[self.wording(at, choice)].append(nxt)
                at = nxt
            elif mark:
                raise ValueError(f"unknown mark <<{mark}>> in {template!r}")
            else:
                at = self.wording(at, wording)
        if opened:
            raise ValueError(f"<<opt>> without <<end>> in {template!r}")
        self.final = at
        self.starts = self.closure({0})
        if self.final in self.starts:
            raise ValueError(f"no word is mandatory in {template!r}")
        self.shortest = self.least_words()

    def least_words(self) -> int:
        """Words of the shortest text that is accepted."""
        states, words = self.starts, 0
        while self.final not in states:
            states, words = self.closure({t for s in states for _, t in self.edges[s]}), words + 1
        return words

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def step(self, at: int, word: bytes | None) -> int:
        nxt = self.state()
        self.edges[at].append((word, nxt))
        return nxt

    def wording(self, at: int, wording: str) -> int:
        for word in words_of(wording):
            at = self.step(at, word)
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_pairs(self) -> set[bytes]:
        """What a match can begin with: two words, or one where the second may be any or none; no word stands for any."""
        out = set()
        for s in self.starts:
            for word, nxt in self.edges[s]:
                then = self.closure({nxt})
                follow = [w for t in then for w, _ in self.edges[t]]
                if word is ANY:
                    out.add(b"")
                elif ANY in follow or self.final in then:
                    out.add(word)
                else:
                    out |= {word + b" " + w for w in follow}
        return out

    def read(self, words: list[bytes], at: int) -> int:
        """-1 if the words from ``at`` on are accepted, else how many of them the automaton read."""
        states, start = self.starts, at
        while states:
            if self.final in states:
                return -1
            if at >= len(words):
                return at - start
            word, nxt = words[at], set()
            for s in states:
                nxt |= {t for w, t in self.edges[s] if w is ANY or w == word}
            states, at = self.closure(nxt), at + 1
        return at - 1 - start

    def accepts(self, words: list[bytes], at: int) -> bool:
        return self.read(words, at) < 0


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.automata: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, template in templates:
            automaton = Automaton(template)
            for pair in automaton.first_pairs():
                self.automata.setdefault(pair, []).append((label, automaton))

    def scan(self, text: str) -> tuple[int, list[int], set[str], set[str], list[tuple[str, int]], float]:
        """Number of words, places of base phrases, their labels, all labels, places of templates, score."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in PHRASES.items():
            for k in _places(line, phrase):
                places.append(k)
                base.add(label)
        found, score = [], 0.5 if places else 0.0
        for pair, some in self.automata.items():
            for k in _places(line, pair) if pair else range(len(words)):
                for label, a in some:
                    read = a.read(words, k)
                    if read < 0:
                        found.append((label, k))
                        score = max(score, 0.8 if label.endswith("-opening") else 1.0)
                    else:
                        score = max(score, 0.75 * min(1.0, read / a.shortest))
        found = sorted(set(found), key=lambda x: (x[1], x[0]))
        return len(words), places, base, base | {label for label, _ in found}, found, score


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words where ``phrase`` starts."""
    out, needle, at, words, last = [], b" " + phrase + b" ", -1, 0, 0
    while (at := line.find(needle, at + 1)) >= 0:
        words += line.count(b" ", last, at)
        last = at
        out.append(words)
    return out


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    score: 1 where a whole text or a notice is accepted, 0.8 where an opening is; otherwise 0.5 if a base phrase
    stands there, or 0.75 times the largest share of a template's words that were read before it broke off, if that is more.
    places: ``label:first word`` of each template match, comma-joined.
    """

    def make():
        scan = scanner(templates).scan

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan(t or "") for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "n_base": pa.array([len(r[1]) for r in rows], pa.int64()),
                    "first_word": pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                    "last_word": pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                    "base_labels": pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    "labels": pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                    "score": pa.array([r[5] for r in rows], pa.float64()),
                    "places": pa.array([",".join(f"{label}:{k}" for label, k in r[4]) for r in rows], pa.string()),
                }
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places string"
    return map_slices(docs.select("doc_id", "text"), make, schema)
