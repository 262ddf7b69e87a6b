"""Operator 9: license scans by template-markup matching.

A template is a license's wording with three kinds of markup: {optional words} may be left out, [one|other wording] takes
any one of its parts, and <<n>> stands for up to n words of any kind. Licenses that are texts are there whole, conditions
and disclaimers included; notices that name a license are templates of their own. A template is compiled into an automaton over words. A text has the license where some
stretch of it leads from the first state to the last: all mandatory words, in order, exactly. Fixed phrases are looked for
beside, by hash.

Words are hashed for whole batches; automata only start at the words a template can begin with.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from rankmill.llm.shared import mapped
from rankmill.llm.text import NOT_ALNUM, Words, chunks, texts

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Wording that licenses share.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and [noninfringement|non infringement] in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_BEGIN = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "{1} {a} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "{2} {b} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "{3} {c} all advertising materials mentioning features or use of this software must display the following [acknowledgement|acknowledgment] this product includes software developed by <<20>>"
_BSD_NAMES = "{3} {4} {c} {d} neither the name of <<12>> nor the names of [its|their|any] contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by <<12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Wording of licenses and notices as they are published, with markup.
TEMPLATES = (
    *((f"{name}-{n}", f"is free software you can redistribute it and or modify it under the terms of the gnu {long} general public license as published by the free software foundation [either version {n} of the license or at your option any later version|version {n} of the license]") for name, long, versions in (("gpl", "", (2, 3)), ("lgpl", "[library|lesser]", (2, 3)), ("agpl", "affero", (3,))) for n in versions),
    *((label, f"spdx license identifier {spdx} {{or later}} {{only}}") for label, spdx in (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("unlicense", "unlicense"))),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will <<8>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {1} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {2} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {3} this notice may not be removed or altered from any source distribution"),
    ("gpl-3", "{this work is} {free software} licensed under the {terms of the} gnu general public license {as published by the free software foundation} {either} version 3 {of the license} {or later}"),
    ("mit", "{released} {licensed} under the {terms of the} mit license"),
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice {{including the next paragraph}} shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("apache-2", "licensed under the apache license version 2 0 {the license}"),
    ("cc-by-nc", "licensed under {a} {the} cc by nc 4 0 {license}"),
    ("cc-by-nc", "licensed under {a} {the} creative commons attribution non commercial 4 0 {international} {license}"),
    ("cc-by", "licensed under {a} {the} creative commons attribution 4 0 {international} {license}"),
    ("cc0", "{this work is} {marked with} cc0 1 0 {universal}"),
    ("bsd-2", f"{_BSD_BEGIN} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_END}"),
    ("bsd-3", f"{_BSD_BEGIN} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_END}"),
    ("bsd-4", f"{_BSD_BEGIN} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_END}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify [and or|and|or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("all-rights-reserved", "{copyright} {c} <<8>> all rights reserved"),
    ("unlicense", f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or [non commercial|noncommercial] and by any means in jurisdictions that [recognize|recognise] copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS}"),
)

_PART = re.compile(r"\{([^}]*)\}|<<(\d+)>>|\[([^\]]*)\]|(\S+)")
_MARKUP = re.compile(r"\{[^}]*\}|<<\d+>>|\[[^\]]*\]")


class Automaton:
    """States are places between the words of a template; steps consume a word, jumps consume none."""

    def __init__(self, template: str, words: Words):
        self.steps: list[dict[int, int]] = [{}]
        self.any: list[int | None] = [None]
        self.jumps: list[list[int]] = [[]]
        self.mandatory = 0

        def state() -> int:
            self.steps.append({})
            self.any.append(None)
            self.jumps.append([])
            return len(self.steps) - 1

        at = 0
        for optional, most, either, word in _PART.findall(template):
            if most:
                exits = [at]
                for _ in range(int(most)):
                    new = state()
                    self.any[at] = new
                    at = new
                    exits.append(at)
                for s in exits[:-1]:
                    self.jumps[s].append(at)
                continue
            begin = at
            if either:
                at, ends = state(), []
                for part in either.split("|"):
                    s = begin
                    for h in words.of(part):
                        if h not in self.steps[s]:
                            self.steps[s][h] = state()
                        s = self.steps[s][h]
                    ends.append(s)
                for s in ends:
                    self.jumps[s].append(at)
                self.mandatory += 1
                continue
            for h in words.of(word or optional):
                new = state()
                self.steps[at][h] = new
                at = new
            if optional:
                self.jumps[begin].append(at)
            else:
                self.mandatory += 1
        self.last = at
        self.start = self.closed({0})
        self.first = {h for s in self.start for h in self.steps[s]}
        self.open = any(self.any[s] is not None for s in self.start)

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for j in self.jumps[todo.pop()]:
                if j not in states:
                    states.add(j)
                    todo.append(j)
        return frozenset(states)

    def match(self, h: list[int], at: int) -> int:
        """Words of the longest stretch from at that the automaton accepts; 0: none."""
        states, best, i = self.start, 0, at
        while states and i < len(h):
            new = set()
            for s in states:
                if (t := self.steps[s].get(h[i])) is not None:
                    new.add(t)
                if (t := self.any[s]) is not None:
                    new.add(t)
            states, i = self.closed(new), i + 1
            if self.last in states:
                best = i - at
        return best


#: An automaton that may begin with any words starts at its first fixed word instead; the words before it are optional.
def _anchored(template: str) -> str:
    return re.sub(r"^(\s*(\{[^}]*\}|<<\d+>>)\s*)*<<\d+>>\s*", "", template)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(phrases, templates):
    def run(batches):
        import pyarrow as pa

        words = Words(NOT_ALNUM, lower=True)
        base = [(np.array(words.of(p), np.uint64), label) for p, label in phrases]
        automata = [(label, Automaton(_anchored(t), words)) for label, t in templates]
        rare = {}
        for label, a in automata:
            for h in a.first:
                rare.setdefault(h, []).append((label, a))
        # A text without one of these words has no license here: each template needs all its mandatory words.
        need = [np.array(sorted({int(x) for x in words.of(_MARKUP.sub(" ", t))}), np.uint64) for _, t in templates]
        first = np.array(sorted(rare), np.uint64)
        for batch in batches:
            offsets, data = texts(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows = []
            for lo, hi, buf, bounds in chunks(offsets, data):
                _, _, wdoc, h = words.split(buf, bounds)
                docs = hi - lo
                begin = np.searchsorted(wdoc, np.arange(docs + 1))
                places, labels = [[] for _ in range(docs)], [set() for _ in range(docs)]
                for p, label in base:
                    at = np.flatnonzero(h[: len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.empty(0, np.int64)
                    for i in range(1, len(p)):
                        at = at[h[at + i] == p[i]]
                    at = at[wdoc[at] == wdoc[at + len(p) - 1]]
                    for d, x in zip(wdoc[at].tolist(), at.tolist(), strict=True):
                        places[d].append(x - int(begin[d]))
                        labels[d].add(label)
                known = [set(x) for x in labels]
                whole = np.zeros(docs, bool)
                can = np.zeros(docs, bool)
                for n in need:
                    # Three of the mandatory words are looked for first; a text without one of them has no match.
                    has = np.ones(docs, bool)
                    for x in (n[0], n[len(n) // 2], n[-1]):
                        seen = np.zeros(docs, bool)
                        seen[wdoc[h == x]] = True
                        has &= seen
                    can |= has
                for d in np.flatnonzero(can).tolist():
                    own = h[begin[d] : begin[d + 1]]
                    text = own.tolist()
                    for i in np.flatnonzero(np.isin(own, first)).tolist():
                        for label, a in rare[text[i]]:
                            if a.match(text, i):
                                known[d].add(label)
                                whole[d] = True
                for d in range(docs):
                    at = places[d]
                    rows.append((ids[lo + d], int(begin[d + 1] - begin[d]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels[d])), ",".join(sorted(known[d])), 1.0 if whole[d] else 0.5 if at else 0.0))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of phrases), first_word, last_word (their least and largest start,
    else null), base_labels, labels (templates' too), score (1: a whole template matched, 0.5: only phrases, 0: neither).

    docs: doc_id, text; other columns are ignored. Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased; a null or empty text has none, a very long one is read whole. A stretch that fits several templates has
    all their labels. Repeated rows each have a result; an empty table gives an empty one. A template without mandatory
    words is an error.
    """
    for label, t in templates:
        if not _MARKUP.sub(" ", t).split():
            raise ValueError(f"the template of {label} has no mandatory word")
    return mapped(docs.select("doc_id", "text"), _scan(phrases, templates), SCHEMA)
