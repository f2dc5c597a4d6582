"""Licence scans: a generalised suffix automaton of licence templates, streamed over the words of each text.

Each word moves the automaton; the length of the longest suffix of the words read that stands in some template is the
matching statistic there. Where a match of at least LONG words ends (the next word shortens it), it covers a span of
every template that holds it. A template's spans are chained: in order in text and template, with at most GAP words of
text from one to the next. The share of the template's words that its best chain covers is its score. A share of COVERED or
more gives the label, unless some of the template is missing and all that was found stands in another label's notice as well.

Base phrases are templates too, and their places are exact: a phrase ends at a word when its state is the automaton's
state there, long enough, or one of that state's suffixes. Words that stand in no template reset the automaton, so only
runs of template words are streamed; the rest is found by vectorised look-up.

Null and empty texts have no words, no labels and score 0. Equal texts, repeated rows among them, get equal results. Of chains
that cover as much, the one that ends first counts. A very long text is a step of its own, read whole. Only doc_id and
text are read, so further columns cannot clash. State: the templates' automaton and one step of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM_WORDS_LOWER, lean, read, steps, words

LONG, COVERED, GAP, STEP = 3, 0.75, 8, 4 << 20

#: Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known licence notices and whole short licences, as lower-case words.
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
_MIT_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_MIT_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_CLAUSES = "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL_NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_GPL_WARRANTY = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
TEMPLATES = {
    "mit": [
        "released under the mit license",
        _MIT_GRANT,
        _MIT_NOTICE,
        f"{_MIT_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions {_MIT_NOTICE} {_MIT_WARRANTY}",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl-3.0": ["licensed under the gnu general public license version 3", f"{_GPL_NOTICE} either version 3 of the license or at your option any later version {_GPL_WARRANTY}"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", f"{_GPL_NOTICE} either version 2 of the license or at your option any later version {_GPL_WARRANTY}"],
    "gpl-notice": [_GPL_NOTICE],
    "lgpl": ["gnu lesser general public license"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd": [_BSD_HEAD],
    "bsd-2-clause": [f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_WARRANTY}"],
    "bsd-3-clause": [f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "bsl-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"],
}


class Automaton:
    """States hold the strings that end at the same places of the templates."""

    def __init__(self, templates: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, words up to here)
        for number, template in enumerate(templates):
            at = 0
            for place, word in enumerate(template):
                at = self._grown(at, word)
                self.ends[at].append((number, place + 1))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})

    def _state(self, length: int, step: dict[str, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: str) -> int:
        """The state that p reaches by word, cut down to the strings that p's extend to."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _grown(self, last: int, word: str) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def state(self, template: list[str]) -> int:
        at = 0
        for word in template:
            at = self.next[at][word]
        return at

    def above(self, s: int) -> list[int]:
        out = []
        while s > 0:
            out.append(s)
            s = self.link[s]
        return out


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES, long: int = LONG, covered: float = COVERED):
        self.long, self.covered = long, covered
        self.base = [(p.split(), label) for p, label in base.items()]
        own = [(t.split(), label) for label, ts in templates.items() for t in ts]
        self.templates = [*self.base, *own]
        self.auto = Automaton([t for t, _ in self.templates])
        at = {}
        for k, (phrase, _) in enumerate(self.base):
            at.setdefault(self.auto.state(phrase), []).append(k)
        self.here = [at.get(s, []) for s in range(len(self.auto.length))]
        self.up = [[k for a in self.auto.above(s)[1:] for k in at.get(a, [])] for s in range(len(self.auto.length))]
        # Whole templates that stand within others: a match that goes on past their end shows them all the same.
        text = [f" {' '.join(t)} " for t, _ in self.templates]
        self.inside = [[(j, i) for j, (u, _) in enumerate(self.templates) if text[j] in text[k] and u != t for i in range(len(t) - len(u) + 1) if t[i : i + len(u)] == u] for k, (t, _) in enumerate(self.templates)]
        self.words = sorted({w for t, _ in self.templates for w in t})
        self.fewest = min((len(t) for t, _ in self.templates), default=0)

    def spans(self, state: int, size: int, start: int) -> list[tuple[int, int, int, int]]:
        """Spans (template, from, to, start) of a match of `size` words that ends in a state, and of whole templates within it."""
        out = [(t, e - size, e, start) for t, e in self.auto.ends[state]]
        more = {(j, 0, len(self.templates[j][0]), start + i - a) for t, a, b, _ in out for j, i in self.inside[t] if a <= i and i + len(self.templates[j][0]) <= b}
        return [*out, *sorted(more)]

    def streamed(self, stream: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (phrase, start) and covered spans (template, from, to, start) of a run of template words."""
        step, link, length = self.auto.next, self.auto.link, self.auto.length
        places, spans = [], []
        s = size = 0
        for i, word in enumerate(stream):
            was, had = s, size
            while s and word not in step[s]:
                s = link[s]
                size = length[s]
            s = step[s].get(word, 0)
            size = size + 1 if s else 0
            if had >= self.long and size <= had:
                spans += self.spans(was, had, i - had)
            for k in self.here[s]:
                if size >= len(self.base[k][0]):
                    places.append((k, i + 1 - len(self.base[k][0])))
            for k in self.up[s]:
                places.append((k, i + 1 - len(self.base[k][0])))
        if size >= self.long:
            spans += self.spans(s, size, len(stream) - size)
        return places, spans

    def chain(self, own: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Words covered by the best chain of one template's spans (start, from, to), and its pieces of text (start, stop)."""
        own = sorted(own)
        longest = max(b - a for _, a, b in own)
        got, before, cut = [], [], []
        first = 0
        for i, (x, a, b) in enumerate(own):
            got.append(b - a)
            before.append(-1)
            cut.append(0)
            while own[first][0] + longest + GAP < x:
                first += 1
            for j in range(first, i):
                y, c, d = own[j]
                stop = y + d - c
                trim = max(0, d - a, stop - x)
                if c <= a and x - stop <= GAP and trim < b - a and got[j] + b - a - trim > got[i]:
                    got[i], before[i], cut[i] = got[j] + b - a - trim, j, trim
        i = best = max(range(len(own)), key=got.__getitem__)
        pieces = []
        while i >= 0:
            x, a, b = own[i]
            pieces.append((x + cut[i], x + b - a))
            i = before[i]
        return got[best], pieces[::-1]

    def chained(self, spans: list[tuple[int, int, int, int]]) -> tuple[set[str], float, tuple[int, int] | None]:
        """Labels, the best share of a template's words in one chain, and the first and last word of that chain."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, b, x in spans:
            by.setdefault(t, []).append((x, a, b))
        best, where, enough = 0.0, None, []
        for t, own in by.items():
            got, pieces = self.chain(own)
            share = got / len(self.templates[t][0])
            if share > best:
                best, where = share, (pieces[0][0], pieces[-1][1] - 1)
            if share >= self.covered:
                enough.append((share, self.templates[t][1], {i for a, b in pieces for i in range(a, b)}))
        labels = {label for share, label, at in enough if share == 1 or not any(at <= more for _, other, more in enough if other != label)}
        return labels, best, where

    def scanned(self, texts: pa.Array) -> list[tuple]:
        """(n_words, base places, base labels, all labels, score, first and last word of the best chain) of each text of a step."""
        w = words(texts, ALNUM_WORDS_LOWER)
        known = pc.is_in(w.vocabulary, pa.array(self.words, w.vocabulary.type)).to_numpy(zero_copy_only=False)
        mask = np.concatenate([[False], known[w.codes] if len(w.codes) else np.zeros(0, bool), [False]]).astype(np.int8)
        starts = np.flatnonzero(np.diff(mask) == 1)
        stops = np.flatnonzero(np.diff(mask) == -1)
        # A run ends at a document's border as well.
        inner = w.offsets[1:-1]
        at = np.searchsorted(starts, inner, side="right") - 1
        cut = inner[(at >= 0) & (inner < stops[at]) & (inner > starts[at])] if len(starts) else inner[:0]
        starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
        enough = stops - starts >= min(self.fewest, self.long)
        starts, stops = starts[enough], stops[enough]
        rows = np.searchsorted(w.offsets, starts, side="right") - 1
        names = {int(c): v for c, v in zip(np.flatnonzero(known), w.vocabulary.filter(pa.array(known)).to_pylist(), strict=True)}
        found: dict[int, tuple[list, list]] = {}
        for row, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist(), strict=True):
            places, spans = self.streamed([names[c] for c in w.codes[a:b].tolist()])
            if places or spans:
                own = found.setdefault(row, ([], []))
                first = a - int(w.offsets[row])
                own[0].extend((k, first + i) for k, i in places)
                own[1].extend((t, c, d, first + x) for t, c, d, x in spans)
        out = []
        for row, n in enumerate(w.counts.tolist()):
            places, spans = found.get(row, ([], []))
            labels, score, where = self.chained(spans)
            base = {self.base[k][1] for k, _ in places}
            out.append((n, [i for _, i in places], sorted(base), sorted(base | labels), max(score, 1.0 if base else 0.0), where))
        return out


def licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts, first and last base place, labels, score, place of the best chain."""
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            rows = scanner.scanned(batch.column("text"))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "n_base": pa.array([len(r[1]) for r in rows], pa.int64()),
                "first_word": pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                "last_word": pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                "base_labels": pa.array([",".join(r[2]) for r in rows], pa.string()),
                "labels": pa.array([",".join(r[3]) for r in rows], pa.string()),
                "score": pa.array([float(r[4]) for r in rows], pa.float64()),
                "chain_first": pa.array([r[5] and r[5][0] for r in rows], pa.int64()),
                "chain_last": pa.array([r[5] and r[5][1] for r in rows], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, chain_first long, chain_last long")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))
