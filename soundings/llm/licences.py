"""License scans with a generalised suffix automaton of license texts.

The automaton holds every run of words of every template. A text is streamed through it
word by word; the state after a word gives the longest run ending there that some template
has (the matching statistics). A run that the next word does not lengthen and that has at
least `least` words is a long match; its state knows all template places where it ends.
Long matches whose places follow each other in the same template, with small gaps on both
sides, form a chain; a chain that covers enough of its template reports the template's label
and the span of words it covers.

Words outside the templates' vocabulary reset the automaton, so only runs of vocabulary
words are streamed; which words those are is found with numpy for whole batches.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import Texts, slices, words

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The score of a text that names a licence in a phrase but holds no chain.
PHRASE_SCORE = 0.5
#: Fixed values: (label, wording) of public license texts and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the "
        "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
)

SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x41:0x5B] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """The suffix automaton of several word sequences; `places` of a state: (sequence, last word) of each end."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.places: list[set[tuple[int, int]]] = [set()]
        for s, words_ in enumerate(sequences):
            last = 0
            for at, w in enumerate(words_):
                last = self._add(last, w)
                self.places[last].add((s, at))
        for v in sorted(range(1, len(self.step)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.places[self.link[v]] |= self.places[v]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.step) - 1

    def _divide(self, p: int, w: int, q: int) -> int:
        """A copy of q that stands for its words up to the length of p plus one."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._divide(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._divide(p, w, q)
        return new

    def matches(self, run: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the long matches of a run of words, in order of their ends."""
        state = length = 0
        for i, w in enumerate(run):
            if w not in self.step[state]:
                if length >= least:
                    yield i - 1, length, state
                while state and w not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w not in self.step[state]:
                    continue
            state = self.step[state][w]
            length += 1
        if length >= least:
            yield len(run) - 1, length, state


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 4, gap: int = 8, cover: float = 0.6):
        self.labels = [label for label, _ in templates]
        texts = [tokens(t) for _, t in templates]
        self.lengths = [len(t) for t in texts]
        spoken = sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()})
        _, _, _, h = words(Texts(pa.array(spoken)), SEPARATOR, lower=True)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        number = {w: i for i, w in enumerate(spoken)}
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases.items()]
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        self.least, self.gap, self.cover = least, gap, cover

    def vocabulary(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no template or phrase has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered part) of the chains that cover enough. found: (end, length, state), in order of end.

        For each match and place there is the chain ending in it that covers most. Of a
        template's, that with most covered words comes first (ties: the earlier end, then the
        earlier place), then the next whose span meets none before it, and so on.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}  # template -> (end, length, place of the last word)
        for end, length, state in found:
            for t, at in sorted(self.automaton.places[state]):
                by.setdefault(t, []).append((end, length, at))
        out = []
        for t, nodes in by.items():
            least = self.cover * self.lengths[t]
            good = [(-covered, i, first, nodes[i][0]) for i, (covered, first) in enumerate(self._ending(nodes)) if covered >= least]
            taken: list[tuple[int, int]] = []
            for covered, _, first, last in sorted(good):
                k = bisect.bisect(taken, (last, last))
                if k == 0 or taken[k - 1][1] < first:
                    taken.insert(k, (first, last))
                    out.append((t, first, last, min(1.0, -covered / self.lengths[t])))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def _ending(self, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """(covered words, first word) of the chain that covers most of those ending in each node (ties: the later first word), from nodes that end shortly before."""
        best: list[tuple[int, int]] = []
        low = 0
        reach = max(length for _, length, _ in nodes) + self.gap
        for i, (end, length, at) in enumerate(nodes):
            while nodes[low][0] <= end - reach:
                low += 1
            here = (length, end - length + 1)
            for j in range(low, i):
                e, _, a = nodes[j]
                if 0 < end - e and end - length - e < self.gap and 0 < at - a and at - length - a < self.gap:
                    here = max(here, (best[j][0] + min(length, at - a, end - e), best[j][1]))
            best.append(here)
        return best

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """The chains in one text, given its word numbers."""
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        turn = np.diff(known)
        found = []
        for a, b in zip(np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)):
            if b - a >= self.least:
                found += [(int(a) + end, n, state) for end, n, state in self.automaton.matches(ids[a:b].tolist(), self.least)]
        return self.chains(found) if found else []


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row per input row.

    score: the largest covered part of a template among the text's chains; without one
    PHRASE_SCORE where a phrase stands, else 0.
    spans: label:first:last word of each chain, comma-joined. Null, empty or blank texts have
    no words and no labels ('' and null first_word and last_word); texts of any length are
    read whole; repeated rows are scanned each; an empty table gives no rows; other columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scanner = held.value
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column(1))
                first, _, _, h = words(t, SEPARATOR, lower=True)
                ids = s.vocabulary(h)
                text = np.repeat(np.arange(t.n), np.diff(first))
                n_base, lo, hi = np.zeros(t.n, np.int64), np.full(t.n, np.iinfo(np.int64).max), np.full(t.n, -1)
                base: list[set[str]] = [set() for _ in range(t.n)]
                for phrase, label in s.phrases:
                    k = len(phrase)
                    if len(ids) < k:
                        continue
                    ok = text[: len(ids) - k + 1] == text[k - 1 :]
                    for j, w in enumerate(phrase):
                        ok &= ids[j : len(ids) - k + 1 + j] == w
                    at = np.flatnonzero(ok)
                    np.add.at(n_base, text[at], 1)
                    np.minimum.at(lo, text[at], at - first[text[at]])
                    np.maximum.at(hi, text[at], at - first[text[at]])
                    for i in np.unique(text[at]):
                        base[i].add(label)
                chains = [s.scan(ids[a:b]) for a, b in zip(first[:-1], first[1:])]
                some = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(first)), pa.array(n_base), pa.array(lo, mask=some), pa.array(hi, mask=some), pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(sorted(x | {s.labels[c[0]] for c in y})) for x, y in zip(base, chains)], pa.string()),
                        pa.array([max((c[3] for c in y), default=PHRASE_SCORE if x else 0.0) for x, y in zip(base, chains)], pa.float64()),
                        pa.array([",".join(f"{s.labels[c[0]]}:{c[1]}:{c[2]}" for c in y) for y in chains], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
