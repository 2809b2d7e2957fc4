"""Licence scans with a generalised suffix automaton.

The automaton is built of the words of all templates and base phrases.  A file
is streamed through it word by word, which yields its matching statistics: at
every word the longest match that ends there, and the state of that match.

* A base phrase stands at a place if its words are a suffix of that match;
  each state knows the phrases that are.
* Matches of at least ``MIN_MATCH`` words (or a whole shorter template), as
  far as they go, and each template that stands whole inside a longer match are
  chained: in one template they follow each other in order, with at most
  ``MAX_GAP`` words between them in the file.  A chain that covers ``COVERED``
  of its template is a span with the template's label.

A pair of neighbouring words that no template has ends every longer match, so
only runs of known pairs are walked; their matches start from the root.

Null text counts as empty: no words, no places, no labels, score 0.  An empty
table gives an empty result; only doc_id and text are read.  A chain looks
back over all earlier matches of its template that the gap can reach.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame

from .common import UPPER, bounded_batches, text_or_empty, worker_state

MIN_MATCH = 4
MAX_GAP = 12
COVERED = 0.75

#: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label and opening, notice or whole text of common licences, as their stewards publish them.
# Names and years are left out; what a file has in their place is a gap.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
        you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
        of all present and future rights to this software under copyright law."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

#: bytes of a word: digits, a-z and all of characters beyond ASCII; the rest separate
_WORD_TABLE = bytes(b + 32 if chr(b) in UPPER and b < 128 else b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else 32
                    for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences; ``ends[state]`` lists the (sequence, last word) of its matches."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for s, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                own.setdefault(last, []).append((s, i))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state, places in own.items():
            while state > 0:
                self.ends[state] += places
                state = self.link[state]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest match and w; made apart from longer ones if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def statistics(self, words: list[int]):
        """(state, length of the longest match) at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], min_match: int, max_gap: int, covered: float):
        import numpy as np

        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(label, words_of(t)) for label, t in templates]
        texts = [w for w, _ in self.phrases] + [w for _, w in self.templates]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[self.ids[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton(coded)
        n = len(self.ids)
        self.pairs = np.zeros((n + 1, n + 1), dtype=bool)  # the last row and column: unknown words
        for t in coded:
            self.pairs[t[:-1], t[1:]] = True
        self.single = {t[0]: p for p, t in enumerate(coded[:len(self.phrases)]) if len(t) == 1}
        self.min_match, self.max_gap, self.covered = min_match, max_gap, covered
        #: phrases that are a suffix of a state's matches, with their length: those of the states its links lead to
        self.suffix_phrases = self._suffixes(coded[:len(self.phrases)])
        #: and templates
        self.suffix_templates = self._suffixes(coded[len(self.phrases):])

    def _suffixes(self, sequences: list[list[int]]) -> list[list[tuple[int, int]]]:
        """By state: the sequences, with their length, that are a suffix of its longest match."""
        own: dict[int, list[tuple[int, int]]] = {}
        for p, t in enumerate(sequences):
            *_, (state, _) = self.automaton.statistics(t)
            own.setdefault(state, []).append((p, len(t)))
        out: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.next)):
            found = []
            while state > 0:
                found += own.get(state, [])
                state = self.automaton.link[state]
            out.append(found)
        return out

    def scan(self, text: str):
        """n_words, places [(phrase, first word)], spans [(label, first, last word, coverage)], score."""
        import numpy as np

        words, unknown, get = words_of(text), len(self.ids), self.ids.get
        codes = np.fromiter((get(w, unknown) for w in words), dtype=np.int32, count=len(words))
        known = np.flatnonzero(self.pairs[codes[:-1], codes[1:]]) if len(words) > 1 else np.empty(0, dtype=np.int64)
        places, matches = [], {}
        for p in self.single:
            places += [(self.single[p], int(i)) for i in np.flatnonzero(codes == p)]
        if len(known):
            cuts = np.flatnonzero(np.diff(known) > 1)
            starts, ends = known[np.r_[0, cuts + 1]], known[np.r_[cuts, len(known) - 1]] + 2
            for a, b in zip(starts.tolist(), ends.tolist()):
                self._walk(a, codes[a:b].tolist(), places, matches)
        spans, score = self._chains(matches)
        return len(words), sorted(places, key=lambda p: (p[1], p[0])), spans, score

    def _walk(self, at: int, codes: list[int], places, matches) -> None:
        stats = list(self.automaton.statistics(codes))
        first_template = len(self.phrases)
        for k, (state, length) in enumerate(stats):
            for p, n in self.suffix_phrases[state]:
                if 1 < n <= length:
                    places.append((p, at + k + 1 - n))
            on = k + 1 < len(stats) and stats[k + 1][1] == length + 1
            for t, n in self.suffix_templates[state]:
                if n < length or on and n == length:  # whole, inside a longer match
                    matches.setdefault(t, []).append((at + k + 1 - n, 0, n))
            if on:
                continue
            for s, i in self.automaton.ends[state]:
                t = s - first_template
                if t >= 0 and length >= min(self.min_match, len(self.templates[t][1])):
                    matches.setdefault(t, []).append((at + k + 1 - length, i + 1 - length, length))

    def _chains(self, matches):
        """The best chains by template that cover enough of it, and the best coverage at all."""
        spans, score = [], 0.0
        for t, found in matches.items():
            label, total = self.templates[t][0], len(self.templates[t][1])
            found = sorted(set(found))
            best = []  # words covered, first word of the chain, by match
            near = 0  # no earlier match reaches so far: none is longer than its template
            for k, (d, u, n) in enumerate(found):
                top = (n, d)
                while found[near][0] + total + self.max_gap < d:
                    near += 1
                for j in range(near, k):
                    d2, u2, n2 = found[j]
                    over = max(0, d2 + n2 - d, u2 + n2 - u)  # words of this match that the earlier one has
                    if d2 < d and u2 < u and over < n and d - d2 - n2 <= self.max_gap:
                        top = max(top, (best[j][0] + n - over, best[j][1]), key=lambda x: (x[0], -x[1]))
                best.append(top)
            for (d, _, n), (cover, first) in zip(found, best):
                share = cover / total
                score = max(score, share)
                if share >= self.covered:
                    spans.append((label, first, d + n - 1, share))
        # of spans of one label that overlap, the one that covers most
        spans.sort(key=lambda s: (-s[3], s[1] - s[2], s[1], s[0]))
        kept: dict[str, list] = {}  # by place; they don't overlap
        for s in spans:
            mine = kept.setdefault(s[0], [])
            k = bisect_left(mine, s[1], key=lambda o: o[1])
            if (k == 0 or mine[k - 1][2] < s[1]) and (k == len(mine) or s[2] < mine[k][1]):
                mine.insert(k, s)
        return sorted((s for own in kept.values() for s in own), key=lambda s: (s[1], s[2], s[0])), min(score, 1.0)


def licence_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None,
                 min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, places (phrase, label, first_word), spans (label, first_word, last_word, coverage), score."""
    settings = (phrases or PHRASES, templates or TEMPLATES, min_match, max_gap, covered)
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        state, name = worker_state("licences"), ("licences", repr(settings))
        scanner = state[name] = state.get(name) or Scanner(*settings)
        labels = list(settings[0].items())
        place = pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("first_word", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                   ("coverage", pa.float64())]))
        for batch in batches:
            n_words, places, spans, scores = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, p, s, score = scanner.scan(text)
                n_words.append(n)
                places.append([(*labels[i], at) for i, at in p])
                spans.append(s)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()),
                 pa.array([[dict(zip(("phrase", "label", "first_word"), x)) for x in p] for p in places], place),
                 pa.array([[dict(zip(("label", "first_word", "last_word", "coverage"), x)) for x in s] for s in spans], span),
                 pa.array(scores, pa.float64())], names=["doc_id", "n_words", "places", "spans", "score"])

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(
        run, f"doc_id {key}, n_words bigint, places array<struct<phrase: string, label: string, first_word: bigint>>, "
             "spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>, score double")
