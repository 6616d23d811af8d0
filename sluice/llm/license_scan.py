"""Licence scan with a generalised suffix automaton.

The automaton holds the words of all licence templates. A text's words stream through it and give
matching statistics: at each word, how many words up to it stand so in some template. Matches that
cannot be extended to the right and span `LEAST` words or more are chained, in order, along each
template; a chain that covers enough of its template labels the text, unless a chain of another template
matches more words in the same place. Only runs of at least LEAST
template words are streamed, since no long match crosses another word.

Defined cases: a null text is an empty text: no words, no labels, score 0; places of equal phrases all
count; repeated rows get equal results; a very long text takes time in proportion to its words; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import WORD_CLASS, bound_batches, released

#: The phrases that always label a text.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licences and their notices, as (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
]
#: Words of a match, words that a chain may skip, share of a template that a chain has to cover.
LEAST, GAP, COVER = 3, 8, 0.75

_WORDS = re.compile(WORD_CLASS.encode())
_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return _WORDS.findall(text.lower())


class SuffixAutomaton:
    """The generalised suffix automaton of several sequences of numbers.

    `ends[state]` maps a sequence's number to the places where the state's strings end in it.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [defaultdict(set)]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, symbol in enumerate(sequence):
                state = self._extend(state, symbol)
                self.ends[state][number].add(place)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, places in self.ends[state].items():
                self.ends[self.link[state]][number] |= places

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(defaultdict(set))
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The target if it is one longer than the state, else a copy of it that is."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if (there := self.next[last].get(symbol)) is not None:
            return self._split(last, symbol, there)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, symbol, self.next[last][symbol])
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """After each symbol: the state and the length of the longest suffix that is in a sequence."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield state, length


class Scanner:
    """The automaton of the templates, ready for texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        split = [words_of(text.encode()) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(x) for x in split]
        vocabulary = sorted({w for x in split for w in x} | {w.encode() for p in PHRASES for w in p.split()})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton([[self.ids[w] for w in x] for x in split])
        self.phrases = [(label, [self.ids[w.encode()] for w in phrase.split()]) for phrase, label in PHRASES.items()]

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        for label, phrase in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = np.logical_and.reduce([ids[i : n + i] == w for i, w in enumerate(phrase)])
                found = np.flatnonzero(hit)
                places += found.tolist()
                labels |= {label} if len(found) else set()
        return places, labels

    def matches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By template: (first word in the text, first word in the template, words), not extensible to the right."""
        found = defaultdict(list)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin < LEAST:
                continue
            stats = list(self.automaton.statistics(ids[begin:end].tolist()))
            for i, (state, length) in enumerate(stats):
                if length >= LEAST and (i + 1 == len(stats) or stats[i + 1][1] <= length):
                    for number, places in self.automaton.ends[state].items():
                        found[number] += [(begin + i - length + 1, p - length + 1, length) for p in places]
        return found

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of the best chain's end in each place."""
        out = []
        for number, matches in sorted(self.matches(ids).items()):
            chains: list[list[int]] = []  # text first, text end, template end, covered; by text end
            for first, place, n in sorted(matches):
                best = None
                # those that end within GAP words before the match or later: as many as fit into a template
                for chain in reversed(chains):
                    if first - chain[1] > GAP:
                        break
                    skip = max(0, chain[1] - first, chain[2] - place)  # words that both have count once
                    if place >= chain[2] - n and skip < n and place + skip - chain[2] <= GAP and (best is None or chain[3] - skip > best[3] - best[4]):
                        best = [*chain, skip]
                bisect.insort(chains, [best[0], first + n, place + n, best[3] + n - best[4]] if best else [first, first + n, place + n, n], key=lambda c: c[1])
            for first, end, _, covered in chains:
                if covered >= COVER * self.sizes[number]:
                    out.append((self.labels[number], first, end - 1, min(1.0, covered / self.sizes[number]), covered))
        return self._strongest(out)

    @staticmethod
    def _strongest(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
        """Without spans of which more than half lies in a neighbour that matches more words: templates share sentences."""
        kept: list[tuple[int, int, str, float]] = []  # in text order
        for label, first, last, share, _ in sorted(spans, key=lambda s: (-s[4], -s[3], s[1], s[0])):
            at = bisect.bisect_left(kept, (first,))
            if all(2 * (min(last, b) - max(first, a) + 1) <= last - first + 1 for a, b, _, _ in kept[max(0, at - 2) : at + 2]):
                kept.insert(at, (first, last, label, share))
        return [(label, first, last, share) for first, last, label, share in kept]

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, (-1,) * len(words)), np.int32, len(words)) if words else np.zeros(0, np.int32)
        places, base = self.base(ids)
        spans = self.spans(ids)
        labels = base | {s[0] for s in spans}
        score = max([1.0 if base else 0.0, *(s[3] for s in spans)])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch in batches:
        rows = [scanner.scan(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", *names])


def scan(documents: DataFrame) -> DataFrame:
    """Labels, places and covered template spans of every text of documents(doc_id, text)."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(released(_scan), _RESULT)
