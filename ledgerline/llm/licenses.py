"""License scans by patience alignment.

A template's words are anchored on the words that are unique to both the template and a stretch
of text; the longest increasing subsequence of the anchors is kept, and the gaps between them
are aligned the same way.  Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Public license notices by SPDX identifier, and whole license texts (-text).
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FORMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR "
    "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": _FORMS + _AS_IS,
    "BSD-3-Clause-text": _FORMS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. " + _AS_IS,
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software "
    "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as "
    "such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the "
    "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
    "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works "
    "of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
    "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
#: Words that may be inserted into a notice, in one place or several, beyond its own number of words.
MAX_INSERTED = 40
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two word lists, rising in both."""
    out, tail = [], []
    while a and b and a[0] == b[0]:
        out.append((a0, b0))
        a, b, a0, b0 = a[1:], b[1:], a0 + 1, b0 + 1
    while a and b and a[-1] == b[-1]:
        tail.append((a0 + len(a) - 1, b0 + len(b) - 1))
        a, b = a[:-1], b[:-1]
    if a and b:
        in_a, in_b = Counter(a), Counter(b)
        place = {w: j for j, w in enumerate(b) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in place]
        ends: list[int] = []  # last places in b of rising runs by length
        last: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):
            k = bisect_left(ends, j)
            ends[k:] = [j, *ends[k + 1 :]]
            last[k:] = [n, *last[k + 1 :]]
            back.append(last[k - 1] if k else -1)
        chain, n = [], last[-1] if last else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        if chain:
            i0 = j0 = 0
            for i, j in [*reversed(chain), (len(a), len(b))]:
                out += align(a[i0:i], b[j0:j], a0 + i0, b0 + j0)
                if i < len(a):
                    out.append((a0 + i, b0 + j))
                i0, j0 = i + 1, j + 1
    return out + tail[::-1]


class Scanner:
    """Templates, and the words of which a text must hold one to cover a template."""

    def __init__(self, templates: dict[str, str], share: float):
        self.share = share
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.keys: dict[str, dict[str, list[int]]] = {}
        for name, words in self.templates.items():
            # a covered template lacks at most n - ceil(share n) of its words: among one word more, one is there
            spare = len(words) - self._least(len(words)) + 1
            chosen = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[:spare]
            self.keys[name] = {}
            for i in chosen:
                self.keys[name].setdefault(words[i], []).append(i)
        self.every = {w for keys in self.keys.values() for w in keys}

    def _least(self, n: int) -> int:
        return max(1, -int(-self.share * n // 1))

    def pattern(self) -> str:
        """A regular expression that every text with a covered template matches, whatever its case."""
        return "|".join(sorted(map(re.escape, self.every)))

    def _shared(self, words: list[str], start: int, stop: int, name: str) -> int:
        """How many of the template's words a stretch holds, each as often as in the template at most."""
        return sum((Counter(words[max(0, start) : stop]) & self.counts[name]).values())

    @staticmethod
    def _slacks(n: int) -> list[tuple[int, int]]:
        """Words before and after a template's place that are aligned too: no insertion, few, many on either side."""
        few, many = 2 + n // 2, n + MAX_INSERTED
        return [(0, 0), (0, few), (few, 0), (few, few), (0, many), (many, 0), (many, many)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of every stretch that covers a template.

        Where stretches overlap, the one with most words aligned, less the words among them that are not, stands for them.
        """
        words = words_of(text)
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.every:
                at.setdefault(w, []).append(i)
        out: set[tuple[int, float, int, str, int, int]] = set()
        for name, template in self.templates.items():
            n = len(template)
            slack, least = n + MAX_INSERTED, self._least(n)
            done: set[int] = set()
            for key, places in self.keys[name].items():
                for i, place in ((i, place) for i in at.get(key, ()) for place in places):
                    if i - place in done:
                        continue
                    done.add(i - place)
                    if self._shared(words, i - place - slack, i - place + n + slack, name) < least:
                        continue
                    # words of a neighbouring notice are no longer unique: less slack on either side keeps them out
                    for before, after in self._slacks(n):
                        start = max(0, i - place - before)
                        found = align(template, words[start : i - place + n + after], 0, start)
                        if len(found) >= least:
                            first, last = found[0][1], found[-1][1]
                            worth = 2 * len(found) - (last - first + 1)
                            out.add((-worth, -len(found) / n, last - first, name, first, last))
                        if len(found) == n == found[-1][1] - found[0][1] + 1:
                            break
        firsts: list[int] = []  # of the kept stretches, which are disjoint
        kept: list[tuple[int, int, str, float]] = []
        for _, coverage, _, name, first, last in sorted(out):
            k = bisect_right(firsts, last)
            if not k or kept[k - 1][1] < first:
                firsts.insert(k, first)
                kept.insert(k, (first, last, name, -coverage))
        return sorted((name, coverage, first, last) for first, last, name, coverage in kept)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, share: float = 0.9) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word): one row for each notice in whole texts.

    Every stretch with at least `share` of a template's words aligned, and at most its length and MAX_INSERTED further
    words among them, unless a better one overlaps it (see Scanner.scan()); a template may be found several times in a text.
    Words are runs of letters and digits in lower case.  Null and empty texts have none, an empty table gives no rows;
    rows with equal or null doc_id are scanned one by one; other columns are ignored.
    """
    scanner = Scanner(templates, share)
    pattern = scanner.pattern()
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "license", "coverage", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an automaton finds the texts with any key word in one pass
            some = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), pattern, ignore_case=True), False))
            texts = zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
            rows = [(doc_id, *hit) for doc_id, text in texts for hit in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, license string, coverage double, first_word long, last_word long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
