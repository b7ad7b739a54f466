"""License scans by patience alignment.

A text is aligned with each license template: words unique to both sides are anchors, their
longest increasing subsequence is kept, and the gaps between are aligned in turn. A gap
without such words falls back to the longest common subsequence of what is left. Coverage is
the share of the template's words that the alignment reaches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, spread, texts_of

#: Share of a template's words that makes a find.
COVERAGE = 0.8
#: A region of a text ends where more than this share of the template's length, and SLACK words at least, hold no template word.
GAP, SLACK = 0.25, 6
#: Aligned words a word of the way that a copy must hold at its ends.
SPARSE = 1 / 8

# Public license notices.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "All-rights-reserved": "All rights reserved.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have
received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs that rises on both sides; pairs come sorted by the first, then falling second."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        tails[at : at + 1] = [b]
        last[at : at + 1] = [k]
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions ``(text, template)`` of a patience alignment, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        common = {w for w, n in there.items() if n == 1 and here.get(w) == 1}
        if common:
            where = {w: j for j, w in enumerate(template[c:d], c) if w in common}
            anchors = _increasing([(i, where[w]) for i, w in enumerate(text[a:b], a) if w in common])
            out += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
            continue
        places = defaultdict(list)
        for j in range(d - 1, c - 1, -1):
            places[template[j]].append(j)
        out += _increasing([(i, j) for i, w in enumerate(text[a:b], a) for j in places.get(w, ())])
    return sorted(out)


class Scanner:
    """Aligns texts with all templates that they can reach at all."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words) for name, text in sorted((templates or TEMPLATES).items()) if (words := words_of(text))]
        self.counts = [Counter(words) for _, words in self.templates]
        self.vocabulary = frozenset().union(*(c.keys() for c in self.counts)) if self.counts else frozenset()

    def regions(self, places: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Stretches of template words without a long break."""
        gap = max(SLACK, int(size * GAP))
        start = last = places[0]
        for p in places[1:]:
            if p - last > gap:
                yield start, last + 1
                start = p
            last = p
        yield start, last + 1

    def finds(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(license, coverage, matched words, first word, end word)`` of each copy of each template, best first."""
        words = words_of(text)
        known = self.vocabulary.intersection(words)
        out = []
        for (name, template), counts in zip(self.templates, self.counts, strict=True):
            least = self.coverage * len(template)
            if sum(n for w, n in counts.items() if w in known) < least:
                continue  # it cannot be covered
            for start, end in self.regions([i for i, w in enumerate(words) if w in counts], len(template)):
                if end - start >= least:
                    out += [(name, n / len(template), n, first, stop) for n, first, stop in self._copies(words, start, end, template, counts, least)]
        return sorted(out, key=lambda f: (-f[2], -f[1], f[0], f[3]))

    def _copies(self, words: list[str], start: int, end: int, template: list[str], counts: Counter, least: float) -> Iterator[tuple[int, int, int]]:
        """``(matched words, first, end)`` of the copies in a stretch, one after the other.

        A window of two template lengths moves on by half a length, or to the end of the copy that it
        found, so every copy of up to one and a half lengths lies whole in a window. A window whose
        words, in any order, do not reach ``least`` words of the template cannot be covered and is
        passed over. What lies between the copies found so is aligned whole, however long: first
        what reaches coverage there over a longer way, then, in the same manner, what is left of it.
        """
        width, step = 2 * len(template), max(1, len(template) // 2)
        here: Counter = Counter()
        common, a, b, lo, rest = 0, start, start, start, start
        left: list[tuple[int, int]] = []
        while lo < end:
            hi = min(end, lo + width)
            for w in words[b:hi]:
                if w in counts:
                    common += here[w] < counts[w]
                    here[w] += 1
            for w in words[a:lo]:
                if w in counts:
                    here[w] -= 1
                    common -= here[w] < counts[w]
            a, b = lo, max(b, hi)
            found = self._copy(words, lo, hi, end, template, least) if common >= least else None
            if found:
                yield found
                left.append((rest, found[1]))
                lo = rest = found[2]
            elif hi == end:
                break
            else:
                lo = min(lo + step, end - width)
        left.append((rest, end))
        while left:
            lo, hi = left.pop()
            if hi - lo < least or (lo, hi) == (start, end) and hi - lo <= width:
                continue
            here = Counter(w for w in words[lo:hi] if w in counts)
            if sum(min(n, counts[w]) for w, n in here.items()) >= least and (found := self._copy(words, lo, hi, hi, template, least)):
                yield found
                left += [(lo, found[1]), (found[2], hi)]

    def _copy(self, words: list[str], lo: int, hi: int, end: int, template: list[str], least: float) -> tuple[int, int, int] | None:
        """The first copy in a window, from its first to its last aligned word, or none."""

        def matched(a: int, b: int) -> list[tuple[int, int]]:
            return [(a + i, j) for i, j in align(words[a:b], template)]

        pairs = matched(lo, hi)
        if not pairs or len(pairs) < least:
            return None
        # what the window cut off, then the shortest stretch that matches as much: its end first, then its start
        whole = matched(pairs[0][0], min(end, pairs[0][0] + 2 * len(template)))
        pairs = max(pairs, whole, key=len)
        low, high = pairs[0][0] + len(pairs), pairs[-1][0] + 1
        while low < high:
            middle = (low + high) // 2
            if len(found := matched(pairs[0][0], middle)) >= len(pairs):
                pairs, high = found, min(middle, found[-1][0] + 1)
            else:
                low = middle + 1
        low, high = pairs[0][0], pairs[-1][0] + 1 - len(pairs)
        while low < high:
            middle = (low + high + 1) // 2
            if len(found := matched(middle, pairs[-1][0] + 1)) >= len(pairs):
                pairs, low = found, max(middle, found[0][0])
            else:
                high = middle - 1
        pairs = self._dense(pairs, least)
        return len(pairs), pairs[0][0], pairs[-1][0] + 1

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
        """The run of aligned words that is worth most: one for each, less ``SPARSE`` for each word of the way between two.

        So a copy ends where it ends, and does not gather its missing words from a text or another
        copy far behind it. A run of fewer than ``least`` words is no copy: then all stay.
        """
        best, value, start, chosen = 0.0, 0.0, 0, (0, len(pairs))
        for k, (at, _) in enumerate(pairs):
            value -= SPARSE * (at - pairs[k - 1][0]) if k else 0.0
            if value <= 0:
                value, start = 0.0, k
            value += 1
            if value > best:
                best, chosen = value, (start, k + 1)
        return pairs[chosen[0] : chosen[1]] if chosen[1] - chosen[0] >= least else pairs


_FIND = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_matched", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_matched, first_word, end_word, n_licenses, licenses of every whole text.

    The plain columns are those of the best find (most matched words, then coverage, name and
    place), null without any; ``licenses`` lists all finds, each copy of a notice for itself, and
    ``n_licenses`` counts the different ones. Null and empty texts have none.
    Texts are scanned one by one: repeats agree, null ids pass through, other columns are not read.
    """
    schema = T.StructType([docs.schema["doc_id"], *_FIND.fields, T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.ArrayType(_FIND))])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        names = _FIND.names
        for batch in batches:
            found = [scanner.finds(t) for t in texts_of(batch.column(1))]
            best = [f[0] if f else (None,) * 5 for f in found]
            columns = [batch.column(0), *(pa.array([b[k] for b in best], target.field(k + 1).type) for k in range(5)), pa.array([len({x[0] for x in f}) for f in found], pa.int64()), pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], target.field(7).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)
