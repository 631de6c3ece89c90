"""Licence scans: normalised text against licence templates by Dice over word bigrams.

Text is cut into units at line ends, at sentence ends, and where a stretch of template bigrams of
STRETCH words or more begins or ends; runs of consecutive units are candidate passages. A template
of b distinct bigrams can reach a Dice of t only with passages of t b / (2 - t) to b (2 - t) / t, so
others are never compared; and a run that has gathered more bigrams, or more of no template, than
any template could allow is not carried on. Runs that begin or end with a unit without any template
bigram are left out: without that unit they score higher. So are runs that a unit more on either
side would not change (its bigrams are all there): the longer run has the same Dice. Repeated
licence text thus makes one candidate, and each start is followed for about one repetition.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.wordbytes import Words, slices, window_hashes


#: Words of a stretch of template bigrams that makes a unit of its own.
STRETCH = 4


class Template(NamedTuple):
    license: str
    text: str


# Licence texts and the notices by which they are commonly named.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = (
    Template("MIT", _PERMISSION),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "This project is licensed under the terms of the MIT license."),
    Template("ISC", _ISC),
    Template("ISC", "Released under the ISC License."),
    Template("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    Template("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    Template("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    Template("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    Template("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    Template("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _normal(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of ASCII letters and digits (lower-cased) and characters beyond ASCII, and whether a
    line or sentence ends after each."""
    w = Words(texts, lower=True, between=_BETWEEN)
    data = w.data
    ends = (data == 46) | (data == 33) | (data == 63)
    ends[:-1] &= _BLANK[data[1:]]
    total = np.concatenate([[0], np.cumsum(ends | (data == 10))])
    cut = np.ones(len(w.start), bool)
    cut[:-1] = total[w.start[1:]] > total[w.stop[:-1]]
    cut[w.ptr[1:][w.ptr[1:] > w.ptr[:-1]] - 1] = True
    return w, cut


class Scanner:
    def __init__(self, templates: tuple[Template, ...], per_cent: int):
        self.names, self.t, self.sets = [], per_cent, []
        for x in templates:
            w, _ = _normal(pa.array([x.text], pa.large_string()))
            grams = set(window_hashes(w.hashes(), 2).tolist())
            if grams:
                self.names.append(x.license)
                self.sets.append(grams)
        self.vocabulary = np.array(sorted(set().union(*self.sets)), np.uint64)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.within: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for g in s:
                self.within.setdefault(g, []).append(i)
        t = per_cent
        self.bounds = [(-(-t * len(s) // (200 - t)), (200 - t) * len(s) // t) for s in self.sets]
        self.most = max((hi for _, hi in self.bounds), default=0)
        self.most_misses = max((2 * len(s) * (100 - t) // t for s in self.sets), default=0)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        if len(self.vocabulary):
            at = np.flatnonzero(self.near[(grams >> np.uint64(48)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.vocabulary, grams[at]), len(self.vocabulary) - 1)
            out[at] = self.vocabulary[found] == grams[at]
        return out

    def passages(self, grams: list[int], hit: list[bool], units: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
        """Non-overlapping matches of one text, best first: Dice, first and past-last word, template.
        grams, hit: by the number of their first word; units: word ranges."""
        has = [any(hit[a : min(b, len(hit))]) for a, b in units]
        ends = [has[j] or bool(j and units[j][0] and hit[units[j][0] - 1]) for j in range(len(units))]
        found = []
        for i in range(len(units)):
            if not has[i]:
                continue
            seen, misses, common = set(), 0, [0] * len(self.sets)
            done = units[i][0]
            left = set(grams[units[i - 1][0] : units[i][0]]) if i and has[i - 1] else None  # what a unit more on the left would add
            for j in range(i, len(units)):
                stop = units[j][1] - 1
                for g in grams[done:stop]:
                    if g not in seen:
                        seen.add(g)
                        if g in self.within:
                            for x in self.within[g]:
                                common[x] += 1
                        else:
                            misses += 1
                done = max(done, stop)
                a = len(seen)
                if misses > self.most_misses or a > self.most:
                    break
                if left is not None:
                    left -= seen
                    if not left:
                        break
                if not ends[j] or j + 1 < len(units) and has[j + 1] and seen.issuperset(grams[done : units[j + 1][1] - 1]):
                    continue
                for x, (lo, hi) in enumerate(self.bounds):
                    if lo <= a <= hi and 200 * common[x] >= self.t * (a + len(self.sets[x])):
                        found.append((2.0 * common[x] / (a + len(self.sets[x])), units[i][0], units[j][1], x))
        found.sort(key=lambda m: (-m[0], m[1] - m[2], m[1], m[3]))
        out: list[tuple[float, int, int, int]] = []
        taken: list[tuple[int, int]] = []  # in order, disjoint
        for m in found:
            at = bisect_left(taken, (m[2], 0))  # those before it begin before the match ends
            if not at or taken[at - 1][1] <= m[1]:
                taken.insert(at, (m[1], m[2]))
                out.append(m)
        return out


def _stretches(hit: np.ndarray) -> np.ndarray:
    """Words after which a text is cut as a stretch of template bigrams begins or ends there. hit: by first word."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # words first..past
    long = past - first >= STRETCH - 1
    return np.concatenate([first[long] - 1, past[long]])


def scan(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, per_cent: int = 80) -> DataFrame:
    """A row for each licence passage: doc_id, license, dice, start, end (code points, end exclusive), n_words.

    Passages whose Dice with a template is ``per_cent`` or more, best first without overlaps; ties
    go to the longer, then to the earlier passage, then to the earlier template. Null, blank and
    one-word texts have none; null ids stay null; repeated rows are scanned each; other columns
    are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "license", "dice", "start", "end", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, per_cent)
        for s in slices(batches):
            w, cut = _normal(s.column("text"))
            if len(w.start) < 2:
                continue
            grams = window_hashes(w.hashes(), 2)
            owner = w.owner()
            hit = scanner.hits(grams) & (owner[1:] == owner[:-1])
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            ids, rows = s.column("doc_id").to_pylist(), []
            for i in np.unique(owner[:-1][hit]):
                lo, hi = w.ptr[i], w.ptr[i + 1]
                own = cut[lo:hi].copy()
                also = _stretches(hit[lo : hi - 1])
                own[also[also >= 0]] = True
                stops = (np.flatnonzero(own) + 1).tolist()
                for dice, a, b, x in scanner.passages(grams[lo : hi - 1].tolist(), hit[lo : hi - 1].tolist(), list(zip([0, *stops], stops))):
                    base = chars[w.text_at[i]]
                    rows.append((ids[i], scanner.names[x], dice, int(chars[w.start[lo + a]] - base), int(chars[w.stop[lo + b - 1]] - base), b - a))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, license string, dice double, start int, end int, n_words long")
