"""Licence scans: Dice coefficients of word bigrams against licence templates.

Texts are normalised (lower case, runs of letters, digits and dots, copyright lines left out). The units compared are the whole text, each paragraph (between blank lines) and
each line. A unit of n distinct bigrams can reach a Dice coefficient t with a template of m only if
2 min(n, m) >= t (n + m), so for each unit only templates of m in [n t / (2 - t), n (2 - t) / t]
are compared, and a unit outside all of these is not even cut into bigrams.

A licence needn't be a unit: it can span paragraphs of a longer text, or stand within a line. So
every run of words (window) is compared too. One that matches holds m t / (2 - t) of a template's
bigrams at least and can be trimmed, without a lesser coefficient, until its first and last bigrams
are the template's and its first occurs once in it. So a sweep from each of the template's bigrams in
the text, up to the size bound or the same bigram again, finds the best window from there. Of windows
of one licence that overlap the one with most bigrams shared less those not shared is told; a window
isn't told if it overlaps a unit or window that is told and is of the same licence, or has half of its
shared bigrams in that licence too (a line of the notice in the notice, or a near relative). For a window
unit_no is the number of words before it in the text. As a copyright line can go on with a licence, or
be a wrapped line of one, windows are of the text both without and with these lines. By the same bound a text without any of some
words of the templates holds no match, and isn't cut at all.

Null and empty texts match nothing, and a unit of one word has no bigram. Long texts are scanned
whole, in time linear in their length but for the sweeps. Of equal coefficients the first template by
name wins. Repeated rows give equal rows; an empty table gives none. Other columns are ignored. The
built-in templates are the notices and short licences below; pass others by name, such as the full
texts of the GPL, to scan for them.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.85

# The public notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "This project is licensed under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see https://www.gnu.org/licenses/.""",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-line-2": "This work is licensed under the GNU GPL v3.",
    "gpl-2-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program;
if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2-line-2": "This work is licensed under the GNU GPL v2.",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details. You should have received a copy of the GNU Lesser General Public License
along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston,
MA 02110-1301 USA.""",
    "lgpl-3-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details. You should have received a copy of the GNU Lesser General Public License
along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
General Public License for more details. You should have received a copy of the GNU Affero General Public License
along with this program. If not, see https://www.gnu.org/licenses/.""",
    "agpl-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-line": "Released under CC0 1.0 Universal.",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work. This work is published under the CC0 1.0 Universal Public Domain Dedication.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

COPYRIGHT = re.compile(r"(?im)^[^\w\n]*(?:copyright\b|\(c\)|©).*$")
TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
SCHEMA = "doc_id long, license string, dice double, unit string, unit_no long, unit_words long"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        own = {name: tokens(COPYRIGHT.sub(" ", text)) for name, text in templates.items()}
        sets = sorted((len(b), name, b) for name, ws in own.items() if (b := set(zip(ws, ws[1:]))))
        self.sizes, self.sets, self.least = [x[0] for x in sets], sets, least
        low = least / (2 - least)
        #: Units of fewer or more characters can't hold so few or many bigrams (a word has at least one letter and a gap).
        self.least_chars = 2 * self.sizes[0] * low if sets else float("inf")
        self.most_bigrams = self.sizes[-1] / low if sets else 0
        self.low = low
        self.grams = {name: b for _, name, b in sets}
        #: A text that matches has one of these in lower case.
        self.words = sorted({w for _, _, b in sets for w in self._telling(b)})

    def _need(self, m: int) -> int:
        """Bigrams of a template of m that any match holds at least."""
        return max(1, math.ceil(m * self.low - 1e-9))

    def _telling(self, grams: set[tuple[str, str]]) -> list[str]:
        """Words, long ones first, so many that the bigrams without any of them are too few to match."""
        of: dict[str, set[tuple[str, str]]] = {}
        for g in grams:
            for w in g:
                of.setdefault(w, set()).add(g)
        left, chosen = set(grams), []
        for w in sorted(of, key=lambda w: (len(w) < 6, -len(of[w]) if len(w) > 5 else -len(w), w)):
            if len(left) < self._need(len(grams)):
                break
            if left & of[w]:
                chosen.append(w)
                left -= of[w]
        return chosen

    def best(self, unit: str) -> tuple[float, str, int] | None:
        if len(unit) < self.least_chars:
            return None
        ws = tokens(unit)
        have = set(zip(ws, ws[1:]))
        n = len(have)
        if not n or n > self.most_bigrams:
            return None
        top = None
        for k in range(bisect.bisect_left(self.sizes, n * self.low), bisect.bisect_right(self.sizes, n / self.low)):
            m, name, grams = self.sets[k]
            dice = 2 * len(grams & have) / (n + m)
            if dice >= self.least and (top is None or (-dice, name) < (-top[0], top[1])):
                top = (dice, name, len(ws))
        return top

    def _sweep(self, grams: set[tuple[str, str]], seq: list[int], codes: dict[tuple[str, str], int]) -> list[tuple[int, float, int, int]]:
        """(shared less not shared, dice, first bigram, last bigram) of windows that match and don't overlap, by place."""
        own = {codes[g] for g in grams if g in codes}
        m, most = len(grams), len(grams) / self.low
        if len(own) < self._need(m):
            return []
        found = []
        for i in [i for i, c in enumerate(seq) if c in own]:
            first, seen, shared, top = seq[i], set(), 0, None
            for j in range(i, len(seq)):
                c = seq[j]
                if c in seen:
                    if c == first:
                        break
                    continue
                seen.add(c)
                n = len(seen)
                if n > most:
                    break
                if c in own:
                    shared += 1
                    if 2 * shared >= self.least * (n + m) and (top is None or 2 * shared / (n + m) > top[1]):
                        top = (3 * shared - n - m, 2 * shared / (n + m), i, j)
            if top:
                found.append(top)
        apart: list[tuple[int, int, float, int]] = []
        for score, dice, i, j in sorted(found, key=lambda x: (-x[0], x[2])):
            k = bisect.bisect(apart, (i,))
            if (k == 0 or apart[k - 1][1] + 1 < i) and (k == len(apart) or apart[k][0] > j + 1):
                apart.insert(k, (i, j, dice, score))
        return [(score, dice, i, j) for i, j, dice, score in apart]

    def windows(self, runs: list[tuple[list[str], list[int]]], told: list[tuple[int, int, str]]) -> list[tuple[str, float, str, int, int]]:
        """As scan, of windows of the runs: words and their places in the text. told: first place, end and licence of matching units."""
        hits = []
        for ws, places in runs:
            pairs = list(zip(ws, ws[1:]))
            codes = {g: k for k, g in enumerate(dict.fromkeys(pairs))}
            seq = [codes[g] for g in pairs]
            whole = {name for a, b, name in told if places and a <= places[0] and b > places[-1]}
            for name in self.grams.keys() - whole:
                grams = self.grams[name]
                hits += [(-score, name, places[i], places[j + 1] + 1, dice, {*pairs[i : j + 1]} & grams) for score, dice, i, j in self._sweep(grams, seq, codes)]
        found, told = [], list(told)
        for _, name, start, end, dice, shared in sorted(hits, key=lambda x: x[:4]):
            if not any(a < end and start < b and (name == x or 2 * len(shared & self.grams[x]) >= len(shared)) for a, b, x in told):
                told.append((start, end, name))
                found.append((name, dice, "window", start, end - start))
        return sorted(found, key=lambda x: x[3:])

    def scan(self, text: str | None) -> list[tuple[str, float, str, int, int]]:
        """(licence, dice, unit, number of the unit, words) of all units that match; a paragraph or line equal to a larger unit that matches isn't told again."""
        text = text or ""
        low = text.lower()
        if not any(w in low for w in self.words):
            return []
        notices = [m.span() for m in COPYRIGHT.finditer(text)]
        body = COPYRIGHT.sub(" ", text)
        ws, places, every, end = [], [], [], 0
        for start, stop in [*notices, (len(text), len(text))]:
            part = tokens(text[end:start])
            ws += part
            places += range(len(every), len(every) + len(part))
            every += part + tokens(text[start:stop])
            end = stop
        found, seen, told = [], {}, []
        for kind, units in (("text", [body]), ("paragraph", re.split(r"\n\s*\n", body)), ("line", body.split("\n"))):
            first = 0
            for no, unit in enumerate(units):
                n = len(tokens(unit))
                if hit := self.best(unit):
                    told.append((places[first], places[first + n - 1] + 1, hit[1]))
                    key = " ".join(unit.split())
                    if seen.setdefault(key, kind) == kind:
                        found.append((hit[1], hit[0], kind, no, hit[2]))
                first += n
        runs = [(ws, places), (every, list(range(len(every))))]
        return found + self.windows(runs if notices else runs[:1], told)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, unit (text, paragraph, line, window), unit_no, unit_words of every unit and window that matches."""
    scanner = Scanner(TEMPLATES if templates is None else templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scanner.scan(text.as_py())]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
