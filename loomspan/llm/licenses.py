"""License scans by patience alignment.

Words that occur once in the text's stretch and once in the template's are anchors; the longest increasing
subsequence of their places is kept, and the gaps between its members are aligned in the same way. Where a gap has no
anchors, equal words at its ends are matched and the rest counts as different. Coverage is the matched share of the
template's words.

A license is looked for in stretches of the text, so that a template that a text holds several times, or whose words are
frequent elsewhere, still has anchors. Its aligned words may be spread over `Scanner.spread` times its length. Stretches lie
around all places of the template's rarest words in the text, of as many different ones as any alignment of the wanted
coverage must hold one of; each reaches as far as the spread on either side (a wide stretch) and also one and a half
template's lengths (a close one, in which more words are unique). So every alignment within the spread lies in a wide stretch.
Templates of whose words, as a multiset, the text has fewer than the wanted coverage are left out first: no alignment could
reach it.

All licenses of a text are returned: alignments of the wanted coverage by falling coverage, then length, then name, then
place, each unless half of its words are already those of one before.

Defined results: a null or empty text, and one for which no alignment had to be tried, has a null coverage and no license.
Of equal coverages the longer template, then the first name, wins. Repeated rows and null doc_ids are rows like any other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, keyed, series_udf

LEAST = 0.8
WORDS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Whole texts where they are short; of the long ones (GPL, LGPL, AGPL, MPL, Apache) the notice that files carry.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "rights-reserved": "All rights reserved.",
    "mit": f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": _ISC,
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-text": f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "mit-0": f"{_MIT.removesuffix(', subject to the following conditions:')}. {_AS_IS}",
    "isc-text": f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": f"{_BSD} {_BSD_AS_IS}",
    "bsd-3-clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}",
    "unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first, whose second rises."""
    tops, at, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned pairs of places of equal words, rising in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        there = {w: c + i for i, w in enumerate(template[c:d]) if theirs[w] == 1}
        anchors = _rising([(a + i, there[w]) for i, w in enumerate(text[a:b]) if ours[w] == 1 and w in there])
        if anchors:
            last = (a, c)
            for x, y in anchors:
                out.append((x, y))
                todo.append((last[0], x, last[1], y))
                last = (x + 1, y + 1)
            todo.append((last[0], b, last[1], d))
    return sorted(out)


@dataclass(frozen=True)
class Found:
    license: str
    coverage: float
    first_word: int
    end_word: int
    places: frozenset
    size: int


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST, spread: float = 6.0):
        self.least, self.spread = least, spread
        self.templates = [(name, words) for name, text in sorted(templates.items()) if (words := words_of(text))]
        self.counts = [Counter(words) for _, words in self.templates]
        self.known = {w for c in self.counts for w in c}

    def alignments(self, words: list[bytes], places: dict[bytes, list[int]], name: str, template: list[bytes], counts: Counter) -> list[Found]:
        """The template's alignments in the text's stretches."""
        size = len(template)
        # Any alignment with the wanted coverage leaves out less than `spare` words, so it holds one of these.
        spare = size - int(-(-self.least * size // 1)) + 1
        near, taken = [], 0
        for w in sorted(counts, key=lambda w: (len(places.get(w, ())), w)):
            near += places.get(w, ())
            taken += counts[w]
            if taken >= spare:
                break
        out = []
        for each in sorted({min(int(1.5 * size), len(words)), min(int(self.spread * size), len(words))}):
            done = 0
            for p in sorted(near):
                if p < done:
                    continue
                # A stretch serves the places that follow within a quarter of it, so it reaches that much further.
                step = max(1, each // 4)
                begin = max(0, p - each)
                found = patience(words[begin : p + each + step], template)
                if found:
                    out.append(Found(name, len(found) / size, begin + found[0][0], begin + found[-1][0] + 1, frozenset(begin + x for x, _ in found), size))
                done = p + step
        return out

    def scan(self, text: str) -> tuple[float | None, list[Found]]:
        """(coverage of the best alignment, licenses)."""
        words = words_of(text)
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.known:
                places[w].append(i)
        tried = []
        for (name, template), counts in zip(self.templates, self.counts, strict=True):
            if sum(min(n, len(places[w])) for w, n in counts.items() if w in places) >= self.least * len(template):
                tried += self.alignments(words, places, name, template, counts)
        tried.sort(key=lambda f: (-f.coverage, -f.size, f.license, f.first_word))
        out, used = [], set()
        for f in tried:
            if f.coverage >= self.least and 2 * len(f.places & used) < len(f.places):
                out.append(f)
                used |= f.places
        return (tried[0].coverage if tried else None), out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, end_word of the best alignment, licensed, and all licenses, of every row."""

    def run(batches):
        scanner = Scanner(templates, least)
        for texts in batches:
            rows = []
            for t in texts:
                coverage, found = scanner.scan(t)
                all_ = [{"license": f.license, "coverage": f.coverage, "first_word": f.first_word, "end_word": f.end_word} for f in found]
                first = all_[0] if all_ else {"license": None, "first_word": None, "end_word": None}
                rows.append((first["license"], coverage, first["first_word"], first["end_word"], all_))
            yield pd.DataFrame(rows, columns=["license", "coverage", "first_word", "end_word", "licenses"]).astype({"coverage": "Float64", "first_word": "Int64", "end_word": "Int64"})

    one = "license string, coverage double, first_word long, end_word long"
    found = series_udf(run, f"{one}, licenses array<struct<{one.replace(' ', ':').replace(',:', ', ')}>>")
    return keyed(docs, id_col, text_col).select(F.col(ID).alias("doc_id"), found(TEXT).alias("f")).select("doc_id", "f.*", F.col("f.license").isNotNull().alias("licensed"))
