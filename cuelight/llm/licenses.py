"""License texts in documents by winnowed fingerprints and banded alignment.

Templates are cut into overlapping runs of words; of each window of runs the one with the least hash is kept, in an
inverted index. Whole documents are looked up there; hits of one template near one diagonal make a candidate. A banded
alignment of the template with the words around it tells which words match, and so coverage and span.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cuelight.llm.common import WordHashes, shingles

# Notices and short licenses as they are worded, without copyright lines.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT notice 2": "Licensed under the MIT License",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"
    ),
    "BSD grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0 sentence": "To the extent possible under law, the author has waived all copyright and related rights",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Scan:
    """run: words of a fingerprint; window: runs of which one is kept, so that every match of run + window - 1 words
    is found; band: how far an alignment may leave its diagonal; coverage: the least share of a template's words."""

    run: int = 3
    window: int = 3
    band: int = 8
    coverage: float = 0.8


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window, the rightmost of equal ones."""
    if not len(hashes):
        return []
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(hashes[::-1].argmin())]
    kept = {i + window - 1 - int(hashes[i : i + window][::-1].argmin()) for i in range(len(hashes) - window + 1)}
    return sorted(kept)


class Index:
    """fingerprint -> (template, place of its first word)."""

    def __init__(self, templates: dict[str, str], how: Scan):
        hashes = WordHashes()
        self.how, self.names = how, list(templates)
        self.words = [_WORD.findall(t.lower()) for t in templates.values()]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            if not words:
                continue
            own = shingles(np.array([hashes[w] for w in words], np.uint64), how.run)
            for at in winnowed(own, how.window):
                self.postings[int(own[at])].append((k, at))
        self.sorted = np.array(sorted(self.postings), np.uint64)


def aligned(template: list[str], words: list[str], shift: int, band: int) -> list[tuple[int, int]]:
    """(template place, word place) of matches in the best banded alignment of the whole template with a part of words.

    shift: the diagonal, a word's place less the template's. A match counts 2, a gap or a mismatch costs 1; words
    before and after are free.
    """
    m, width = len(template), 2 * band + 1
    low = -(10**9)
    score = [[low] * width for _ in range(m + 1)]
    back = [[0] * width for _ in range(m + 1)]
    for j in range(width):
        if 0 <= shift + j - band <= len(words):
            score[0][j] = 0
    for i in range(1, m + 1):
        above, here, t = score[i - 1], score[i], template[i - 1]
        for j in range(width):
            w = i + shift + j - band  # words taken so far
            if w < 0 or w > len(words):
                continue
            best, move = low, 0
            if w > 0 and above[j] > low:
                best, move = above[j] + (2 if words[w - 1] == t else -1), 1
            if j + 1 < width and above[j + 1] - 1 > best:
                best, move = above[j + 1] - 1, 2
            if j and w > 0 and here[j - 1] - 1 > best:
                best, move = here[j - 1] - 1, 3
            here[j], back[i][j] = best, move
    j = max(range(width), key=lambda j: score[m][j])
    if score[m][j] <= low:
        return []
    i, out = m, []
    while i > 0:
        w = i + shift + j - band
        move = back[i][j]
        if move == 1:
            if words[w - 1] == template[i - 1]:
                out.append((i - 1, w - 1))
            i -= 1
        elif move == 2:
            i, j = i - 1, j + 1
        elif move == 3:
            j -= 1
        else:
            break
    return out[::-1]


def found(text: str | None, index: Index, hashes: WordHashes, memo: dict) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) of a text's license passages, in order; start and end in code
    points. Of overlapping passages the one with more matched words stays."""
    if not text or not len(index.sorted):
        return []
    how = index.how
    words = _WORD.findall(text.lower())
    own = shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), how.run)
    if not len(own):
        return []
    at = np.minimum(np.searchsorted(index.sorted, own), len(index.sorted) - 1)
    hits = np.flatnonzero(index.sorted[at] == own)
    if not len(hits):
        return []
    by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in hits.tolist():
        for k, place in index.postings[int(own[p])]:
            by_template[k].append((p - place, p))
    spans = None
    rows = []
    for k, places in by_template.items():
        template = index.words[k]
        taken: list[tuple[int, int]] = []  # words that matches of this template cover, in order
        for shift, p in sorted(places):
            # one alignment holds one occurrence: it is made again on the words left over until it holds the hit or none
            while True:
                n = bisect_right(taken, (p, len(words)))
                if n and taken[n - 1][1] >= p:
                    break
                begin = max(0, shift - how.band, taken[n - 1][1] + 1 if n else 0)
                end = min(shift + len(template) + how.band, taken[n][0] if n < len(taken) else len(words))
                part = words[begin:end]
                key = (k, shift - begin, tuple(part))
                if key not in memo:
                    if len(memo) > 5_000:
                        memo.clear()
                    memo[key] = aligned(template, part, shift - begin, how.band)
                match = memo[key]
                if len(match) < how.coverage * len(template):
                    break
                if spans is None:
                    # lower() may lengthen a text; places are those of the words in the text itself
                    spans = [m.span() for m in _WORD.finditer(text)]
                    if len(spans) != len(words):
                        spans = []
                first, last = match[0][1] + begin, match[-1][1] + begin
                insort(taken, (first, last))
                a, b = (spans[first][0], spans[last][1]) if spans else (-1, -1)
                rows.append((index.names[k], len(match) / len(template), len(match), a, b, first, last))
    rows.sort(key=lambda r: (-r[2], -r[1], r[5], r[0]))
    kept: list[tuple] = []
    covered: list[tuple[int, int]] = []
    for r in rows:
        n = bisect_right(covered, (r[5], len(words)))
        if (not n or covered[n - 1][1] < r[5]) and (n == len(covered) or r[6] < covered[n][0]):
            kept.append(r)
            covered.insert(n, (r[5], r[6]))
    return [r[:5] for r in sorted(kept, key=lambda r: r[5])]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, how: Scan = Scan()) -> DataFrame:
    """One row for each license passage: doc_id, template, coverage, n_matched, start, end.

    Null and empty texts have none; repeated rows are reported as often as they come. Whole texts are read, in time
    linear in their length. Places are -1 where lower case changes how a text falls into words.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, hashes, memo = Index(templates, how), WordHashes(), {}
        for pdf in batches:
            rows = [
                (doc_id, *r)
                for doc_id, text in zip(pdf["doc_id"], pdf["text"])
                for r in found(text, index, hashes, memo)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "template", "coverage", "n_matched", "start", "end"])
            yield out.astype({"doc_id": "Int64", "coverage": float, "n_matched": int, "start": int, "end": int})

    schema = "doc_id long, template string, coverage double, n_matched int, start long, end long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(run, schema)
