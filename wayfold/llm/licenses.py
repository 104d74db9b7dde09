"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words (letters and digits, lower case); hashes of three-word runs are
winnowed, and an inverted index leads from a fingerprint to its templates and places.  A text's own
winnowed fingerprints look up candidates with their diagonals; where the words there equal the
template's the match is whole, else the template is aligned to the text inside a band around the
diagonal.  Any stretch of four words in common has a common fingerprint.

The index is the fixed library of templates, so it travels with the code; texts are read once, whole.
The library holds notices of one sentence or two and the whole texts of short licences; a text with a
whole licence gives a row for that, since it matches more words than the clauses inside it.

Defined results: a null, empty or matchless text gives no rows; a template that occurs again in a
text gives a row for each place; repeated rows give theirs each; of overlapping matches the one with more matched words stays, then
the better covered, then the earlier; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substrings import _sliding_min
from .textkit import U64, slices, to_bytes, window_hashes, word_hashes

RUN, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.75
#: Sentences by which licences are commonly named or granted.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential."],
}
#: Whole texts of short licences, without their copyright lines.
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "BSD-2-Clause": [_GRANT + _SOURCE + _BINARY + _AS_IS],
    "BSD-3-Clause": [_GRANT + _SOURCE + _BINARY + _NAMES + _AS_IS],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ],
}
LIBRARY = {name: TEMPLATES.get(name, []) + TEXTS.get(name, []) for name in sorted({*TEMPLATES, *TEXTS})}
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def _words(text: bytes):
    return word_hashes(text.translate(_PLAIN))


def _fingerprints(hashes: np.ndarray):
    """Winnowed (hash, place) of a word sequence: the smaller of each two neighbouring run hashes."""
    runs = window_hashes(hashes, RUN)
    if len(runs) < WINDOW:
        return runs, np.arange(len(runs))
    least = _sliding_min(runs, WINDOW)
    chosen = np.zeros(len(runs), bool)
    for step in range(WINDOW):
        chosen[step : step + len(least)] |= runs[step : step + len(least)] == least
    return runs[chosen], np.flatnonzero(chosen)


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words, entries = [], [], []
        for name in sorted(templates):
            for text in templates[name]:
                words = _words(text.encode())[0]
                entries += [(h, len(self.names), p) for h, p in zip(*(x.tolist() for x in _fingerprints(words)))]
                self.names.append(name)
                self.words.append(words)
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], U64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(template, start in the text) by the diagonals of shared fingerprints."""
        found, places = _fingerprints(hashes)
        lo, hi = (np.searchsorted(self.hashes, found, side) for side in ("left", "right"))
        out = set()
        for i in np.flatnonzero(hi > lo):
            for e in range(lo[i], hi[i]):
                out.add((int(self.template[e]), int(places[i] - self.place[e])))
        return out


def align(template: np.ndarray, text: np.ndarray, start: int, band: int = BAND):
    """(matched words, first, last) of the best alignment of a template near a diagonal, or None.

    The template is aligned from end to end, the text freely at both ends; a match scores 2, a
    mismatch or a gap -1; only cells within ``band`` of the diagonal are visited.
    """
    lo, hi = max(0, start), start + len(template)
    if start >= 0 and hi <= len(text) and (text[lo:hi] == template).all():
        return len(template), lo, hi - 1
    width = 2 * band + 1
    none = (-(10**9), 0, -1, -1)
    before = [(0, 0, -1, -1) if 0 <= start - band + d <= len(text) else none for d in range(width)]
    for i in range(len(template)):
        now = []
        for d in range(width):
            j = start + i - band + d
            best = none
            if 0 <= j < len(text) and before[d][0] > -(10**8):
                score, matched, first, last = before[d]
                same = text[j] == template[i]
                best = (score + (2 if same else -1), matched + bool(same), j if same and first < 0 else first, j if same else last)
            if d + 1 < width and before[d + 1][0] - 1 > best[0]:
                best = (before[d + 1][0] - 1, *before[d + 1][1:])
            if d and now[d - 1][0] - 1 > best[0]:
                best = (now[d - 1][0] - 1, *now[d - 1][1:])
            now.append(best)
        before = now
    score, matched, first, last = max(before, key=lambda x: (x[0], -x[2]))
    return (matched, first, last) if matched and score > -(10**8) else None


def matches(index: Index, hashes: np.ndarray, coverage: float) -> list[tuple]:
    """(template, matched words, first word, last word) of one text, without overlaps."""
    found = []
    for template, start in index.candidates(hashes):
        result = align(index.words[template], hashes, start)
        if result and result[0] >= coverage * len(index.words[template]):
            found.append((template, *result))
    found.sort(key=lambda m: (-m[1], -m[1] / len(index.words[m[0]]), m[2], m[0]))
    kept: list[tuple] = []
    taken = np.zeros(len(hashes), bool)
    for m in found:
        span = slice(m[2], m[3] + 1)
        if not taken[span].any():
            taken[span] = True
            kept.append(m)
    return kept


def _scanner(templates: dict[str, list[str]], coverage: float):
    def run(batches):
        import pyarrow as pa

        index = Index(templates)
        for whole in batches:
            for batch in slices(whole):
                raw = to_bytes(batch.column("text"))
                buffer = b"\n".join(raw)
                begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]).astype(np.int64)
                hashes, starts, ends = _words(buffer)
                offsets = np.searchsorted(starts, begin)
                # which texts hold a fingerprint at all, for the whole batch at once
                runs = window_hashes(hashes, RUN)
                hit = np.flatnonzero(np.isin(runs, index.hashes))
                docs = np.unique(np.searchsorted(offsets, hit, side="right") - 1)
                rows = []
                for i in docs.tolist():
                    a, b = offsets[i], offsets[i + 1]
                    for template, matched, first, last in matches(index, hashes[a:b], coverage):
                        x, y = int(starts[a + first] - begin[i]), int(ends[a + last] - begin[i])
                        chars = len(raw[i][:x].decode())
                        n = len(index.words[template])
                        rows.append((batch.column("doc_id")[i].as_py(), index.names[template], template, matched, n, matched / n, chars, chars + len(raw[i][x:y].decode())))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "license", "template", "matched_words", "template_words", "coverage", "span_start", "span_end"])

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] = LIBRARY, coverage: float = COVERAGE) -> DataFrame:
    """One row for each match: doc_id, license, template, matched_words, template_words, coverage, span (code points)."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(_scanner(templates, coverage), "doc_id long, license string, template long, matched_words long, template_words long, coverage double, span_start long, span_end long")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
