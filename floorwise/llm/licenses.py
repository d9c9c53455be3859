"""License scans: MinHash bands over overlapping windows, verified by exact containment.

Texts and templates become shingles of five words. For each size class s (the power of two
at or above a template's number of shingles, 4 at least) windows of 2s shingles overlap by
half, so a passage of a template lies whole in one of them. A window and a template of its
class meet if they agree in at least one band of one row; with ``BANDS`` bands, or as many more as a lower
containment needs (``bands_for``), windows that hold a template's shingles at the least Jaccard index possible
for a match (``least_jaccard``) meet with a probability of over 0.999. Candidates are verified by
the exact share of the template's shingles in the window.

Windows are aligned to their document and end with it, so results do not depend on batches. Word hashes are
only used to find candidates; containment compares the words themselves.

Defined results: a null or empty text has no match; a text or template of under five words
is one shingle; a license counts once for a document, with its best window, the first of equal
ones; texts of any length are scanned whole; repeated rows are scanned alike; an empty table
stays empty; a column of the output's name gives way to it, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from floorwise.llm.decontam import original_offsets, words_of
from floorwise.llm.shared import slices

SHINGLE, CONTAINMENT, BANDS, LEAST_CLASS = 5, 0.8, 64, 4

#: Notices by which public licenses are declared, and the short licenses' own texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def shingles_of(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def size_class(shingles: int) -> int:
    s = LEAST_CLASS
    while s < shingles:
        s *= 2
    return s


def least_jaccard(shingles: int, containment: float = CONTAINMENT) -> float:
    """Of a template and a window of 2s distinct shingles that holds just enough of it."""
    shared = int(np.ceil(containment * shingles))
    return shared / (2 * size_class(shingles) + shingles - shared)


def bands_for(templates: dict[str, str], containment: float = CONTAINMENT, miss: float = 0.001) -> int:
    """So many bands that a match of any template meets it but for a probability of ``miss``; ``BANDS`` at least."""
    sizes = {len(set(shingles_of(words_of(t)))) for t in templates.values() if words_of(t)}
    least = min((least_jaccard(n, containment) for n in sizes), default=1.0)
    return max(BANDS, int(np.ceil(np.log(miss) / np.log1p(-least))) if least < 1 else 1)


class Index:
    """MinHash values of templates by size class and band."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.factors = random.integers(1, 1 << 32, bands, dtype=np.uint32) | np.uint32(1)
        self.addends = random.integers(0, 1 << 32, bands, dtype=np.uint32)
        self.words = random.integers(1, 1 << 32, SHINGLE, dtype=np.uint32) | np.uint32(1)
        self.templates = {name: frozenset(shingles_of(words_of(text))) for name, text in templates.items() if words_of(text)}
        self.by_class: dict[int, list[str]] = {}
        for name, shingles in self.templates.items():
            self.by_class.setdefault(size_class(len(shingles)), []).append(name)
        self.largest = max(self.by_class, default=LEAST_CLASS)
        self.values: dict[int, list[dict[int, list[str]]]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for s, names in self.by_class.items():
            tables: list[dict[int, list[str]]] = [{} for _ in range(bands)]
            bits = np.zeros((bands, 1 << 16), dtype=bool)
            for name in names:
                own = self.hashes(words_of(templates[name]))
                for band in range(bands):
                    low = int(self.permuted(own, band).min())
                    tables[band].setdefault(low, []).append(name)
                    bits[band, low & 0xFFFF] = True
            self.values[s], self.filters[s] = tables, bits

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A 32-bit hash of each shingle."""
        from xxhash import xxh32_intdigest

        each = np.fromiter(map(xxh32_intdigest, words), dtype=np.uint32, count=len(words))
        n = max(1, len(words) - SHINGLE + 1)
        mixed = np.zeros(n, dtype=np.uint32)
        for k in range(SHINGLE):
            part = each[k : k + n]
            mixed[: len(part)] += (part ^ (part >> np.uint32(15))) * self.words[k]
        mixed ^= mixed >> np.uint32(16)
        mixed *= np.uint32(0x85EBCA6B)
        return mixed ^ (mixed >> np.uint32(13))

    def permuted(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return hashes * self.factors[band] + self.addends[band]

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, str]]:
        """(class, number of the window, template) that agree in a band; documents, which end at ``ends``, are padded to the largest class."""
        found: set[tuple[int, int, str]] = set()
        for band in range(len(self.factors)):
            lows = self.permuted(hashes, band).reshape(-1, LEAST_CLASS).min(axis=1)
            s = LEAST_CLASS
            while True:
                if s in self.by_class:
                    windows = lows.copy()
                    np.minimum(windows[:-1], lows[1:], out=windows[:-1])
                    last = ends // s - 1
                    windows[last] = lows[last]  # the next document is no part of a window
                    table = self.values[s][band]
                    for w in np.flatnonzero(self.filters[s][band][windows & np.uint32(0xFFFF)]).tolist():
                        for name in table.get(int(windows[w]), ()):
                            found.add((s, w, name))
                if s >= self.largest:
                    break
                lows, s = lows.reshape(-1, 2).min(axis=1), 2 * s
        return found

    def scan(self, texts: list[str | None], containment: float = CONTAINMENT) -> list[dict[str, tuple[float, int, int]]]:
        """For each text the licenses found, with share, first word and end of the best window."""
        documents = [words_of(t) for t in texts]
        parts, firsts, at = [], [], 0
        for words in documents:
            firsts.append(at)
            if words:
                own = self.hashes(words)
                padded = np.resize(own, -(-len(own) // self.largest) * self.largest)  # repeats of the own shingles
                parts.append(padded)
                at += len(padded)
        found: list[dict] = [{} for _ in texts]
        if not parts:
            return found
        starts = np.array(firsts)
        ends = np.cumsum([len(p) for p in parts])
        for s, window, name in sorted(self.candidates(np.concatenate(parts), ends)):
            place = window * s
            doc = int(np.searchsorted(starts, place, side="right")) - 1
            words, low = documents[doc], place - firsts[doc]
            n = max(1, len(words) - SHINGLE + 1)
            if not words or low >= n:
                continue
            high = min(low + 2 * s, n)
            template = self.templates[name]
            share = len(template.intersection(shingles_of(words[low : high + SHINGLE - 1]))) / len(template)
            if share >= containment and share > found[doc].get(name, (0.0,))[0]:
                found[doc][name] = (share, low, min(high + SHINGLE - 1, len(words)))
        return found


MATCHES = T.ArrayType(
    T.StructType([T.StructField("license", T.StringType(), False), T.StructField("containment", T.DoubleType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False
)
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, text: str = "text", out: str = "licenses", keep_text: bool = False) -> DataFrame:
    """Add ``out``: licenses by name, each with its containment and the byte offsets of its window."""
    known = TEMPLATES if templates is None else templates
    if sum(map(len, known.values())) > 64 << 20:
        raise ValueError("templates of over 64 MB are not sent to executors; scan them in parts")
    shared = docs.sparkSession.sparkContext.broadcast(known)
    bands = bands_for(known, containment)
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower() and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, bands)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, end in slices(texts, 2 << 20):
                rows = []
                for value, found in zip(texts[start:end], index.scan(texts[start:end], containment)):
                    row = []
                    for name in sorted(found):
                        share, low, high = found[name]
                        (first, last), = original_offsets(value, [(low, high)])
                        row.append({"license": name, "containment": share, "start": first, "end": last})
                    rows.append(row)
                few = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in names), pa.array(rows, _ARROW)], [*names, out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, MATCHES, False)]))
