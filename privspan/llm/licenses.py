"""License scans: MinHash over overlapping windows retrieves templates, shingle containment decides.

For every length of template a text is cut into windows of that length that overlap by three
quarters. A band is one minimum over the hashes of a window's shingles; a template is a candidate
of a window that shares a band with it. If a window has at least half of its shingles in common
with a template, as one that holds a copy does, one of BANDS bands is shared with a probability
of at least 1 - 2^-BANDS. Candidates are verified by the exact share of the template's shingles
that stand together in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

SHINGLE, BANDS, CONTAINMENT = 5, 16, 0.8
#: Templates and words of theirs that one pass broadcasts (about 24 bytes a word); further ones take further passes.
MOST_TEMPLATES, MOST_WORDS = 5000, 1_000_000
WORDS = re.compile(r"[^\W_]+").findall

#: Whole short licenses, and statements and notices of longer ones. Whole long ones are in license_texts/.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

_rng = np.random.default_rng(BANDS)
_STEP = _rng.integers(1, 1 << 63, (SHINGLE,), dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (BANDS, 2), dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Hashes of a text's runs of SHINGLE words, from remembered hashes of its words."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        words = WORDS(text.lower())
        if len(words) < SHINGLE:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        new = set(words).difference(self.known)
        self.known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))) for w in new)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(h) - SHINGLE + 1
        with np.errstate(over="ignore"):
            out = sum(h[i : i + n] * _STEP[i] for i in range(SHINGLE))
            out ^= out >> np.uint64(32)
            return out * np.uint64(0xD6E8FEB86659FD93)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each shingle for each band."""
    with np.errstate(over="ignore"):
        h = (shingles[None] ^ _BAND[:, :1]) * _BAND[:, 1:]
        return h ^ (h >> np.uint64(33))


@dataclass
class Class:
    """Templates of about one length: the window, its stride, the templates of each band's minima,
    and the shingles that have those minima."""

    width: int
    stride: int
    minima: list[dict[int, list[int]]]
    least: np.ndarray
    templates: list[tuple[str | tuple[str, int], np.ndarray]]


def shipped_templates(spark: SparkSession) -> DataFrame:
    """license_id, text: the templates that come with the package."""
    whole = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return spark.createDataFrame(sorted((TEMPLATES | whole).items()), "license_id string, text string")


def _passes(templates: DataFrame) -> Iterator[dict[tuple[str, int], str]]:
    """The templates in parts that may be broadcast, by id and number; the driver holds one of them."""
    held, words = {}, 0
    named = templates.select(F.col("license_id").cast("string"), "text").where("license_id is not null and text is not null")
    for i, (name, text) in enumerate(named.orderBy("license_id", "text").toLocalIterator()):
        n = len(WORDS(text.lower()))
        if n < SHINGLE:
            continue
        if held and (len(held) >= MOST_TEMPLATES or words + n > MOST_WORDS):
            yield held
            held, words = {}, 0
        held[name, i] = text
        words += n
    yield held


def classes(templates: dict[str, str] | dict[tuple[str, int], str]) -> list[Class]:
    shingler, by = Shingler(), {}
    for name in sorted(templates):
        s = shingler(templates[name])
        if not len(s):
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
        by.setdefault(round(np.log(len(s)) / np.log(1.25)), []).append((name, s))
    out = []
    for found in by.values():
        width = max(len(s) for _, s in found)
        minima: list[dict[int, list[int]]] = [{} for _ in range(BANDS)]
        least = []
        for i, (_, shingles) in enumerate(found):
            bands = _bands(shingles)
            least.append(shingles[bands.argmin(1)])
            for b, value in enumerate(bands.min(1).tolist()):
                minima[b].setdefault(value, []).append(i)
        out.append(Class(width, max(width // 4, 1), minima, np.unique(np.concatenate(least)), [(n, np.unique(x)) for n, x in found]))
    return out


def containment(shingles: np.ndarray, template: np.ndarray, start: int, of: Class) -> float:
    """Share of the template's distinct shingles in the window and a stride on either side."""
    part = shingles[max(start - of.stride, 0) : start + of.width + of.stride]
    return len(np.intersect1d(part, template)) / len(template)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def candidates(shingles: np.ndarray, of: Class) -> list[tuple[int, int]]:
    """(window's start, template) wherever they share a band.

    A window can only share a minimum of a template if it holds the shingle that has it, so the
    minima of windows without any such shingle need not be looked at.
    """
    holds = np.nonzero(_among(shingles, of.least))[0]
    if not len(holds):
        return []
    width = min(of.width, len(shingles))
    starts = np.unique(np.append(np.arange(0, len(shingles) - width + 1, of.stride), len(shingles) - width))
    starts = starts[np.searchsorted(holds, starts + width) > np.searchsorted(holds, starts)]
    out = []
    for start in starts.tolist():
        least = _bands(shingles[start : start + width]).min(1).tolist()
        out += [(start, i) for i in sorted({i for b, value in enumerate(least) for i in of.minima[b].get(value, ())})]
    return out


def scan(shingles: np.ndarray, of: list[Class]) -> dict:
    """By template: the largest containment and the first shingle of the first window that has it."""
    best: dict = {}
    if not len(of) or not _among(shingles, np.sort(np.concatenate([c.least for c in of]))).any():
        return best
    for c in of:
        for start, i in candidates(shingles, c):
            name, template = c.templates[i]
            share = containment(shingles, template, start, c)
            if share >= CONTAINMENT and (name not in best or (-share, start) < (-best[name][0], best[name][1])):
                best[name] = (share, start)
    return best


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id, containment, first_word: a row for each template found in each row of docs.

    templates: license_id, text; by default those that come with the package. Words are runs of
    letters and digits in lower case; first_word is where the window with the largest containment
    starts, the first of equal ones. Whole texts are scanned without a shuffle, once for each
    part of the templates that may be broadcast. Texts that are null, empty or of fewer than
    SHINGLE words hold no template; repeated rows give repeated results; an empty table of
    documents or templates gives no rows; other columns are not looked at. Templates whose id or
    text is null, or whose text has fewer than SHINGLE words, are left out. Templates are told
    apart by row: two texts of one id are both looked for, and each that is found gives a row.
    """
    templates = shipped_templates(docs.sparkSession) if templates is None else templates
    found: list[DataFrame] = []
    for part in _passes(templates):
        if found:
            # Earlier results are written, so that their templates need not stay in memory.
            found = [materialize(found[-1], "licenses"), *found[:-1]]
        found.append(_scan(docs, part))
    return reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, templates: dict[tuple[str, int], str]) -> DataFrame:
    of = docs.sparkSession.sparkContext.broadcast(classes(templates))

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for (name, _), (share, start) in sorted(scan(shingler(text or ""), of.value).items()):
                    rows.append(i)
                    out.append((name, share, start))
            name, share, start = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "license_id": pa.array(name, pa.string()),
                    "containment": pa.array(share, pa.float64()), "first_word": pa.array(start, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license_id string, containment double, first_word long")


def op9_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
