"""Operator 2, license scans.

Texts are cut into overlapping windows of words, one size per class of template
lengths: a window is twice as long as the class's longest template and starts
anew after half its length, so a passage as long as a template lies whole in
some window. Windows and templates are MinHash signatures of their five-word
shingles; a band is `ROWS` values, and a window retrieves the templates with
which it shares a band. A passage that holds the share `CONTAINMENT` of a
template's shingles has, against its window, a Jaccard similarity of at least
CONTAINMENT / (2 * RATIO + 1 - CONTAINMENT), where RATIO is the spread of template
lengths in a class; BANDS is chosen so that the chance of missing a band is
below `MISS`. Retrieved pairs are verified by exact shingle containment.

A window can only share a band if it holds the shingles that are the template's
least ones, so texts without any such shingle are done at once.

Templates are sent to the tasks in blocks of at most `TEMPLATES_MOST` rows. More
than one block means more than one pass over the texts; matches are then brought
together by row. A template shorter than a shingle is one shingle of its
own length; texts are hashed at these lengths too, and every place of the
shingle is a match.

Defined results: null and empty texts have no words and match nothing; a
template without words matches nothing; repeated rows are judged one by one;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, stored, table
from quarry.llm.decontaminate import _NORMAL
from quarry.llm.hashing import mix, word_hashes

WORDS, CONTAINMENT, RATIO, ROWS, MISS = 5, 0.8, 1.25, 2, 1e-6
TEMPLATES_MOST = 10_000
#: Notices by which works state their license, with its identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "licensed under the MIT license"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced"),
]

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole license texts.
FULL_TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]

#: Notices shorter than a shingle.
SHORT_TEMPLATES = [("Proprietary", "All rights reserved.")]


def bands_needed(rows: int = ROWS, miss: float = MISS) -> int:
    """Bands for which a passage at the limit is missed with a chance below `miss`."""
    least = CONTAINMENT / (2 * RATIO + 1 - CONTAINMENT)
    return math.ceil(math.log(miss) / math.log(1 - least**rows))


BANDS = bands_needed()
_SEEDS = np.random.RandomState(77).randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def words_of(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").translate(_NORMAL))


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words in text order; shingles of different sizes differ."""
    if not 0 < size <= len(words):
        return words[:0]
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k]
    return mix(out)


def shingle_sequence(text: bytes | None) -> tuple[int, np.ndarray]:
    """(number of words, hashes of five consecutive words in text order; of all words where there are fewer)."""
    words = words_of(text)
    return len(words), shingles_of(words, min(WORDS, len(words)))


def signature(grams: np.ndarray) -> np.ndarray:
    """Least value of each hash function over some shingles."""
    return np.array([mix(grams ^ s).min() for s in _SEEDS])


class Index:
    """Templates by length class and band."""

    def __init__(self, templates: list[tuple[str, bytes | None]]):
        self.names, self.sets, self.sizes = [], [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.bands: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
        self.window: dict[int, int] = {}
        least: dict[int, set[int]] = defaultdict(set)
        for name, text in templates:
            n, grams = shingle_sequence(text)
            if not len(grams):
                continue
            at, kind = len(self.names), int(math.log(len(grams), RATIO))
            self.names.append(name)
            self.sets.append(np.unique(grams))
            self.sizes.append(min(WORDS, n))
            if n < WORDS:
                self.short[n][int(grams[0])].append(at)
                continue
            self.window[kind] = 2 * math.ceil(RATIO ** (kind + 1))
            values = signature(grams)
            for band in range(BANDS):
                part = values[band * ROWS : (band + 1) * ROWS]
                self.bands[kind, band, part.tobytes()].append(at)
                least[kind].update(grams[[int(mix(grams ^ _SEEDS[band * ROWS]).argmin())]].tolist())
        self.least = {k: np.array(sorted(v), np.uint64) for k, v in least.items()}
        self.short_grams = {size: np.array(sorted(v), np.uint64) for size, v in self.short.items()}

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, shingles, containment) of the verified windows; the best of each template and place."""
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for size, known in self.short_grams.items():
            own = shingles_of(words, size)
            for at in np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own).tolist():
                found.update({(t, at): (1.0, at, 1) for t in self.short[size][int(own[at])]})
        grams = shingles_of(words, WORDS)
        for kind, least in self.least.items():
            hits = np.flatnonzero(least[np.minimum(np.searchsorted(least, grams), len(least) - 1)] == grams)
            if not len(hits):
                continue
            size, step = self.window[kind], self.window[kind] // 2
            starts = np.unique(np.concatenate([hits // step, np.maximum(hits // step - 1, 0)])) * step
            for start in starts.tolist():
                window = grams[start : start + size]
                values, own = signature(window), None
                near = {t for b in range(BANDS) for t in self.bands.get((kind, b, values[b * ROWS : (b + 1) * ROWS].tobytes()), ())}
                for t in sorted(near):
                    own = np.unique(window) if own is None else own
                    share = len(np.intersect1d(own, self.sets[t], assume_unique=True)) / len(self.sets[t])
                    if share >= CONTAINMENT:
                        inside = np.flatnonzero(np.isin(window, self.sets[t]))
                        first, last = start + int(inside[0]), start + int(inside[-1])
                        if (t, first) not in found or found[t, first][0] < share:
                            found[t, first] = (share, first, last - first + 1)
        return [(t, first, n, share) for (t, _), (share, first, n) in sorted(found.items())]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("licenses", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))),
    ]
)


_DDL = "doc_id long, n_words long, licenses array<string>, matches array<struct<license:string,first_word:long,n_words:long,containment:double>>"


def _blocks(templates: DataFrame | None, most: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Templates in blocks of about `most` rows at most, one at a time."""
    if templates is None:
        yield [(n, t.encode()) for n, t in TEMPLATES + FULL_TEMPLATES + SHORT_TEMPLATES]
        return
    rows = templates.select(F.col("license").cast("string").alias("license"), F.col("text").cast("binary").alias("body"))
    n = -(-rows.count() // most)
    if n > 1:
        rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("license", "body"), F.lit(n))), "license-templates")
    for k in range(max(1, n)):
        own = rows.where(F.col("block") == k) if n > 1 else rows
        yield [(r["license"], bytes(r["body"]) if r["body"] is not None else None) for r in own.collect()]


def _found(index: Index, words: np.ndarray) -> list[dict]:
    """Matches in the order of license and place."""
    rows = [{"license": index.names[t], "first_word": a, "n_words": k + index.sizes[t] - 1, "containment": c} for t, a, k, c in index.matches(words)]
    return sorted(rows, key=lambda r: (r["license"] or "", r["first_word"], r["n_words"], r["containment"]))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, *, most: int = TEMPLATES_MOST) -> DataFrame:
    """Per document: its words, the licenses found, and where. templates(license, text) replaces the built-in ones."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scanned(texts: DataFrame, block: list[tuple[str, bytes | None]], key: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        schema = pa.schema([(key, pa.int64()), *list(_SCHEMA)[1:]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                out = []
                for row, text in zip(batch.column(key).to_pylist(), as_bytes(batch.column("text")), strict=True):
                    words = words_of(text)
                    found = _found(index, words)
                    out.append({key: row, "n_words": len(words), "licenses": sorted({m["license"] or "" for m in found}), "matches": found})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

        return texts.mapInArrow(run, _DDL.replace("doc_id", key, 1))

    blocks = _blocks(templates, most)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scanned(docs, first, "doc_id")
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    parts = [stored(scanned(rows.select("row", "text"), block, "row"), "license-matches") for block in chain([first, second], blocks)]
    merged = reduce(DataFrame.union, parts).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("licenses")))).alias("licenses"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return rows.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "licenses", "matches")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), "matches")
