"""License scans: winnowed fingerprints of templates pick candidates, banded alignment judges them.

Templates are public notices and short licence texts (TEMPLATES, or any mapping given). Hashes of K consecutive words
are winnowed: of every WINDOW neighbouring ones the smallest is kept. An inverted index maps them to
(template, position). Every hash of a document is looked up; the diagonals the finds fall on,
grouped within a band, are candidate places; there a banded alignment of the template's words
with the document's words reports how many template words match and which words of the document
they span. Places with a coverage of MINIMUM or more are reported, the best of those that overlap.

A template of SHORT words or fewer has all its hashes in the index, and one of fewer than K words a
hash of all of them. Words are [0-9a-z] and bytes beyond ASCII, A-Z in lower case.

Nulls and edges: null, empty or wordless texts give an empty list; a null doc_id is kept; repeated rows give repeated rows; an
empty table gives none; equal places go to the template that sorts first. Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import split_words
from .rows import ALNUM, LOWER, pieces, text_buffer, window_hashes, word_hashes, word_spans

K, WINDOW, BAND, MINIMUM, SHORT = 4, 4, 8, 0.7, 24
#: Candidate places of one template that are aligned side by side, at most.
SIDE_BY_SIDE = 1024
#: The notices by which public licences say a work may be given them, and common short forms.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-short": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the last smallest hash of every `window` neighbours; all of them where there are fewer."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


def align(template: np.ndarray, words: np.ndarray, shifts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shift the most template words (by number) matched in order by equal document words, over alignments whose
    diagonals (document word - template word) stay within `band` of it, and of these the tightest span, the first of equal
    ones: (matched, start, end). All shifts go through the rows of the table side by side."""
    n, width, count = len(template), 2 * band + 1, len(shifts)
    low = shifts - band
    column = np.arange(width)
    # A cell holds the best score and, of alignments with it, the latest first word (as the distance from `low`): score << 21 | first.
    cells, best = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
    end = (1 << 21) - 1
    for i in range(n):
        at = i + column
        where = low[:, None] + at
        inside = (where >= 0) & (where < len(words))
        equal = inside & (words[np.where(inside, where, 0)] == template[i])
        kept = cells.copy()
        kept[:, :-1] = np.maximum(kept[:, :-1], cells[:, 1:])  # a template word skipped, or both
        if equal.any():
            score, first = (cells >> 21) + 1, np.where(cells > 0, cells & end, at)
            kept = np.where(equal, np.maximum(kept, score << 21 | first), kept)
            # What ends here, by score, then span, then place: score << 42 | (end - span) << 21 | (end - last).
            here = np.where(equal, score << 42 | (end - (at - first)) << 21 | (end - at), 0)
            best = np.maximum(best, here.max(1))
        cells = np.maximum.accumulate(kept, 1)  # document words skipped
    last = end - (best & end)
    start = last - (end - (best >> 21 & end))
    return best >> 42, low + start, low + last + 1


class Templates:
    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [split_words(templates[name]) for name in self.names]
        self.number: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.ids = [np.array([self.number[w] for w in words], np.int64) for words in self.words]
        self.bands = [max(BAND, len(x) // 8) for x in self.ids]  # a long text may gain or lose more words
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))  # size of hash, hash, places
        for t, words in enumerate(self.words):
            size = min(K, len(words))
            if not size:
                continue
            raw = np.frombuffer(b" ".join(words), np.uint8)
            starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
            hashes = window_hashes(word_hashes(raw, starts, ends), size)
            for k in (np.arange(len(hashes)) if len(words) <= SHORT else winnow(hashes)).tolist():
                self.index[size][int(hashes[k])].append((t, k))
        self.index = {size: dict(own) for size, own in self.index.items()}
        self.known = {size: np.array(sorted(own), np.uint64) for size, own in self.index.items()}

    def find(self, column: pa.Array) -> list[list[dict]]:
        """The places of every text."""
        data, offsets = text_buffer(column)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for low, high in pieces(offsets):
            raw = LOWER[data[offsets[low] : offsets[high]]]
            starts, ends, doc_words = word_spans(raw, offsets[low : high + 1] - offsets[low], ALNUM)
            hashes = word_hashes(raw, starts, ends)
            seeds: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for size, known in self.known.items():
                window = window_hashes(hashes, size)
                if not len(window):
                    continue
                at = np.searchsorted(known, window)
                for k in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == window).tolist():
                    doc = int(np.searchsorted(doc_words, k, "right")) - 1
                    if k + size <= doc_words[doc + 1]:
                        for t, place in self.index[size][int(window[k])]:
                            seeds[doc].add((t, k - int(doc_words[doc]) - place))
            whole = raw.tobytes() if seeds else b""
            for doc, found in seeds.items():
                own = slice(doc_words[doc], doc_words[doc + 1])
                get = self.number.get
                words = np.array([get(whole[a:b], -1) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], np.int64)
                out[low + doc] = self._places(words, found)
        return out

    def _places(self, words: np.ndarray, seeds: set[tuple[int, int]]) -> list[dict]:
        exact: list[tuple[int, int]] = []
        banded: dict[int, list[int]] = defaultdict(list)
        for t, shift in sorted(seeds):
            n = len(self.ids[t])
            if banded[t] and shift - banded[t][-1] <= self.bands[t] // 2:  # the band around the last one takes this one in
                continue
            if shift >= 0 and np.array_equal(words[shift : shift + n], self.ids[t]):  # all on one diagonal: nothing to align
                exact.append((t, shift))
            else:
                banded[t].append(shift)
        found = [(t, len(self.ids[t]), shift, shift + len(self.ids[t])) for t, shift in exact]
        for t, shifts in banded.items():
            for k in range(0, len(shifts), SIDE_BY_SIDE):
                found += [(t, *x) for x in zip(*(x.tolist() for x in align(self.ids[t], words, np.array(shifts[k : k + SIDE_BY_SIDE]), self.bands[t])), strict=True)]
        places = [{"license": self.names[t], "matched": matched, "coverage": matched / len(self.ids[t]), "start": start, "end": end} for t, matched, start, end in found if matched >= MINIMUM * len(self.ids[t])]
        starts: list[int] = []
        kept: dict[int, dict] = {}
        for p in sorted(places, key=lambda p: (-p["matched"], -p["coverage"], p["end"] - p["start"], p["license"], p["start"])):
            k = bisect_right(starts, p["start"])
            if (not k or kept[starts[k - 1]]["end"] <= p["start"]) and (k == len(starts) or p["end"] <= starts[k]):
                starts.insert(k, p["start"])
                kept[p["start"]] = p
        return [kept[x] for x in starts]


_PLACE = pa.struct([("license", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, places): licence notices of every text, with matched template words, coverage and the span of words."""
    shipped = docs.sparkSession.sparkContext.broadcast(dict(templates))  # the size of the templates given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.find(batch.column(1)), pa.list_(_PLACE))], ["doc", "places"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(run, "doc long, places array<struct<license:string,matched:int,coverage:double,start:int,end:int>>").withColumnRenamed("doc", doc_id)


def op7_rows(docs: DataFrame) -> DataFrame:
    """One row a document: number of notices, their licences and spans as text, and the best coverage."""
    listed = lambda f: F.array_join(F.transform("places", f), ",")
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return scan(docs).select("doc_id", F.size("places").cast("long").alias("n_notices"), listed(lambda p: p["license"]).alias("licenses"), listed(lambda p: F.concat_ws(":", p["start"], p["end"])).alias("spans"), F.round(best, 6).alias("coverage"))
