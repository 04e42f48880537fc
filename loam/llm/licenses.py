"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are word sequences.  Hashes of k-grams are winnowed (of each
``window`` neighbouring ones the least is kept; Schleimer, Wilkerson and Aiken
2003), so any common run of k + window - 1 words shares a fingerprint.  An
inverted index from fingerprint to (template, place) gives each document's
candidates with the diagonal on which they lie; a local alignment in a band
around the diagonal counts matched words and reports the span.

The index is of the templates, a fixed list, and every task holds it.  One pass
over the texts, no shuffle.  ``TEMPLATES`` are notices and the texts of usual licenses,
long ones whole, from the files in ``templates``.

A run of fingerprints in the order of the template, within the band, is a candidate if it holds ``SHARE`` of the
template's fingerprints at least, so that phrases of a long license that other texts
use aren't aligned; where a template has ten or fewer, any one of them is.
A template is found where at least ``coverage`` of its words match.  Of finds
that overlap, the one with most matched words stays, then that of larger
coverage, then the first by name; so a longer notice wins over its parts.

Nulls: null and empty texts have no finds; a null doc_id is passed on.  Repeated
rows are each scanned.  Templates without words are left out.  A text of any
length is read whole, and a template may be found several times, copies side by side too.  Empty tables
give empty results.  Only doc_id and text are read; doc_ids are integers or can be cast to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

SHARE = 0.1
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
}
#: the whole texts: Apache-2.0, BSD-3-Clause, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0, CC0-1.0
TEMPLATES |= {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


def winnow(h: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """The places whose hash is the least of some window of valid ones that lie in one text."""
    n = len(h)
    if n < window:
        return np.flatnonzero(ok & (h == (h[ok].min() if ok.any() else 0)))
    views = np.lib.stride_tricks.sliding_window_view
    whole = views(ok, window).all(1)
    pick = np.arange(n - window + 1) + window - 1 - views(h, window)[:, ::-1].argmin(1)  # of equal ones the last
    places = np.unique(pick[whole])
    # a text with fewer k-grams than a window keeps its least
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    short = [lo + int(h[lo:hi].argmin()) for lo, hi in zip(edge[::2], edge[1::2]) if hi - lo < window]
    return np.union1d(places, np.array(short, np.int64)) if short else places


class Index:
    """Fingerprints of the templates in order, with their templates and places."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.k, self.window = k, window
        self.names = [n for n in sorted(templates) if len(K.hash_words(templates[n]))]
        self.words = [K.hash_words(templates[n]).tolist() for n in self.names]
        rows = []
        for t, w in enumerate(self.words):
            one = K.Words(np.array(w, K.U64), None, None, np.array([0, len(w)]))
            h, ok = one.ngrams(min(k, len(w)))
            rows += [(int(h[p]), t, int(p)) for p in winnow(h, ok, window)]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], K.U64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.votes = np.bincount(self.template, minlength=len(self.names))


def align(template: list[int], words: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first word, end) of the best local alignment within the band around a diagonal.

    A match gains 2, a mismatch or a gap loses 1."""
    width = 2 * band + 1
    none = (0, 0, -1, -1)  # score, matches, first, end
    before, best = [none] * width, none
    for i, t in enumerate(template):
        row = []
        for o in range(width):
            j = diagonal + i + o - band
            s = none
            if 0 <= j < len(words):
                d = before[o]
                if words[j] == t:
                    s = (d[0] + 2, d[1] + 1, d[2] if d[0] > 0 else j, j + 1)
                elif d[0] > 1:
                    s = (d[0] - 1, *d[1:])
            if o + 1 < width and before[o + 1][0] - 1 > s[0]:
                s = (before[o + 1][0] - 1, *before[o + 1][1:])
            if row and row[-1][0] - 1 > s[0]:
                s = (row[-1][0] - 1, *row[-1][1:])
            row.append(s)
            if s[0] > best[0]:
                best = s
        before = row
    return best[1], best[2], best[3]


def runs(hits: list[tuple[int, int]], size: int, band: int) -> list[tuple[int, int, int]]:
    """(least diagonal, greatest, votes) of the places at which a template of ``size`` words may stand, of hits (place in the text, in the template) in order.

    A hit goes on a run if it is later in both than the run's last, and at most ``band`` words off its
    diagonal and 4 bands off that of its first hit; so copies one after the other are runs of their own."""
    done, live = [], []
    for p, q in hits:
        d, best = p - q, None
        keep = []
        for run in live:
            # last place in the text, in the template, diagonal of the first and the last, least, greatest, votes
            if p - run[0] > size + band:
                done.append(run)
                continue
            keep.append(run)
            if q > run[1] and p > run[0] and abs(d - run[3]) <= band and abs(d - run[2]) <= 4 * band and (best is None or abs(d - run[3]) < abs(d - best[3])):
                best = run
        live = keep
        if best is None:
            live.append([p, q, d, d, d, d, 1])
        else:
            best[:] = [p, q, best[2], d, min(best[4], d), max(best[5], d), best[6] + 1]
    return [(r[4], r[5], r[6]) for r in done + live]


def scan_words(h: np.ndarray, grams: np.ndarray, places: np.ndarray, index: Index, coverage: float, band: int) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched, first word, end) of a text's finds, from its winnowed places."""
    prints = grams[places]
    lo, hi = np.searchsorted(index.prints, prints, "left"), np.searchsorted(index.prints, prints, "right")
    hits: dict[int, list[tuple[int, int]]] = {}
    for p, a, b in zip(places.tolist(), lo.tolist(), hi.tolist()):
        for r in range(a, b):
            hits.setdefault(int(index.template[r]), []).append((p, int(index.place[r])))
    found = []
    for t, pairs in hits.items():
        template = index.words[t]
        # narrower than the template, so that of copies side by side each is aligned by itself
        mine = max(2, min(band, len(template) // 2 - 1))
        for least, most, votes in runs(sorted(pairs), len(template), mine):
            if votes < math.floor(SHARE * index.votes[t]):
                continue
            wide = mine + (most - least + 1) // 2
            lo = max(0, least - mine)
            words = h[lo : most + len(template) + mine].tolist()
            n, first, end = align(template, words, (least + most) // 2 - lo, wide)
            if n >= coverage * len(template):
                found.append((t, n / len(template), n, lo + first, lo + end))
    found.sort(key=lambda x: (-x[2], -x[1], x[0], x[3]))
    kept: list = []
    for x in found:
        if all(x[4] <= y[3] or x[3] >= y[4] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, k: int = 3, window: int = 3, coverage: float = 0.8, band: int = 8) -> DataFrame:
    """(doc_id, license, coverage, matched, start_word, end_word, start_byte, end_byte) of each find."""
    index = Index(TEMPLATES if templates is None else templates, k, window)
    names = ["doc_id", "license", "coverage", "matched", "start_word", "end_word", "start_byte", "end_byte"]
    types = [pa.string(), pa.float64(), *[pa.int64()] * 5]
    sizes = sorted({min(k, len(w)) for w in index.words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, offs in K.chunks(b.column(1)):
                w = K.words(data, offs)
                out, todo = [], {}
                for n in sizes:
                    grams, ok = w.ngrams(n)
                    at = winnow(grams, ok, window)
                    at = at[np.isin(grams[at], index.prints)]
                    for d, p in zip((np.searchsorted(w.offsets, at, "right") - 1).tolist(), at.tolist()):
                        todo.setdefault((d, n), []).append(p)
                    for (d, m), places in [x for x in todo.items() if x[0][1] == n]:
                        lo, hi = int(w.offsets[d]), int(w.offsets[d + 1])
                        for t, c, hit, a, e in scan_words(w.hashes[lo:hi], grams[lo:hi], np.array(places) - lo, index, coverage, band):
                            out.append((row + d, index.names[t], c, hit, a, e, int(w.starts[lo + a] - offs[d]), int(w.ends[lo + e - 1] - offs[d])))
                if out:
                    r, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), *(pa.array(x, t) for x, t in zip(rest, types))], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return d.mapInArrow(run, "doc_id long, license string, coverage double, matched long, start_word long, end_word long, start_byte long, end_byte long")
