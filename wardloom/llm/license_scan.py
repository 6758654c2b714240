"""Licence scans: where a text holds something close to a licence template, by the Dice coefficient of word bigrams.

Texts and templates are normalised (A-Z to lower case, ASCII punctuation to spaces). For a template of m distinct bigrams and
a least coefficient t, a window can only match if it has between m t / (2 - t) and m (2 - t) / t bigrams; these bounds, and
the number of the template's bigrams that must then stand close together, prune templates and places before any window is
compared. Every window that begins and ends at a bigram of the template and is within the bounds is compared.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, hash_words, trimmed, windows
from .decontaminate import plain_words

# Short licences and notices of common licences, as published. Whole texts of longer ones are given by parameter.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause-short": "Licensed under the BSD 3-Clause License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "boost-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published from the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(text: bytes | None) -> np.ndarray:
    """Hashes of a text's word bigrams in order; none with fewer than two words."""
    h = hash_words(plain_words(text))
    return windows(h, 2) if len(h) > 1 else np.empty(0, np.uint64)


class Template:
    def __init__(self, name: str, text: str, least: float) -> None:
        self.name, self.grams = name, np.unique(bigrams(text.encode()))
        m = len(self.grams)
        self.low = math.ceil(m * least / (2 - least) - 1e-9)
        self.high = math.floor(m * (2 - least) / least + 1e-9)
        self.need = math.ceil(least * (m + self.low) / 2 - 1e-9)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.templates = [t for t in (Template(n, x, least) for n, x in templates.items()) if len(t.grams)]
        self.every = np.unique(np.concatenate([t.grams for t in self.templates])) if self.templates else np.empty(0, np.uint64)

    def matches(self, grams: np.ndarray) -> list[tuple[float, int, int, str]]:
        """(coefficient, first bigram, length, template) of the best windows, none overlapping another.

        What shares most goes first, so that a short notice inside a long one doesn't win; a queue holds the best window of each
        place where one may begin. A place whose window has since been cut off looks for its next best before that.
        """
        if not len(grams) or not len(self.every):
            return []
        at = np.searchsorted(self.every, grams)
        at[at == len(self.every)] = 0
        hits = np.flatnonzero(self.every[at] == grams)
        if not len(hits):
            return []
        earlier, queue = None, []
        for t in self.templates:
            if len(hits) < t.need or len(grams) < t.low:
                continue
            at = np.searchsorted(t.grams, grams[hits])
            at[at == len(t.grams)] = 0
            p = hits[t.grams[at] == grams[hits]]
            if len(p) < t.need:
                continue
            # a run of `need` hits that spans more than the largest window can't match
            begins = p[np.flatnonzero(p[t.need - 1 :] - p[: len(p) - t.need + 1] < t.high)] if t.need > 0 else p
            if len(begins) and earlier is None:
                earlier = _earlier(grams)
            mine = np.zeros(len(grams), bool)
            mine[p] = True
            for start in begins.tolist():
                if window := self._best(t, mine, earlier, start, len(grams) + 1):
                    queue.append((*window, t, mine))
        heapify(queue)
        taken: list[tuple[int, int]] = []  # in order, none touching another, so only the neighbours of a window matter
        best = []
        while queue:
            shared, dice, length, start, name, t, mine = heappop(queue)
            i = bisect_left(taken, (start, start))
            if (i and taken[i - 1][1] >= start) or (i < len(taken) and taken[i][0] == start):
                continue
            limit = taken[i][0] if i < len(taken) else len(grams) + 1
            if start - length < limit:
                taken.insert(i, (start, start - length))
                best.append((-dice, start, -length, name))
            elif window := self._best(t, mine, earlier, start, limit):
                heappush(queue, (*window, t, mine))
        return sorted(best, key=lambda m: m[1])

    def _best(self, t: Template, mine: np.ndarray, earlier: np.ndarray, start: int, limit: int) -> tuple[int, float, int, int, str] | None:
        """(-shared, -coefficient, -length, start, name) of the best window of a template that begins at ``start``, ends at one of its
        bigrams and leaves a bigram free before ``limit``; None if no window matches. A bigram is new to a window if its
        last occurrence lies before it, so running counts tell what every end would give."""
        end = min(len(mine), start + t.high, limit - 1)
        if end - start < t.low:
            return None
        new, own = earlier[start:end] < start, mine[start:end]
        shared = np.cumsum(new & own)
        ends = np.flatnonzero(own[t.low - 1 :]) + t.low - 1
        dice = 2 * shared[ends] / (np.cumsum(new)[ends] + len(t.grams))
        fits = dice >= self.least - 1e-12
        if not fits.any():
            return None
        ends, dice = ends[fits], dice[fits]
        most = shared[ends] == shared[ends[-1]]  # counts rise from end to end
        ends, dice = ends[most], dice[most]
        last = np.flatnonzero(dice == dice.max())[-1]
        return -int(shared[ends[last]]), -float(dice[last]), -int(ends[last] + 1), start, t.name


def _earlier(grams: np.ndarray) -> np.ndarray:
    """Where each bigram stood last, or -1."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1)
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


ROWS = "doc_id long, license string, first_word long, n_words long, dice double"


def _scan(scanner):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("dice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), binary_column(b, "text"), strict=True):
                rows += [(doc, name, first, n + 1, dice) for dice, first, n, name in scanner.value.matches(bigrams(text))]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, first_word, n_words, dice): a row for each place in a document that matches a template.

    Of overlapping matches the one that shares most bigrams stays; ties go to the higher coefficient, then the longer, then
    the earlier, then the name first in the alphabet. Very long texts are scanned whole. Words are counted in the normalised text from 0. Null, empty and one-word texts give no
    rows, nor do templates of fewer than two words. Repeated rows are scanned one by one. Only doc_id and text are read.
    An empty table gives no rows.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, least))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_scan(scanner)), ROWS)
