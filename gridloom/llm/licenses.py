"""License scans by patience alignment.

Words are runs of letters and digits, lower-cased.  Where a document shares
three-word seeds with a license template, the words around the seeds are aligned
with the template: words that occur once in both are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between anchors are
aligned in the same way; a gap without anchors takes its common first and last
words.  Coverage is the share of the template's words that are matched.  Groups of
seeds in the template's order with foreign text between them (a page header, a list
of files; up to twice the template's length) are also aligned together, without it.

One pass over all texts, no shuffle; templates are a small fixed table in the
code or a parameter.  The table holds notices and short texts; long license texts
can be given as templates.  Null and empty texts hold no license, very long ones are
read whole; a template found at several places of a text gives a row for each, of
overlapping places the one with most matched words, then the best covered; repeated
rows give repeated results, a null ``doc_id`` stays null, and an empty table gives an
empty result.  Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.decontamination import Finder, block_of
from gridloom.llm.textops import words

#: Notices and texts of public licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
}
FOUND = "doc_id long, license string, template int, coverage double, matched int, word_start int, word_end int"


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two word sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {w: p for p, w in enumerate(b[k:m], k) if cb[w] == 1}
        both = [(p, at[w]) for p, w in enumerate(a[i:j], i) if ca[w] == 1 and w in at]
        anchors = [both[x] for x in longest_increasing([q for _, q in both])]
        if anchors:
            out += anchors
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def license_texts(templates: dict = TEMPLATES) -> tuple[list[tuple[str, int]], list[tuple[int, bytes]]]:
    """Names of all templates, and their word hashes."""
    names = [(spdx, k) for spdx, texts in templates.items() for k in range(len(texts))]
    texts = pa.array([t for texts in templates.values() for t in texts], pa.string())
    lists = [w.hash[w.first[k] : w.first[k + 1]].tobytes() for w in words(texts, marks=False) for k in range(w.hi - w.lo)]
    return names, list(enumerate(lists))


def _chains(parts: list[tuple[int, int, int, int]], size: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Runs of several parts ``(from, to, template from, template to)`` in the order of document and template.

    The runs that cover most of the template come first, and a part is in one run.  Parts are at most twice
    the template's ``size`` apart; templates of under 20 words and parts of a tenth of one are not joined.
    """
    parts = sorted(p for p in parts if p[3] - p[2] >= max(4, size // 10)) if size >= 20 else []
    best: list[tuple[int, int]] = []
    for i, (lo, _, a, z) in enumerate(parts):
        found = (z - a, -1)
        for j in range(i - 1, -1, -1):
            if lo - parts[j][0] > 4 * size:
                break
            gain = z - max(a, parts[j][3])
            if lo - 2 * size <= parts[j][1] <= lo and parts[j][2] < a and best[j][0] + gain > found[0]:
                found = best[j][0] + gain, j
        best.append(found)
    used: set[int] = set()
    for i in sorted(range(len(parts)), key=lambda k: (-best[k][0], k)):
        if 2 * best[i][0] < size:
            break
        chain, k = [], i
        while k >= 0 and k not in used:
            chain.append(k)
            k = best[k][1]
        used.update(chain)
        if len(chain) > 1:
            yield [parts[k] for k in chain[::-1]]


def _around(chain: list[tuple[int, int, int, int]], size: int) -> np.ndarray:
    """Word positions of the parts and of as many words around them as the template has there."""
    at, done = [], 0
    for k, (lo, hi, a, z) in enumerate(chain):
        before = max(0, a - (chain[k - 1][3] if k else 0))
        after = max(0, chain[k + 1][2] - z) if k + 1 < len(chain) else 8
        at.append(np.arange(max(done, lo - before - 2), min(size, hi + after + 2)))
        done = at[-1][-1] + 1 if len(at[-1]) else done
    return np.concatenate(at)


def _keep(taken: dict[int, list], r: int, i: int, template: np.ndarray, doc: np.ndarray, at: np.ndarray, threshold: float) -> None:
    """Note the place if the document's words at ``at`` cover the template."""
    pairs = patience(template.tolist(), doc[at].tolist())
    if pairs and len(pairs) >= threshold * len(template):
        taken.setdefault(r, []).append((-len(pairs), -len(pairs) / len(template), i, int(at[pairs[0][1]]), int(at[pairs[-1][1]]) + 1))


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """A row for each place where a template is covered by at least ``threshold``."""
    names, items = license_texts(templates)
    block = block_of(items, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block)
        ends = np.append(finder.first, len(block.keys))
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            for w in words(b.column(1), marks=False):
                rows = np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1
                at, which = finder.hits(w.hash, rows)
                if not len(at):
                    continue
                many = ends[which + 1] - ends[which]
                seed = np.repeat(ends[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                at = np.repeat(at, many)
                row, item, place = rows[at], block.owner[seed], block.place[seed]
                at = at - w.first[row]
                shift = at - place
                order = np.lexsort((shift, item, row))
                row, item, shift, at, place = row[order], item[order], shift[order], at[order], place[order]
                sizes = np.array([len(x) for x in block.words])
                taken: dict[int, list] = {}
                far = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(shift) > np.maximum(4, sizes[item[1:]] // 4))
                parts: dict[tuple[int, int], list] = {}
                for group in np.split(np.arange(len(row)), np.flatnonzero(far) + 1):
                    r, i = int(row[group[0]]), int(item[group[0]])
                    doc, size = w.hash[w.first[r] : w.first[r + 1]], int(sizes[i])
                    slack = max(2, size // 4)
                    span = range(max(0, int(shift[group[0]]) - slack), min(len(doc), int(shift[group[-1]]) + size + slack))
                    _keep(taken, r, i, block.words[i], doc, np.arange(span.start, span.stop), threshold)
                    parts.setdefault((r, i), []).append((int(at[group].min()), int(at[group].max()) + n, int(place[group].min()), int(place[group].max()) + n))
                for (r, i), found_parts in parts.items():
                    doc = w.hash[w.first[r] : w.first[r + 1]]
                    for chain in _chains(found_parts, int(sizes[i])):
                        _keep(taken, r, i, block.words[i], doc, _around(chain, len(doc)), threshold)
                for r, places in sorted(taken.items()):
                    kept: list[tuple] = []
                    for matched, coverage, i, a, z in sorted(places):  # of overlapping places the one with most words
                        if all(z <= c or d <= a for c, d in kept):
                            kept.append((a, z))
                            found.append((ids[w.lo + r], *names[i], -coverage, -matched, a, z))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*found) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
