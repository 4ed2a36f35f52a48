"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into words and winnowed: of every few successive runs of words the one
with the smallest hash is kept. These fingerprints form an inverted index to (template,
place). Every run of words of a document is looked up in it (so any copied stretch as long
as a window is found, whatever surrounds it); hits of one template that lie near each other
make a candidate region, and banded local alignments of region and template yield pieces:
matched words with their places in both. Pieces of one template that follow each other in
its order are joined, so that an insertion longer than the band splits a match into several
spans but takes nothing from its coverage. SPDX tags are read as they are.

The index is as large as the templates, which the caller passes; documents stay where they
are, so a line that a third of all documents share costs each of them its own alignment.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = re.compile(r"\w+(?:[.-]\w+)*")

SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(*[A-Za-z0-9.+-]+(?:[ \t)(]+(?:OR|AND|WITH)[ \t(]+[A-Za-z0-9.+-]+)*")
SPDX_ID = re.compile(r"[A-Za-z0-9.+-]+")

MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_REST = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ZERO_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = BSD_TWO + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
CC_NAMES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def lines(name: str) -> tuple[str, ...]:
    return f"Released under the {name} License.", f"Licensed under the {name} License."


def gnu(kind: str, version: str) -> tuple[str, ...]:
    """One-liners and the notice of a GNU license."""
    name = f"GNU {kind}General Public License"
    notice = GPL_NOTICE.replace("GNU General Public License", name).replace("version 3", f"version {version}")
    if kind == "Lesser " and version == "2.1":
        notice = notice.replace("This program", "This library")
    return f"This work is licensed under the {name}, version {version}.", f"Licensed under the {name} v{version}.", notice


# License lines, notices and full texts by SPDX identifier, short forms first.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "0BSD": (*lines("0BSD"), f"{ZERO_GRANT} {ISC_REST}"),
    "AGPL-3.0": gnu("Affero ", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache License, Version 2.0.",
    ),
    "BSD-2-Clause": (*lines("BSD 2-Clause"), BSD_TWO, f"{BSD_TWO} {BSD_REST}"),
    "BSL-1.0": (*lines("Boost Software"), BOOST),
    "Unlicense": (UNLICENSE,),
    "Zlib": (*lines("zlib"), ZLIB),
    "BSD-3-Clause": (BSD_THREE, *lines("BSD 3-Clause"), f"{BSD_THREE} {BSD_REST}"),
    "GPL-2.0": gnu("", "2"),
    "GPL-3.0": gnu("", "3"),
    "ISC": (ISC_GRANT, *lines("ISC"), f"{ISC_GRANT} {ISC_REST}"),
    "LGPL-2.1": gnu("Lesser ", "2.1"),
    "LGPL-3.0": gnu("Lesser ", "3"),
    "MIT": (lines("MIT")[0], MIT_GRANT, lines("MIT")[1], f"{MIT_GRANT} {MIT_REST}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."),
} | {
    f"CC-{short}-{v}": (f"This work is licensed under a Creative Commons {name} {v} {port} License.", f"Licensed under CC {short} {v}.")
    for short, name in CC_NAMES.items()
    for v, port in CC_PORTS.items()
}

#: Words that name a license: a one-liner without its name's words is another license's.
NAMING = frozenset(
    w.lower() for w in ("0BSD", "Affero", "Apache", "Boost", "BSD", "2-Clause", "3-Clause", "GNU", "ISC", "Lesser", "MIT", "Mozilla", "zlib", *CC_NAMES, *CC_NAMES.values())
)


@dataclass(frozen=True)
class Settings:
    """run words make a fingerprint, the smallest of window ones is kept; coverage is the least share of a template reported.

    Pieces of a template of `joined` words or more are joined over at most `reach` other words.
    """

    run: int = 3
    window: int = 2
    coverage: float = 0.7
    band: int = 8
    joined: int = 20
    reach: int = 1000


def words_at(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words with their start and end in code points."""
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def runs(ids: np.ndarray, run: int, base: int) -> np.ndarray:
    """Hash of every run of words; exact as long as base ** run fits 64 bits, as ids are below base."""
    key = np.zeros(max(0, len(ids) - run + 1), dtype=np.uint64)
    for i in range(run):
        key = key * np.uint64(base) + ids[i : i + len(key)].astype(np.uint64)
    return mixed(key)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of every window."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    window = min(window, len(hashes))
    kept = {max(range(i, i + window), key=lambda j: (-int(hashes[j]), j)) for i in range(len(hashes) - window + 1)}
    return np.array(sorted(kept), dtype=np.int64)


class Index:
    """The inverted index of the templates: sorted hashes with template and place."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], s: Settings):
        self.settings = s
        self.names = [(name, part) for name, texts in templates.items() for part in range(len(texts))]
        cut = [words_at(texts[part])[0] for name, texts in templates.items() for part in range(len(texts))]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for words in cut for w in words}))}
        self.base = len(self.vocabulary) + 1
        self.naming = [frozenset(self.vocabulary[w] for w in words if w in NAMING) if len(words) < s.joined else frozenset() for words in cut]
        self.ids = [np.array([self.vocabulary[w] for w in words], dtype=np.int64) for words in cut]
        rows = []
        for t, ids in enumerate(self.ids):
            hashes = runs(ids, s.run, self.base)
            rows += [(int(hashes[p]), t, int(p)) for p in winnow(hashes, s.window)]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        self.template = np.array([r[1] for r in rows], dtype=np.int64)
        self.place = np.array([r[2] for r in rows], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document place, template and template place of every shared fingerprint."""
        known = np.flatnonzero(ids > 0)
        if len(known) < self.settings.run:
            return (np.empty(0, np.int64),) * 3
        hashes = runs(ids, self.settings.run, self.base)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        at = np.repeat(np.arange(len(hashes)), n)
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at, self.template[entry], self.place[entry]


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of words a with b whose diagonals lie within band of shift: matched words, first and end in a."""
    return aligned(a, b, shift, band)[:3]


def aligned(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int, int]:
    """As align, then first and end in b.

    A match scores 2, a mismatch or gap -1; ties go to the earliest end. Steps are 0 for a
    match, so a path's matched words are counted beside its score.
    """
    best = (0, 0, 0, 0, 0, 0)  # score, matched, first and end in a, first and end in b
    before: dict[int, tuple[int, int, int, int]] = {}
    for j in range(len(b)):
        row: dict[int, tuple[int, int, int, int]] = {}
        for i in range(max(0, j + shift - band), min(len(a), j + shift + band + 1)):
            s, m, f, g = before.get(i - 1, (0, 0, i, j))
            same = a[i] == b[j]
            cell = (s + 2, m + 1, f, g) if same else (s - 1, m, f, g)
            for s, m, f, g in (before.get(i, (0, 0, i, j)), row.get(i - 1, (0, 0, i, j))):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f, g)
            if cell[0] > 0:
                row[i] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], i + 1, cell[3], j + 1)
        before = row
    return best[1:]


Piece = tuple[int, int, int, int, int]  # first and end in the document, first and end in the template, matched words


def pieces(ids: np.ndarray, b: np.ndarray, at: np.ndarray, place: np.ndarray, shift: int, band: int, run: int) -> Iterator[Piece]:
    """Alignments about one diagonal: the best one, then those of the hits before and after it."""
    todo = [(max(0, shift - band), min(len(ids), shift + len(b) + band + 1), 0, len(b))]
    near = np.abs(at - place - shift) <= band
    at, place = at[near], place[near]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if not ((at >= a0) & (at + run <= a1) & (place >= b0) & (place + run <= b1)).any():
            continue
        matched, f, e, g, h = aligned(ids[a0:a1], b[b0:b1], shift + b0 - a0, band)
        if not matched:
            continue
        yield a0 + f, a0 + e, b0 + g, b0 + h, matched
        todo += [(a0, a0 + f, b0, b0 + g), (a0 + e, a1, b0 + h, b1)]


def chained(found: list[Piece], reach: int) -> tuple[int, list[Piece]]:
    """Most words that pieces following each other in document and template match, and these; shared words count once."""
    best: list[tuple[int, int | None]] = []
    for j, (f, e, g, h, m) in enumerate(found):
        top: tuple[int, int | None] = (m, None)
        for i in range(j - 1, -1, -1):
            pf, pe, pg, ph, pm = found[i]
            twice = max(0, pe - f, ph - g)
            if pf < f and pe < e and pg < g and ph < h and twice < min(m, pm) and f - pe <= reach and best[i][0] + m - twice > top[0]:
                top = (best[i][0] + m - twice, i)
        best.append(top)
    at: int | None = max(range(len(best)), key=lambda k: (best[k][0], -k))
    total, chain = best[at][0], []
    while at is not None:
        chain.append(found[at])
        at = best[at][1]
    return total, chain[::-1]


def tagged(text: str) -> Iterator[tuple[str, int, int]]:
    """Identifier, start and end of every SPDX tag; the first of an expression has the tag in its span."""
    for tag in SPDX.finditer(text):
        first, at = tag.start(), text.index(":", tag.start()) + 1
        skip = False
        for m in SPDX_ID.finditer(text, at, tag.end()):
            if m[0] in ("OR", "AND", "WITH"):
                skip = m[0] == "WITH"
                continue
            if not skip:
                yield m[0], m.start() if first is None else first, m.end()
            first, skip = None, False


def found_in(text: str, index: Index) -> list[tuple[str, int, int, int, float, list[tuple[int, int]]]]:
    """license, start, end, matched words, coverage and spans of each match, by start; of overlapping ones the most matched stays."""
    tags = [(name, i, e, 2, 1.0, [(i, e)]) for name, i, e in tagged(text)] if "SPDX-License-Identifier:" in text else []
    return sorted(tags + template_matches(text, index), key=lambda x: x[1:3])


def template_matches(text: str, index: Index) -> list[tuple[str, int, int, int, float, list[tuple[int, int]]]]:
    s = index.settings
    words = [w.lower() for w in WORD.findall(text)]
    ids = np.fromiter(map(index.vocabulary.get, words, [0] * len(words)), dtype=np.int64, count=len(words))
    at, template, place = index.hits(ids)
    if not len(at):
        return []
    order = np.lexsort((at, template))
    at, template, place = at[order], template[order], place[order]
    size = np.array([len(x) for x in index.ids])[template]
    gap = np.where(size < s.joined, size + s.band, size + s.reach)
    new = np.append(True, (template[1:] != template[:-1]) | (at[1:] - at[:-1] > gap[1:]))
    out: list[tuple[int, list[Piece], int, float]] = []
    for first, last in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)), strict=True):
        t = int(template[first])
        b = index.ids[t]
        band = max(2, min(s.band, len(b) // 3))  # short templates may follow each other closely
        here, there = at[first:last], place[first:last]
        if len(b) < s.joined:
            for shift in regions(here - there, band):
                start = max(0, shift - band)
                matched, i, end, g, h = aligned(ids[start : shift + len(b) + band + 1], b, shift - start, band)
                if matched >= s.coverage * len(b) and index.naming[t] <= set(ids[start + i : start + end].tolist()):
                    out.append((matched, [(start + i, start + end, g, h, matched)], t, matched / len(b)))
            continue
        found = sorted({p for shift in regions(here - there, band) for p in pieces(ids, b, here, there, shift, band, s.run)})
        while found:
            matched, chain = chained(found, s.reach)
            if matched < s.coverage * len(b):
                break
            out.append((matched, chain, t, matched / len(b)))
            found = [p for p in found if p not in chain]
    if not out:
        return []
    _, begins, ends = words_at(text)
    kept: list[tuple[int, list[Piece], int, float]] = []
    taken: list[tuple[int, int]] = []  # pieces of kept matches, in order; none overlaps another match's
    for m in sorted(out, key=lambda x: (-x[0], -x[3], x[1][0][0], x[2])):
        if all(free(taken, p[0], p[1]) for p in m[1]):
            kept.append(m)
            for p in m[1]:
                insort(taken, (p[0], p[1]))
    matches = []
    for n, chain, t, c in kept:
        spans: list[tuple[int, int]] = []
        for f, e, *_ in chain:
            f = max(f, spans[-1][1]) if spans else f
            spans.append((f, e))
        at_chars = [(begins[f], ends[e - 1]) for f, e in spans]
        matches.append((index.names[t][0], at_chars[0][0], at_chars[-1][1], n, c, at_chars))
    return matches


def free(taken: list[tuple[int, int]], first: int, end: int) -> bool:
    """Whether nothing taken, of which nothing holds another, overlaps first:end."""
    i = bisect_left(taken, (first, first))
    return (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= first)


def regions(shifts: np.ndarray, band: int) -> list[int]:
    """Diagonals, none further than the band from one of these, so that every hit lies in a region."""
    out: list[int] = []
    head = None
    for s in np.unique(shifts).tolist():
        if head is None or s - head > band:
            head = s
            out.append(s)
    return out


def templates_of(rows: DataFrame, license_col: str = "license", text_col: str = "text", most_chars: int = 100_000_000) -> dict[str, tuple[str, ...]]:
    """Templates from a table of license texts, for find_licenses; ValueError if they have more than most_chars code points, as every executor holds them.

    Rows without a license or a text are left out; several texts of a license stand in order.
    """
    known = rows.filter(F.col(license_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(license_col).cast("string").alias("license"), F.col(text_col).alias("text")).distinct()
    if (known.agg(F.sum(F.char_length("text"))).first()[0] or 0) > most_chars:
        raise ValueError(f"the license texts have more than {most_chars} code points")
    out: dict[str, tuple[str, ...]] = {}
    for r in known.orderBy("license", "text").collect():
        out[r["license"]] = (*out.get(r["license"], ()), r["text"])
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """id and matches, an array of (license, start, end, matched, coverage, spans), of every document.

    Spans are in code points, end exclusive; a match has several where other text is put
    in. Null and empty texts and texts without a match have an empty array. Repeated rows
    and null ids are rows of their own; an empty table gives an empty result; very long
    texts are scanned whole. templates_of() takes templates from a table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, settings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("license", "start", "end", "matched", "coverage", "spans")
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "matches": [[dict(zip(names, m, strict=True)) for m in found_in(t, index.value)] for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(
        run, f"id {kind}, matches array<struct<license:string,start:int,end:int,matched:int,coverage:double,spans:array<struct<start:int,end:int>>>>"
    )
