"""License scans by patience alignment.

Texts and templates are compared as lower-case words ``[a-z0-9]+``.  A template
is looked for around its signature words, words that make up more than the
share that a match may lack, so every match holds one.  Around each such word
lies a window of the template's length and some slack; in it, words unique to
both text and template are anchors, the longest increasing subsequence of the
anchors is kept, and the gaps between anchors are aligned in the same way (gaps
without unique words by a longest common subsequence).  The aligned share of
the template is its coverage; windows of ``coverage`` or more are matches.

Texts without any signature word are passed over after one look by an automaton
of all of them; the work on the rest is per document, so nothing is shuffled.

Defined results: a null or empty text has no match; overlapping matches of one
template are reported once, the first by position; matches of different
templates may overlap, but of close variants (``VARIANTS``) the best is reported; repeated rows report the same matches each; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import map_batches

_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu_header(program: str, name: str, version: str) -> str:
    return (f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public "
            f"License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            f"later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for "
            "more details.")


#: Public notices and license texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "bsd-2-clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CONDITIONS + (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. ") + _BSD_DISCLAIMER,
    "lgpl-2.1-header": _gnu_header("This library", "Lesser", "2.1"),
    "lgpl-3.0-header": _gnu_header("This program", "Lesser", "3"),
    "agpl-3.0-header": _gnu_header("This program", "Affero", "3"),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc-by-4.0-notice": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/"),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
        "CC0 1.0 Universal http://creativecommons.org/publicdomain/zero/1.0/"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."),
}
#: Texts that differ in a few words: where matches of one line overlap, only the best is a match.
VARIANTS = [frozenset(v.split()) for v in ("gpl-3.0-header lgpl-2.1-header lgpl-3.0-header agpl-3.0-header", "bsd-2-clause bsd-3-clause")]
WORD = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    counts: Counter
    signature: dict[str, list[int]]     # word: its places in the template
    slack: int


def needed(n: int, coverage: float) -> int:
    """Words of ``n`` that a match must hold."""
    return ceil(coverage * n - 1e-9)


def compiled(templates: dict[str, str], coverage: float) -> list[Template]:
    """Signatures: the longest words of a template, until they make up more than a match may lack."""
    out = []
    for name, text in templates.items():
        words = words_of(text)
        counts = Counter(words)
        chosen, weight, may_lack = [], 0, len(words) - needed(len(words), coverage)
        for w in sorted(counts, key=lambda w: (-len(w), counts[w], w)):
            if weight > may_lack:
                break
            chosen.append(w)
            weight += counts[w]
        out.append(Template(name, words, counts, {w: [i for i, x in enumerate(words) if x == w] for w in chosen}, len(words) // 4 + 2))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by first) that increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, the earliest in ``b``."""
    rows = [[0] * (len(b) + 1)]      # rows[k][j]: longest of the last k words of a and b[j:]
    for x in reversed(a):
        last, row = rows[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = last[j + 1] + 1 if x == b[j] else max(last[j], row[j + 1])
        rows.append(row)
    out, i, j, n = [], 0, 0, len(a)
    while i < n and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[n - i - 1][j] >= rows[n - i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of ``a`` and ``b`` that patience alignment puts together."""
    if not a or not b:
        return []
    once_a = {w: i for i, w in enumerate(a)} if len(set(a)) == len(a) else {w: a.index(w) for w, n in Counter(a).items() if n == 1}
    once_b = {w for w, n in Counter(b).items() if n == 1}
    at_b = {w: j for j, w in enumerate(b) if w in once_b}
    anchors = increasing(sorted((i, at_b[w]) for w, i in once_a.items() if w in at_b))
    if not anchors:
        return common(a, b)
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in aligned(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def matches(text: str | None, templates: list[Template], coverage: float) -> list[tuple[str, int, int, float]]:
    """(template, first character, end character, coverage) of each match."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    words = [text[a:b].lower() for a, b in spans]
    places: dict[str, list[int]] = {}
    wanted = {w for t in templates for w in t.signature}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    out = []
    for t in templates:
        n, need = len(t.words), needed(len(t.words), coverage)
        starts = sorted({p - o for w, offsets in t.signature.items() for p in places.get(w, ()) for o in offsets})
        free = 0        # words before this place belong to a match
        for s in starts:
            if s + n <= free:
                continue
            at, pairs = _placed(t, words, s, free, need)
            if len(pairs) < need:
                # a stray word of the template before the copy can mislead the anchors
                at, pairs = _placed(t, words, s, max(free, s), need)
            if len(pairs) >= need:
                first, last = at + pairs[0][1], at + pairs[-1][1]
                out.append((t.name, spans[first][0], spans[last][1], round(len(pairs) / n, 6), len(pairs)))
                free = last + 1
    return sorted((m[:4] for m in best_variants(out)), key=lambda m: (m[1], m[0]))


def best_variants(found: list[tuple]) -> list[tuple]:
    """Without matches that overlap a better one of a variant: of higher coverage, then of more words."""
    out: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[3], -m[4], m[1], m[0])):
        if not any(m[0] != o[0] and m[1] < o[2] and o[1] < m[2] and any(m[0] in v and o[0] in v for v in VARIANTS) for o in out):
            out.append(m)
    return out


def _placed(t: Template, words: list[str], start: int, free: int, need: int) -> tuple[int, list[tuple[int, int]]]:
    """(first word of the window, alignment) near ``start``.  The place of a signature word may
    belong to another place of the template, so a good alignment moves the window to where it
    puts the template, as long as that aligns more."""
    best: tuple[int, list[tuple[int, int]]] = (0, [])
    while True:
        a, e = max(free, start - t.slack), min(len(words), start + len(t.words) + t.slack)
        window = words[a:e]
        if sum((Counter(window) & t.counts).values()) < need:
            return best
        pairs = aligned(t.words, window)
        if len(pairs) <= len(best[1]):
            return best
        best = (a, pairs)
        moved = a + pairs[0][1] - pairs[0][0]
        if moved == start:
            return best
        start = moved


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, start, end (characters of the text), coverage."""
    known = compiled(templates or TEMPLATES, coverage)
    words = sorted({w for t in known for w in t.signature})
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(b: pa.RecordBatch) -> list:
        signs = automaton(words)
        found = [[dict(zip(("license", "start", "end", "coverage"), m)) for m in matches(t, known, coverage)]
                 if t and next(signs.iter(t.lower()), None) else [] for t in b.column(1).to_pylist()]
        return [b.column(0), pa.array(found, kind)]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, "doc_id long, found array<struct<license:string,start:long,end:long,coverage:double>>", run)
    return out.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def automaton(words: list[str]):
    """Finds any of ``words`` in a text in one pass."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a
