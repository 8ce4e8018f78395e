"""License scans by conditional compression.

Blocks are the stretches of a text, across line breaks, that hold all marked words
of a template no further apart than its wording allows; nothing else can be
confirmed. Each block is compressed alone and with every such template as a
zstandard raw-content dictionary; the templates are ranked by how much smaller it
gets. The saving only ranks: all are tried for exact wording, and of those that
cover the same words the one with fewest differences, then the best ranked, is
given. For exact wording the template's words must occur in the block, in order and close together, with at most ``wording`` of them missing or
inserted, and none of its numbers or marked words may differ. What a confirmed
template covers is taken out and the block is tried again, so a block can hold
several. A confirmed SPDX tag is read on to the end of its expression.

Defined results: null text has no blocks; signs without a letter or digit, such as
those that open a comment line, aren't words; of templates that cover the same words
with the same differences, the longer one is given; templates without a word are left out; repeated rows are rows of their
own; very long texts are read whole; ids may be null; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import slim

FREE = "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."

BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
)

#: Notices by SPDX identifier: fixed values. Words in capitals or with digits tell licenses apart.
#: Identifiers with -grant and -endorsement are sentences of full license texts; BSD-grant opens all BSD licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistributed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Redistributed under the BSD 2-Clause License.",
    "all-rights-reserved": "All rights reserved.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-endorsement": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-or-later": FREE.format("GNU General Public License", "3"),
    "GPL-2.0-or-later": FREE.format("GNU General Public License", "2"),
    "LGPL-3.0-or-later": FREE.format("GNU Lesser General Public License", "3"),
    "LGPL-2.1-or-later": FREE.format("GNU Lesser General Public License", "2.1"),
    "AGPL-3.0-or-later": FREE.format("GNU Affero General Public License", "3"),
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": f"{BSD[0]} {BSD[1]} {BSD[2]} {BSD[4]}",
    "BSD-3-Clause-text": f"{BSD[0]} {BSD[1]} {BSD[2]} {BSD[3]} {BSD[4]}",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Tags by SPDX identifier, one for each license above and some more: made from a rule.
TAGGED = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
TEMPLATES |= {f"{i}-tag": f"SPDX-License-Identifier: {i}" for i in TAGGED}

#: Titles of licenses, as they stand over a text or for it.
TEMPLATES |= {
    "MIT-title": "The MIT License",
    "MIT-short-title": "MIT License",
    "ISC-title": "ISC License",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "BSD-style": "governed by a BSD-style license that can be found in the LICENSE file.",
}
#: Addresses: made from a rule. A word begins after a colon, so http and https are alike.
ADDRESSES = {f"CC-{k.upper()}-{v}": f"creativecommons.org/licenses/{k}/{v}" for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")}
ADDRESSES |= {"CC0-1.0": "creativecommons.org/publicdomain/zero/1.0", "Apache-2.0": "www.apache.org/licenses/LICENSE-2.0", "MIT": "opensource.org/licenses/MIT"}
TEMPLATES |= {f"{n}-url{end and '-folder'}": f"//{a}{end}" for n, a in ADDRESSES.items() for end in ("", "/")}

WORD = re.compile(r"[^\s,;:()\"']+")
#: A tag with what follows it: identifiers joined by operators, with brackets.
EXPRESSION = re.compile(r"SPDX-License-Identifier:\s*(\(*[A-Za-z0-9.+-]+\)*(?:\s+(?:AND|OR|WITH)\s+\(*[A-Za-z0-9.+-]+\)*)+)", re.IGNORECASE)


def expression(text: str, start: int, end: int, name: str) -> tuple[str, int]:
    """(license, end) of a confirmed tag: the whole expression where it is more than one identifier."""
    m = EXPRESSION.match(text, start) if name.endswith("-tag") else None
    if not m or m.end() < end:
        return name, end
    stop = m.end() - (len(m[1]) - len(m[1].rstrip(".")))
    return " ".join(m[1].rstrip(".").split()) + "-tag", stop


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words without closing stops, with their places; signs alone are none."""
    out = []
    for m in WORD.finditer(text):
        w = m.group().rstrip(".!?")
        if w and (w.isalnum() or any(c.isalnum() for c in w)):
            out.append((w.lower(), m.start(), m.start() + len(w)))
    return out


def marked(template: str) -> set[str]:
    """The words that may not differ: with a digit, in capitals, or a name before License."""
    ws = [m.group().rstrip(".!?") for m in WORD.finditer(template)]
    if ws[:1] == ["SPDX-License-Identifier"] or sum(w.isupper() for w in ws) > 8:
        # in a tag all words count; where whole sentences are in capitals, numbers and a few long words of the rest do
        return {w.lower() for w in ws} if len(ws) < 8 else {w.lower() for w in sorted((w for w in ws if not w.isupper()), key=lambda w: (-len(w), w))[:4]}
    fixed = {w.lower() for w in ws if any(c.isdigit() for c in w) or (len(w) > 1 and w.isupper())}
    for a, b in zip(ws, ws[1:], strict=False):
        if b in ("License", "General", "Public") and a[0].isupper():
            fixed.add(a.lower())
    return fixed or {w for w, _, _ in words(template)}


def possible(text, templates: dict[str, str]):
    """Whether a text can hold a template: the longest of its marked words occur. Only plain letters,
    which are lower-cased alike everywhere, are asked for."""
    asked = [sorted((w for w in marked(t) if w.isascii()), key=lambda w: (-len(w), w))[:3] for t in templates.values() if words(t)]
    each = lambda t: reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.contains(t, F.lit(w)) for w in ws], F.lit(True)) for ws in asked], F.lit(False))
    return F.exists(F.array(F.lower(text)), each)


class Scanner:
    def __init__(self, templates: dict[str, str], wording: float):
        self.words = {n: ws for n, t in templates.items() if (ws := [w for w, _, _ in words(t)])}
        self.marked = {n: marked(templates[n]) for n in self.words}
        # the most words a notice can take: its own and those inserted
        self.reach = {n: len(ws) + int(wording * len(ws)) for n, ws in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=10)
        self.given = {n: zstandard.ZstdCompressor(level=10, dict_data=zstandard.ZstdCompressionDict(templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.words}
        self.wording = wording

    def ranked(self, block: str, names: list[str]) -> list[tuple[float, str]]:
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(self.given[n].compress(raw)), n) for n in names]
        # shares of what a template could save at most: its own length
        return sorted(((s / max(1, len(" ".join(self.words[n]))), n) for s, n in saved), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: list[tuple[str, int, int]], name: str) -> tuple[int, int, int] | None:
        """(first word, word after the last, differences) of the template in the block."""
        want, have = self.words[name], [w for w, _, _ in block]
        m = [x for x in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if x.size]
        if not m:
            return None
        # the longest match and those beside it that stay within the template's own length
        top = max(m, key=lambda x: x.size)
        near = [x for x in m if abs((x.a - x.b) - (top.a - top.b)) <= max(1, int(self.wording * len(want)))]
        first, last = min(x.a for x in near), max(x.a + x.size for x in near)
        same = sum(x.size for x in near)
        found = set(have[first:last])
        differ = (len(want) - same) + (last - first - same)
        if differ > self.wording * len(want) or not self.marked[name] <= found:
            return None
        return first, last, differ

    def places(self, block: list[tuple[str, int, int]]) -> dict[str, list[int]]:
        at = defaultdict(list)
        for i, (w, _, _) in enumerate(block):
            at[w].append(i)
        return at

    def stretches(self, at: dict[str, list[int]], name: str):
        """(place, start, end) around each place of the rarest marked word, if all marked words are in reach of it."""
        if not all(w in at for w in self.marked[name]):
            return
        reach, rarest = self.reach[name], min(self.marked[name], key=lambda w: (len(at[w]), w))
        for p in at[rarest]:
            a, b = max(0, p - reach + 1), p + reach
            if all((i := bisect_left(at[w], a)) < len(at[w]) and at[w][i] < b for w in self.marked[name]):
                yield p, a, b

    def hits(self, block: list[tuple[str, int, int]], at: dict[str, list[int]], name: str) -> set[tuple[int, int, int]]:
        """(differences, first word, word after the last) wherever the template is confirmed."""
        want, found = self.words[name], set()
        slack = self.reach[name] - len(want)
        for p, a, b in self.stretches(at, name):
            # where the notice lies if this word of it is in its place, then anywhere in reach
            own = [(max(0, p - k - slack), p - k + len(want) + slack) for k, w in enumerate(want) if w == block[p][0]]
            for x, y in [*own, (a, b)]:
                if y > 0 and (hit := self.confirm(block[x:y], name)):
                    found.add((hit[2], x + hit[0], x + hit[1]))
        return found

    def scan(self, text: str):
        """(license, start, end, saved, differences) of every notice, in code points."""
        left = words(text)
        at = self.places(left)
        spans: list[list] = []
        for a, b, n in sorted((a, b, n) for n in self.words for _, a, b in self.stretches(at, n)):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2].add(n)
            else:
                spans.append([a, b, {n}])
        for a, b, names in spans:
            yield from self.block(text, left[a:b], sorted(names))

    def block(self, text: str, left: list[tuple[str, int, int]], names: list[str]):
        ranked = self.ranked(text[left[0][1] : left[-1][2]], names)
        again = True
        while again:
            at, found = self.places(left), []
            for saved, name in ranked:
                found += [(differ, first - last, -saved, name, first, last) for differ, first, last in self.hits(left, at, name)]
            taken = [False] * len(left)
            out = []
            for differ, _, saved, name, first, last in sorted(found):
                if not any(taken[first:last]):
                    taken[first:last] = [True] * (last - first)
                    out.append((first, last))
                    license_, end = expression(text, left[first][1], left[last - 1][2], name)
                    yield license_, left[first][1], end, -saved, differ
            # what the notices cover can't match again; what lies around them can
            for first, last in sorted(out, reverse=True):
                left[first:last] = [("\0", left[first][1], left[first][2])]
            again = bool(out)


def notices(docs: DataFrame, templates: dict[str, str] | None = None, wording: float = 0.15) -> DataFrame:
    """Rows (doc_id, license, start, end, saved, differences), one for each confirmed notice."""
    templates = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(templates, wording)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in enumerate(batch.column(1)):
                rows += [(ids[i], *hit) for hit in scanner.scan(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "license", "start", "end", "saved", "differences"])

    near = docs.where(possible(F.col("text"), templates)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near.mapInArrow(slim(run), "doc_id long, license string, start long, end long, saved double, differences long")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
