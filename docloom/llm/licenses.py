"""License scans by conditional compression.

A candidate block is the stretch of a text round a word that a template can't do without, as long as that template with some
words more. It is compressed alone and with each template as a raw zstandard dictionary; the templates that save most are
compared with the block word by word, and the best that agrees is reported with its place and its differences. Longer templates
come first; words that a hit has taken belong to no other block, and the rest goes on to be scanned, so a text may hold several.
"""

from __future__ import annotations

import math
import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import spread, table

# The wording of public licenses and of usual notices; (name, words that must agree, text).
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Identifiers of the public list of licenses, as they stand after "SPDX-License-Identifier:".
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby Unlicense UPL-1.0 Vim
W3C WTFPL X11 Zlib ZPL-2.1
""".split()
#: License texts as published, in ``license_texts``, and words that no copy of them lacks.
FULL = {
    "Apache-2.0": "apache 2.0 contributor", "GPL-2.0": "gnu general 2 sublicense", "GPL-3.0": "gnu general 3 propagate", "LGPL-2.1": "gnu lesser 2.1 linking", "LGPL-3.0": "gnu lesser 3 conveying", "MPL-2.0": "mozilla 2.0 contributor",
    "CC0-1.0": "creative commons cc0 affirmer",
}


def _full(name: str) -> str:
    return (pkgutil.get_data("docloom.llm", f"license_texts/{name}.txt") or b"").decode()


TEMPLATES: list[tuple[str, str, str]] = [
    *[(name, keys, _full(name)) for name, keys in FULL.items()],
    *[(name, f"spdx-license-identifier {name.lower()}", f"SPDX-License-Identifier: {name}") for name in SPDX],
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "permission software sublicense", f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"),
    ("MIT", "permission software sublicense", _MIT_GRANT),
    ("ISC", "permission fee disclaims", f"{_ISC} {_ISC_WARRANTY}"),
    ("ISC", "permission fee", _ISC),
    ("Apache-2.0", "apache 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "apache 2.0", "Apache Software License 2.0"),
    ("Apache-2.0", "apache 2.0", "Apache License 2.0"),
    ("EPL-2.0", "eclipse 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "eclipse v1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "eclipse 2.0", "Eclipse Public License - v 2.0"),
    ("GPL-3.0", "gnu general 3 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "gnu general 2 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "gnu lesser 3 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "gnu lesser 2.1 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "gnu affero 3 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "mozilla 2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "redistributions retain reproduce disclaimed", f"{_BSD_HEAD} {_BSD_TWO} {_DISCLAIMER}"),
    ("BSD-3-Clause", "redistributions retain reproduce neither endorse disclaimed", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_DISCLAIMER}"),
    ("BSD-2-Clause", "redistributions retain reproduce", f"{_BSD_HEAD} {_BSD_TWO}"),
    ("BSD-3-Clause", "redistributions retain reproduce neither endorse", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE}"),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0-or-later", "gnu general 3", f"This program {_GNU.format('General Public License', 3)}"),
    ("GPL-2.0-or-later", "gnu general 2", f"This program {_GNU.format('General Public License', 2)}"),
    ("LGPL-3.0-or-later", "gnu lesser 3", f"This library {_GNU.format('Lesser General Public License', 3)}"),
    ("AGPL-3.0-or-later", "gnu affero 3", f"This program {_GNU.format('Affero General Public License', 3)}"),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "mozilla 2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Zlib", "as-is origin altered", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "cc0 1.0", "Released under CC0 1.0."),
    *[(f"CC-{k}-4.0", f"cc {k.lower()} 4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    *[(f"CC-{k}-4.0", f"creative commons {n.lower().split()[-1]} 4.0", f"This work is licensed under a Creative Commons {n} 4.0 International License.") for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))],
]

TRIGGER = re.compile(r"(?i)licen[cs]|copyright|redistribut|hereby granted|public domain|creative commons|\bCC[ -]?(?:BY|0)|without warrant|as[ -]is\b|\bSPDX\b")
#: One of these stands in every text that has a trigger; looked for first, in lower case.
_HINTS = ("licen", "copyright", "redistribut", "hereby granted", "public domain", "creative commons", "cc by", "cc-by", "ccby", "cc0", "cc 0", "cc-0", "without warrant", "as is", "as-is", "asis", "spdx")
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: A template is confirmed if this share of its words is found in order, and no more than this share of other words lies between.
COVERAGE, LOOSE = 0.8, 0.5
#: Templates that savings pass on to the comparison of wording; those of a saving below ``LEAST_SAVING`` aren't compared.
WINNERS, LEAST_SAVING = 4, 0.15


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


def _hinted(low: str) -> bool:
    return any(h in low for h in _HINTS)


@dataclass
class Template:
    name: str
    keys: frozenset[str]
    words: list[str]
    counts: Counter[str]
    #: The key that stands in fewest places of the template, the first of them and the last.
    anchor: str
    first: int
    last: int
    packer: zstandard.ZstdCompressor

    def may_be_in(self, counts: Counter[str]) -> bool:
        """Whether words of these counts could hold enough of the template."""
        return self.keys <= counts.keys() and sum(min(n, counts[w]) for w, n in self.counts.items()) >= COVERAGE * len(self.words)


@dataclass
class Hit:
    start: int
    end: int
    license: str
    saving: float
    differences: list[str]


def agreeing(a: list[str], b: list[str], gram: int = 5) -> list[tuple[int, int, int]]:
    """Stretches (place in a, place in b, words) that agree, in order in both. Long lists are first pinned together where runs of
    ``gram`` words that come once in each agree; what lies between two pins is compared by itself."""
    if gram == 0 or len(a) * len(b) <= 1 << 17:
        return [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    once = []
    for own in (a, b):
        at: dict[tuple[str, ...], int] = {}
        for i in range(len(own) - gram + 1):
            k = tuple(own[i : i + gram])
            at[k] = -1 if k in at else i
        once.append({k: i for k, i in at.items() if i >= 0})
    pairs = [(i, once[1][k]) for k, i in once[0].items() if k in once[1]]  # by place in a
    # The longest chain of pins that is in order in b as well.
    tops, chain, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        tops[at : at + 1] = [j]
        before.append(chain[at - 1] if at else -1)
        chain[at : at + 1] = [n]
    pins, n = [], chain[-1] if chain else -1
    while n >= 0:
        pins.append(pairs[n])
        n = before[n]
    out: list[tuple[int, int, int]] = []
    x = y = 0
    for i, j in [*reversed(pins), (len(a), len(b))]:
        if i > x or j > y:
            out += [(x + p, y + q, size) for p, q, size in agreeing(a[x:i], b[y:j], gram - 1)] if i > x and j > y else []
        if i < len(a) and i >= x and j >= y:
            out.append((i, j, 1))
            x, y = i + 1, j + 1
    whole: list[tuple[int, int, int]] = []
    for i, j, size in out:
        if whole and whole[-1][0] + whole[-1][2] == i and whole[-1][1] + whole[-1][2] == j:
            whole[-1] = (*whole[-1][:2], whole[-1][2] + size)
        else:
            whole.append((i, j, size))
    return whole


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, level: int = 3) -> None:
        how = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(level=level, **how)
        self.empty = len(self.alone.compress(b""))
        self.templates = []
        for name, keys, text in templates:
            words = [w for w, _, _ in words_of(text)]
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            anchor = min(keys.split(), key=lambda k: (words.count(k), k))
            places = [i for i, w in enumerate(words) if w == anchor]
            self.templates.append(Template(name, frozenset(keys.split()), words, Counter(words), anchor, places[0], places[-1], zstandard.ZstdCompressor(dict_data=raw, **how)))
        self.templates.sort(key=lambda t: -len(t.words))  # stable: of equal ones the first listed comes first
        self.anchors = frozenset(t.anchor for t in self.templates)

    def savings(self, words: list[str], among: list[int] | None = None) -> list[tuple[float, int]]:
        """(saving, template) for each template, the largest first: by how much of its size knowing the template shrinks the block."""
        raw = " ".join(words).encode()
        size = max(1, len(self.alone.compress(raw)) - self.empty)
        some = range(len(self.templates)) if among is None else among
        return sorted(((1 - max(0, len(self.templates[i].packer.compress(raw)) - self.empty) / size, i) for i in some), key=lambda x: (-x[0], x[1]))

    def compare(self, words: list[str], t: Template) -> tuple[int, int, int, list[str]] | None:
        """Where the template stands in the words (start, end), how many of its words agree, and the differences; None if it doesn't."""
        blocks = agreeing(words, t.words)
        if not blocks:
            return None
        agree = sum(n for _, _, n in blocks)
        start, end = blocks[0][0], blocks[-1][0] + blocks[-1][2]
        found = {w for i, _, n in blocks for w in words[i : i + n]}
        if agree < COVERAGE * len(t.words) or not t.keys <= found or end - start - agree > LOOSE * len(t.words):
            return None
        differences, a, b = [], start, 0
        for i, j, n in blocks:
            gone, come = t.words[b:j], words[a:i]
            if gone or come:
                differences.append(f"-{' '.join(gone)}+{' '.join(come)}")
            a, b = i + n, j + n
        if b < len(t.words):
            differences.append(f"-{' '.join(t.words[b:])}+")
        return start, end, agree, differences

    def best(self, words: list[str]) -> tuple[int, tuple[int, int, int, list[str]], float] | None:
        """Of the templates that save most of a block the one that agrees in most words; of equals the larger saving, then the longer."""
        counts, out = Counter(words), None
        some = [i for i, t in enumerate(self.templates) if t.may_be_in(counts)]
        for saving, i in self.savings(words, some)[:WINNERS] if some else ():
            if saving < LEAST_SAVING:
                break
            met = self.compare(words, self.templates[i])
            if met and (out is None or (met[2], saving) > (out[1][2], out[2])):
                out = (i, met, saving)
        return out

    def scan(self, text: str | None) -> list[Hit]:
        """Licenses of a whole text by place; none for null and empty."""
        if not text or not _hinted(text.lower()) or not TRIGGER.search(text):
            return []
        all_ = words_of(text)
        words = [w for w, _, _ in all_]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.anchors:
                places.setdefault(w, []).append(i)
        counts, out, taken = Counter(words), [], []  # taken: stretches of words, sorted
        for t in self.templates:
            if not t.may_be_in(counts):
                continue
            more = math.ceil(LOOSE * len(t.words)) + 1
            for i in places[t.anchor]:
                # The block ends where a hit before it, or one after it, has taken words.
                at = bisect_left(taken, (i + 1, 0))
                if at and taken[at - 1][1] > i:
                    continue
                start = max(0, i - t.last - more, taken[at - 1][1] if at else 0)
                end = min(len(words), i - t.first + len(t.words) + more, taken[at][0] if at < len(taken) else len(words))
                if not t.may_be_in(Counter(words[start:end])):
                    continue
                met = self.best(words[start:end])
                if met:
                    k, (a, b, _, differences), saving = met
                    taken.insert(at, (start + a, start + b))
                    out.append(Hit(all_[start + a][1], all_[start + b - 1][2], self.templates[k].name, saving, differences))
        return sorted(out, key=lambda h: h.start)


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    """A worker's own."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, hits`` for each row of ``docs(doc_id, text)``; a hit has start, end (code points), license, saving, differences.

    Null and empty texts have none; long texts are read whole; of templates that agree in as many words the larger saving wins, then the
    longer, then the first listed; repeated rows stay rows; other columns are ignored; an empty table gives no rows.
    """
    hit = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("saving", T.DoubleType()), T.StructField("differences", T.ArrayType(T.StringType()))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("differences", pa.list_(pa.string()))]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("hits", T.ArrayType(hit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            hits = [[vars(h) for h in own.scan(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, arrow)], names=["doc_id", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its number of licenses, their places (license:start:end) and how many wordings differ."""
    found = scan(spread(table(spark, sf_dir, "documents")))
    places = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["start"], h["end"])), ",")
    differ = F.size(F.filter("hits", lambda h: F.size(h["differences"]) > 0)).cast("long")
    return found.select("doc_id", F.size("hits").cast("long").alias("n_licenses"), places.alias("licenses"), differ.alias("n_reworded"), "hits")
