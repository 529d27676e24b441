"""Licence notices by conditional compression.

Candidate blocks, short stretches of lines around words that licence notices use, are compressed with zstandard alone
and with each template as a raw dictionary. Templates are ranked by the reduction in size; a winner is confirmed by its
exact wording differences: the words that the block lacks and those put in between. A difference in a word that names a
licence, or in its version, is another licence: such a template does not win, however small the difference.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ostiary.llm import common

LEVEL = 3
# Candidates must save this share of the template's own compressed size, so that a notice inside a longer line counts in full, and this share of the template's words must be there in order.
LEAST_REDUCTION = 0.3
LEAST_WORDING = 0.8
# How many of the best templates are compared word by word.
RIVALS = 10
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software.")
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.")
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(name: str, version: str) -> str:
    return f"This work is licensed under the GNU {name} Public License, version {version}."


def _gnu_header(name: str, version: str, subject: str = "program") -> str:
    return (f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published "
            f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


# Wording of common public licence notices and whole short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT, "MIT-body": _MIT + _MIT_DISCLAIMER,
    "ISC": "Released under the ISC License.", "ISC-text": _ISC, "ISC-body": _ISC + _ISC_DISCLAIMER,
    "BSD": "Released under the BSD License.", "BSD-2-Clause": _BSD, "BSD-2-Clause-body": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + _BSD_NAMES, "BSD-3-Clause-body": _BSD + _BSD_NAMES + _BSD_DISCLAIMER,
    **{f"GPL-{v}.0": _gnu("General", v) for v in "23"}, **{f"GPL-{v}.0-or-later": _gnu_header("General", v) for v in "23"},
    "LGPL-2.1": _gnu("Lesser General", "2.1"), "LGPL-3.0": _gnu("Lesser General", "3"), "LGPL-2.1-or-later": _gnu_header("Lesser General", "2.1", "library"),
    **{f"{short}-{v}-name": f"GNU {name} Public License, version {v}." for short, name, v in (
        ("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))},
    "AGPL-3.0": _gnu("Affero General", "3"), "AGPL-3.0-or-later": _gnu_header("Affero General", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License, version 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    **{f"CC-{parts}-4.0-name" if parts in ("BY", "BY-SA") else f"CC-{parts}-4.0": f"Licensed under CC {parts} 4.0."
       for parts in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
# Words that make it another licence when they are missing or added.
NAMING = frozenset("""mit bsd isc apache gnu gpl lgpl agpl general lesser library affero mozilla mpl eclipse epl boost cc by nc nd sa creative commons
attribution noncommercial sharealike noderivatives noderivs public unlicense""".split())
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*\Z")

_TRIGGER = re.compile(
    r"\blicen[sc]e[ds]?\b|\bunlicense\b|\bunencumbered\b|\bcopyright(?:ed)?\b|\bhereby granted\b|\bredistribut|\bpublic domain\b|\bspdx\b|\ball rights reserved\b"
    r"|\bwaived all\b|\bas[- ]is\b|\bwarrant(?:y|ies)\b|\bsublicense\b|\bfree software\b|\bapache\.org\b|\bmozilla\.org\b"
    r"|\bconditions are met\b|\bfollowing conditions\b|\bfollowing disclaimer\b|\bpermission notice\b|\bin no event shall\b|\bliability\b"
    r"|\bspecific prior written permission\b", re.I)
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?:;](?=\s|$)|\n|\Z)|\n")
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
# A longer sentence is looked at in windows around its trigger words.
LONG = 2_000
# Sentences with such words at most so many characters apart belong to one block.
GAP = 400


@dataclass
class Finding:
    start: int
    end: int
    license: str
    reduction: float
    wording: float
    missing: list[str]
    added: list[str]


def _spelled(word: str) -> str:
    """A word for comparison: lower case, versions without v and final zeros."""
    found = _VERSION.match(word.lower())
    return found[1] if found else word.lower()


def _renames(missing: list[str], added: list[str]) -> bool:
    """True if the differences touch the name or the version of the licence."""
    return any(w in NAMING or w[0].isdigit() for w in missing) or not NAMING.isdisjoint(added)


class Templates:
    """Compressors and words of each template."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.known = []
        # characters on either side of a trigger word that can belong to its notice
        self.reach = 2 * max(map(len, templates.values()), default=0)
        for name in sorted(templates):
            words = [_spelled(w) for w in _WORD.findall(templates[name])]
            dictionary = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = len(self.plain.compress(" ".join(words).encode()))
            self.known.append((name, words, own, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False)))

    def _inside(self, words: list[str], at: list[int], own: list[str], size: int, compressor: zstandard.ZstdCompressor) -> float:
        """The largest reduction of windows as long as the template that lay its trigger words over the block's."""
        slack = 1 + len(own) // 4
        if len(words) <= len(own) + 2 * slack:
            return 0.0
        starts = {max(0, i - j - slack) for i in at for j in _trigger_words(" ".join(own))}
        best = 0.0
        for start in starts:
            part = " ".join(words[start:start + len(own) + 2 * slack]).encode()
            best = max(best, (len(self.plain.compress(part)) - len(compressor.compress(part))) / size)
        return best

    def best(self, block: str) -> Finding | None:
        """The confirmed winner for a block, with offsets inside it; the fewest wording differences win, then the longest."""
        places = list(_WORD.finditer(block))
        words = [_spelled(m[0]) for m in places]
        body = " ".join(words).encode()
        alone = len(self.plain.compress(body))
        at = _trigger_words(body.decode())
        ranked = sorted(((max((alone - len(c.compress(body))) / size, self._inside(words, at, own, size, c)), name, own)
                         for name, own, size, c in self.known), key=lambda x: (-x[0], x[1]))
        confirmed = []
        for reduction, name, own in ranked[:RIVALS]:
            if reduction < LEAST_REDUCTION:
                break
            steps = difflib.SequenceMatcher(None, own, words, autojunk=False).get_opcodes()
            equal = [s for s in steps if s[0] == "equal"]
            wording = sum(b - a for _, a, b, _, _ in equal) / len(own)
            if wording < LEAST_WORDING:
                continue
            first, last = equal[0][3], equal[-1][4]  # words around the notice are not part of it
            missing = [w for kind, a, b, _, _ in steps if kind != "equal" for w in own[a:b]]
            added = [w for kind, _, _, c, d in steps if kind != "equal" and first <= c and d <= last for w in words[c:d]]
            if _renames(missing, added):
                continue
            confirmed.append((len(missing) + len(added), -len(own), name, Finding(
                places[first].start(), places[last - 1].end(), name, reduction, wording, missing, added)))
        return min(confirmed, key=lambda x: x[:3])[3] if confirmed else None


def _trigger_words(body: str) -> list[int]:
    """Numbers of the words at which triggers start in words joined by blanks."""
    out, words, last = [], 0, 0
    for m in _TRIGGER.finditer(body):
        words += body.count(" ", last, m.start())
        last = m.start()
        out.append(words)
    return out


def sentences(text: str, reach: int) -> list[tuple[int, int]]:
    """Offsets of the sentences or lines with a trigger word, long ones as windows of ``reach`` characters on both sides
    of each trigger word; a text without any costs one search."""
    if _TRIGGER.search(text) is None:
        return []
    out = []
    for m in _SENTENCE.finditer(text):
        if m.end() - m.start() <= LONG:
            if _TRIGGER.search(m[0]):
                out.append(m.span())
        else:
            out += [(max(m.start(), t.start() - reach), min(m.end(), t.end() + reach)) for t in _TRIGGER.finditer(text, *m.span())]
    return out


def blocks(text: str, reach: int) -> list[list[tuple[int, int]]]:
    """Candidate blocks: sentences with trigger words that are at most GAP characters apart."""
    out: list[list[tuple[int, int]]] = []
    for span in sentences(text, reach):
        if out and span[0] - out[-1][-1][1] <= GAP:
            out[-1].append(span)
        else:
            out.append([span])
    return out


def scan_text(text: str, known: Templates, memo: dict) -> list[Finding]:
    """Notices in order. What a block holds beside its winner is looked at again; a block without a winner is halved
    at its widest gap until single sentences are left."""
    found: list[Finding] = []
    waiting = blocks(text, known.reach)
    while waiting:
        spans = waiting.pop()
        start, end = spans[0][0], spans[-1][1]
        block = text[start:end]
        if block not in memo:
            if len(memo) > 20_000:
                memo.clear()
            memo[block] = known.best(block)
        best = memo[block]
        if best is not None:
            own = replace(best, start=start + best.start, end=start + best.end)
            if all(own.end <= f.start or own.start >= f.end for f in found):  # windows overlap
                found.append(own)
            before = [(a, min(b, own.start)) for a, b in spans if a < own.start]
            after = [(max(a, own.end), b) for a, b in spans if b > own.end]
            waiting += [rest for rest in ([s for s in part if _TRIGGER.search(text, *s)] for part in (before, after)) if rest]
        elif len(spans) > 1:
            gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
            cut = gaps.index(max(gaps)) + 1
            waiting += [spans[:cut], spans[cut:]]
    return sorted(found, key=lambda f: f.start)


FIELDS = ("licenses array<struct<license:string,start:long,end:long,reduction:double,wording:double,missing:array<string>,added:array<string>>>, "
          "license_count long")
_TYPE = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                            ("wording", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the licence notices of each whole text, in order, with offsets of characters.

    Null and empty texts have none. One pass, no shuffle; a block met again is not compressed again.
    """
    templates = TEMPLATES if templates is None else templates
    key = ("licenses", tuple(sorted(templates.items())))

    def compute(batch: pa.RecordBatch) -> list:
        known, memo = common.once_per_worker(key, lambda: (Templates(templates), {}))
        rows = [[vars(f) for f in scan_text(t, known, memo)] for t in common.texts_of(batch, text)]
        return [pa.array(rows, _TYPE), pa.array([len(r) for r in rows], pa.int64())]

    return common.with_columns(docs, FIELDS, compute)
