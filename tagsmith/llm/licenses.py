"""License scans by conditional compression.

Candidate blocks are runs of sentences or lines with license wording. Each block is compressed with every template as
a zstandard raw dictionary; the size reductions against no dictionary rank the templates. All are checked
by exact wording differences: the words that the block adds to or lacks from the closest passage of the template.
What a winner leaves of the block is ranked and checked again, so a block gives a row for each notice in it.
A template wins if enough of the block's words stand in it in order and none of the words by which it differs from
other licenses (names, versions, clauses) is contradicted.

Defined cases: null or empty text has no blocks; blocks of any length are compressed whole; ties of reduction take the
smaller license id; repeated rows are scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, table

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_SHORT = ("Released under the {0}.", "Licensed under the {0}.", "Licensed under {0}.", "This work is licensed under the {0}.", "This work is licensed under a {0}.", "Distributed under the {0}.", "This project is licensed under the terms of the {0}.", "Published under {0}.", "License: {0}.")


def _short(*names: str) -> list[str]:
    return [s.format(n) for n in names for s in _SHORT]


def _gnu(name: str, short: str, version: str) -> list[str]:
    forms = (f"{name}, version {version}", f"{name} version {version}", f"{name}, Version {version}", f"{name} v{version}", f"{short} version {version}", f"{short}v{version}", f"{short}-{version}.0")
    return [*_short(*(f"GNU {f}" for f in forms[:6]), *forms[4:]), _GNU.format(name, version)]


#: Wording of each license: notices in use, then the body where it is short.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "Apache-2.0": [*_short("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [*_short("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"), _BSD],
    "BSD-3-Clause": [*_short("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"), _BSD + " " + _BSD_3],
    "CC-BY-4.0": _short("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    "CC-BY-NC-4.0": _short("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": _short("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": _short("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": _short("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": _short("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": [*_short("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "ISC": [*_short("ISC License"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "MIT": [*_short("MIT License", "MIT license"), _MIT, _AS_IS],
    "MPL-2.0": [*_short("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [*_short("Unlicense"), "This is free and unencumbered software released into the public domain."],
}

for _id, _notices in TEMPLATES.items():
    _notices.append(f"SPDX-License-Identifier: {_id}")

_CUE = re.compile(r"licen[sc]|copyright|permission is hereby|permission to use|redistribut|public domain|creative commons|\bcc0\b|\bcc[ -]by|\bgnu\b|\bgpl|provided \"as is\"|warrant", re.I)
#: A text without any of these, in lower case, has no cue.
_CUE_PARTS = ("licen", "copyright", "permission", "redistribut", "public domain", "creative commons", "cc0", "cc-by", "cc by", "gnu", "gpl", "as is", "warrant")
_UNIT = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)", re.S)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_COMMON = {*"a an and any are as at be by for from in is it its may no not of on or that the this to under was with you your work".split()}
#: Share of a sentence's less common words that license texts use, from which it goes on a block that it touches.
LIKE, MIN_MATCH = 0.7, 0.8
#: A notice is confirmed only if so many of its words are there, or this share of them.
MIN_WORDS, MIN_COVER = 8, 0.5


def _lower(text: str) -> str:
    """Lower case with the places of text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_VOCABULARY = {w for notes in TEMPLATES.values() for n in notes for w in words_of(n)} - _COMMON
_NOTICE_WORDS = {k: [words_of(n) for n in notes] for k, notes in TEMPLATES.items()}
#: Units of the longest notice, were it set in lines of four words or more.
MAX_UNITS = max(len(n) for notes in _NOTICE_WORDS.values() for n in notes) // 4 + 1
#: Words that tell licenses apart: a template's notices have them, some other template's have not.
_TELLING = {"mit", "apache", "bsd", "clause", "2", "3", "2.0", "2.1", "3.0", "4.0", "1.0", "gnu", "general", "lesser", "affero", "gpl", "lgpl", "agpl", "gplv2", "gplv3", "lgplv3", "agplv3", "v2", "v3", "cc", "cc0", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike", "mozilla", "mpl", "isc", "unlicense"}


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks: sentences with a cue, and license-like sentences that touch them."""
    low = text.lower()
    if not any(c in low for c in _CUE_PARTS) or not _CUE.search(text):
        return []
    units, at = [], 0
    while at < len(text):
        m = _UNIT.match(text, at)
        end = max(m.end(), at + 1)
        units.append((at, end))
        at = end
    flags = []
    for a, b in units:
        part = text[a:b]
        if _CUE.search(part):
            flags.append(2)
        else:
            w = [x for x in words_of(part) if x not in _COMMON]
            flags.append(1 if w and sum(x in _VOCABULARY for x in w) >= LIKE * len(w) else 0 if part.strip() else 3)
    out, i = [], 0
    while i < len(units):
        if flags[i] == 0 or flags[i] == 3:
            i += 1
            continue
        j = i
        while j + 1 < len(units) and flags[j + 1] in (1, 2, 3):
            j += 1
        run = range(i, j + 1)
        while flags[j] == 3:
            j -= 1
        if any(flags[k] == 2 for k in run):
            a, b = units[i][0], units[j][1]
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            out.append((a, b))
        i = max(run) + 1
    return out


class LicenseScanner:
    def __init__(self):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)
        self.given = {k: z.ZstdCompressor(level=9, dict_data=z.ZstdCompressionDict("\n".join(n).encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, n in TEMPLATES.items()}

    def rank(self, block: str) -> list[tuple[float, str]]:
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, k) for k, c in self.given.items()), key=lambda r: (-r[0], r[1]))

    def closest(self, words: list[str], license_id: str) -> dict:
        """The closest notice: share of words in it, differing words with + and -, whether nothing telling differs, and its part of words (from, to, differences inside)."""
        best = {"share": 0.0, "diff": [], "clean": False, "from": 0, "to": 0, "inner": []}
        have = set(words)
        for notice in _NOTICE_WORDS[license_id]:
            if len(have & set(notice)) < MIN_MATCH * min(len(have), len(set(notice))):
                continue
            ops = SequenceMatcher(None, words, notice, autojunk=False).get_opcodes()
            same = sum(b - a for t, a, b, _, _ in ops if t == "equal")
            spell = lambda some: [d for t, a, b, c, e in some if t != "equal" for d in [*("+" + w for w in words[a:b]), *("-" + w for w in notice[c:e])]]  # noqa: B023, E731
            diff = spell(ops)
            # words before and after the notice are not its wording
            inner = ops[1:-1] if ops and ops[0][0] == "delete" else ops[:-1]
            inner = [*inner, *(o for o in ops[-1:] if o[0] != "delete")]
            clean = not any(w in _TELLING for t, a, b, c, e in inner if t != "equal" for w in [*words[a:b], *notice[c:e]])
            whole = same == len(notice) and all(t != "replace" for t, *_ in ops)
            # a few words in the notice's order are not the notice
            if same < min(MIN_WORDS, MIN_COVER * len(notice)):
                continue
            share = 1.0 if whole and clean else same / max(1, len(words))
            if (clean, share, -len(diff)) > (best["clean"], best["share"], -len(best["diff"])):
                equal = [(a, b) for t, a, b, _, _ in ops if t == "equal"]
                # a few words matched far from the rest are not the notice's place
                while len(equal) > 1 and equal[0][1] - equal[0][0] < equal[1][0] - equal[0][1]:
                    equal.pop(0)
                while len(equal) > 1 and equal[-1][1] - equal[-1][0] < equal[-1][0] - equal[-2][1]:
                    equal.pop()
                best = {"share": share, "diff": diff, "clean": clean, "from": equal[0][0] if equal else 0, "to": equal[-1][1] if equal else 0, "inner": spell(inner)}
        return best

    def differences(self, block: str, license_id: str) -> tuple[float, list[str], bool]:
        """(share of the block's words in the closest notice, differing words with + and -, nothing telling differs)."""
        c = self.closest(words_of(block), license_id)
        return c["share"], c["diff"], c["clean"]

    def winner(self, part: str, words: list[str]) -> dict | None:
        """Of all templates, the one that the exact wording confirms; without differences first, then by reduction."""
        checked = {k: self.closest(words, k) for k in TEMPLATES} if words else {}
        confirmed = {k: c for k, c in checked.items() if c["clean"] and c["share"] >= MIN_MATCH and c["to"] > c["from"]}
        if not confirmed:
            return None
        reduction, k = min(((r, k) for r, k in self.rank(part) if k in confirmed), key=lambda c: (len(confirmed[c[1]]["diff"]), -c[0], c[1]))
        return {"license": k, "reduction": reduction, **confirmed[k]}

    def spans(self, block: str) -> list[dict]:
        """All confirmed licenses of a block with their places: the whole, then what a winner leaves, then runs of units."""
        at = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(_lower(block))]
        if not at:
            return []
        ends = {bisect_left(at, (m.end(),)) for m in _UNIT.finditer(block)} - {0}
        out, todo = [], [(0, len(at), True)]
        while todo:
            i, j, runs = todo.pop()
            if i >= j:
                continue
            won = self.winner(block[at[i][0] : at[j - 1][1]], [w for *_, w in at[i:j]])
            if won:
                a, b = i + won["from"], i + won["to"]
                end = at[b - 1][1]
                while end < len(block) and not block[end].isspace() and (b == len(at) or end < at[b][0]):
                    end += 1
                out.append({**won, "from": at[a][0], "to": end})
                todo += [(i, a, runs), (b, j, runs)]
            elif runs:
                # no notice makes up the part: runs of its sentences or lines, the longest first
                cuts = [i, *sorted(e for e in ends if i < e < j), j]
                u = 0
                while u + 1 < len(cuts):
                    for v in range(min(u + MAX_UNITS, len(cuts) - 1), u, -1):
                        if cuts[v] - cuts[u] < j - i and self.winner(block[at[cuts[u]][0] : at[cuts[v] - 1][1]], [w for *_, w in at[cuts[u] : cuts[v]]]):
                            todo.append((cuts[u], cuts[v], False))
                            u = v - 1
                            break
                    u += 1
        return sorted(out, key=lambda r: r["from"])

    def scan(self, text: str) -> list[dict]:
        out = []
        for a, b in blocks(text):
            block = text[a:b]
            reduction, best = self.rank(block)[0]
            found = self.spans(block)
            out += [{"start": a + w["from"], "end": a + w["to"], "license": w["license"], "best": best, "reduction": w["reduction"], "share": w["share"], "differences": " ".join(w["inner"])} for w in found]
            if not found:
                out.append({"start": a, "end": b, "license": None, "reduction": reduction, "best": best, "share": 0.0, "differences": None})
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed notice, and one per block without any (license null): id_col, start, end, license, best (of the whole block), reduction, share, differences."""
    names = ["id", "start", "end", "license", "best", "reduction", "share", "differences"]
    types = dict(zip(names[1:], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True))

    def run(batches):
        scanner = LicenseScanner()
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, t in enumerate(b.column(1)):
                rows += [(ids[i], r) for r in scanner.scan(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *(pa.array([r[c] for _, r in rows], k) for c, k in types.items())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = mapped(rows, run, "id long, start long, end long, license string, best string, reduction double, share double, differences string")
    return out.withColumnRenamed("id", id_col)


def op2_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate blocks of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
