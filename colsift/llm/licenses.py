"""License scans by conditional compression.

Lines with a cue ("license", "copyright", ...) and what lies between near ones form a block. Each cue line is scanned as a
notice of its own; if some hold no license, the block is scanned with the lines around it, as a wrapped text may begin or end
on lines without a cue. Long blocks are cut into windows that overlap by more than the longest
template. A block is compressed with zstandard, plain and with each license template as
raw dictionary, each whose words the block has in any order; the bytes it saves rank the templates. They are tried in this
order, as long as they save a byte: a template holds if its exact wording differences show enough of its words in the block in
order, its key words among them, and if no word beside them names another license. The first that holds takes its words, and the
words left are compressed and ranked again until no template holds. Full license texts (folder `license_texts`) are looked for in
the same way first, in all lines of a text with a cue; they are no candidates. The parts of an SPDX expression count as
identifiers of their own. A block without a confirmed license is reported with the best candidate and no license.

Every text is scanned whole; texts without a cue, empty and null texts give no rows. Rows of the same id are scanned one by
one. Ties in rank go to the first template by name. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from importlib.resources import files

import zstandard
from pyspark.sql import DataFrame, functions as F

from colsift.llm.texts import explode_texts, narrow

CUE = r"(?i)licen[cs]e|copyright|spdx|warrant|permission is hereby|redistribution and use|creative commons|\bcc0\b|\bcc[ -]by\b|public domain|\b[al]?gpl"
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")

# Wording of public licenses and of the notices that refer to them, with the words that name the license.
TEMPLATES: dict[str, tuple[str, str]] = {
    "MIT notice": ("mit", "Released under the MIT License."),
    "Apache-2.0 notice": ("apache 2.0", "Licensed under the Apache License, Version 2.0."),
    "GPL-2.0 notice": ("general public 2", "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0 notice": ("general public 3", "This work is licensed under the GNU General Public License, version 3."),
    "LGPL-3.0 notice": ("lesser public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0 notice": ("affero public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    "MPL-2.0 notice": ("mozilla 2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    "BSD-3-Clause notice": ("bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    "BSD-2-Clause notice": ("bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    "CC-BY-4.0 notice": ("cc by 4.0", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0 notice": ("cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0 notice": ("cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND-4.0 notice": ("cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    "CC0-1.0 notice": ("cc0 1.0", "Dedicated to the public domain under CC0 1.0."),
    "MIT": ("", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": ("", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
            "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
            "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
            "SOFTWARE."),
    "BSD-2-Clause": ("", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause": ("neither endorse", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
                     "holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    "Apache-2.0": ("apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                   "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    "GPL-2.0-or-later": ("2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
                         "(at your option) any later version."),
    "GPL-3.0-or-later": ("3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                         "(at your option) any later version."),
    "LGPL-2.0-or-later": ("library 2", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          "Library General Public License as published by the Free Software Foundation; either version 2 of the "
                          "License, or (at your option) any later version."),
    "LGPL-2.1-or-later": ("lesser 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                          "License, or (at your option) any later version."),
    "LGPL-3.0-or-later": ("lesser 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    "AGPL-3.0-or-later": ("affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    "MPL-2.0": ("mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
                  "any purpose, commercial or non-commercial, and by any means."),
}

# Short names of licenses in running text and the identifiers of SPDX tags.
TEMPLATES |= {
    "MIT alternative": ("or mit", "or the MIT license"),
    "GPL-2.0 name": ("gpl v2", "under the GNU GPL v2"),
    "GPL-3.0 name": ("gpl v3", "under the GNU GPL v3"),
    "LGPL-2.1 name": ("lgpl v2.1", "under the GNU LGPL v2.1"),
    "LGPL-3.0 name": ("lgpl v3", "under the GNU LGPL v3"),
    "AGPL-3.0 name": ("agpl v3", "under the GNU AGPL v3"),
    "CC-BY-4.0 name": ("attribution 4.0", "under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0 name": ("attribution-sharealike 4.0", "under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0 name": ("attribution-noncommercial 4.0", "under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0 name": ("attribution-noderivatives 4.0", "under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
IDENTIFIERS = ("MIT", "Apache-2.0", "ISC", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0",
               "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
               "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
               "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")
TAG = "spdx-license-identifier"
TEMPLATES |= {f"{name} identifier": (f"{TAG} {name.lower()}", f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS}

DISCLAIMER = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
              "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
              "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
              "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
              "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
              "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# A first word before the second names another license when a template has only one of them.
RIVALS = {("affero", "general"), ("lesser", "general"), ("library", "general"), ("by", "nc"), ("by", "sa"), ("by", "nd")}


def full_texts() -> dict[str, tuple[str, str]]:
    """The whole texts of licenses, by name like `TEMPLATES`."""
    texts = {name: (TEMPLATES[name][0], TEMPLATES[name][1] + DISCLAIMER) for name in ("BSD-2-Clause", "BSD-3-Clause")}
    for file in files("colsift.llm").joinpath("license_texts").iterdir():
        texts[file.name.removesuffix(".txt")] = "", file.read_text("utf-8")
    return texts


@dataclass(frozen=True)
class Settings:
    """Cue lines up to `gap` lines apart share a block, and as many lines around it are tried. `least_share` of a template's
    words must be there."""

    gap: int = 10
    window: int = 600
    least_share: float = 0.9


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """A template's words, its key words, how often it has each word, and a compressor that knows it."""

    name: str
    words: list[str]
    keys: list[str]
    bag: Counter
    compressor: zstandard.ZstdCompressor

    def may_hold(self, bag: Counter, least_share: float) -> bool:
        """Whether a text with these words can reach the share in any order; no template that holds is passed over."""
        return all(bag[k] for k in self.keys) and sum(min(n, bag[w]) for w, n in self.bag.items()) >= least_share * len(self.words) - 1e-9


def prepared(texts: dict[str, tuple[str, str]]) -> list[Template]:
    known = []
    for name, (keys, text) in sorted(texts.items()):
        own = words(text)
        raw = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.append(Template(name, own, keys.split(), Counter(own), zstandard.ZstdCompressor(level=19, dict_data=raw)))
    return known


@lru_cache(maxsize=1)
def compressors() -> tuple[zstandard.ZstdCompressor, list[Template], list[Template], int]:
    """A plain compressor, the templates, the full texts and the words that hold the longest of them."""
    full = prepared(full_texts())
    return zstandard.ZstdCompressor(level=19), prepared(TEMPLATES), full, max(len(t.words) for t in full) * 5 // 4


def blocks(text: str, gap: int) -> list[tuple[list[int], str]]:
    """(cue lines, text with the lines around) of each run of cue lines and what lies between them."""
    lines = text.split("\n")
    runs: list[list[int]] = []
    for i in (i for i, line in enumerate(lines) if re.search(CUE, line)):
        if runs and i - runs[-1][-1] <= gap:
            runs[-1].append(i)
        else:
            runs.append([i])
    return [(run, "\n".join(lines[max(0, run[0] - gap):run[-1] + gap + 1])) for run in runs]


def compare(template: list[str], block: list[str]) -> tuple[float, set[int], list[str], list[str]]:
    """The share of the template's words that the block has in order, their places in the block, the template's words that are
    missing and the block's words that come between."""
    parts = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    used = {m.b + k for m in parts for k in range(m.size)}
    met = {m.a + k for m in parts for k in range(m.size)}
    span = range(min(used), max(used) + 1) if used else range(0)
    return (len(met) / len(template), used, [w for i, w in enumerate(template) if i not in met],
            [block[i] for i in span if i not in used])


def names_another(template: list[str], block: list[str], used: set[int], missing: list[str]) -> bool:
    """Whether the block inserts, beside words of the template, words that name another license, or lacks all those that name
    the template's own."""
    pairs = [(i in used) + (i + 1 in used) for i, pair in enumerate(zip(block, block[1:])) if pair in RIVALS]
    own = any(pair in RIVALS for pair in zip(template, template[1:]))
    return pairs.count(1) > sum(w in {a for a, b in RIVALS if b == "general"} for w in missing) or own and not any(pairs)


def place(template: Template, block: list[str], free: list[int], settings: Settings) -> tuple | None:
    """`compare` with the free words of the block, if the template holds. Words that name another license are left to that one,
    and the rest is compared again."""
    while True:
        rest = [block[i] for i in free]
        if not template.may_hold(Counter(rest), settings.least_share):
            return None
        share, used, missing, extra = compare(template.words, rest)
        if share < settings.least_share or not {rest[i] for i in used}.issuperset(template.keys):
            return None
        if not names_another(template.words, rest, used, missing):
            return share, {free[i] for i in used}, missing, extra
        free = [place for i, place in enumerate(free) if i not in used]


def row_of(license_id: str | None, template: Template, sizes: tuple[int, int], share: float, missing: list[str], extra: list[str]) -> dict:
    plain, known = sizes
    return {"license_id": license_id, "candidate": template.name, "size_reduction": round((plain - known) / plain, 4),
            "matched_share": round(share, 4), "missing": missing, "extra": extra}


def ranked(words_: list[str], known: list[Template]) -> list[tuple[int, int, Template]]:
    """(compressed size plain, with the template as dictionary, template), the largest reduction first, ties by name."""
    data = " ".join(words_).encode("utf-8", "surrogatepass")
    plain = len(compressors()[0].compress(data))
    return sorted(((plain, len(t.compressor.compress(data)), t) for t in known), key=lambda r: (r[1], r[2].name))


def confirm(block: list[str], known: list[Template], settings: Settings) -> tuple[list[tuple[dict, set[int]]], set[int]]:
    """The confirmed licenses of a window with the places of their words, in the order of their reductions, and all places taken.
    After each the words left are compressed and ranked anew. A template that saves nothing explains nothing and ends the walk;
    those that lack words are not compressed, as they cannot hold."""
    found: list[tuple[dict, set[int]]] = []
    free = list(range(len(block)))
    while True:
        rest = [block[i] for i in free]
        bag = Counter(rest)
        held = None
        for plain, size, t in ranked(rest, [t for t in known if t.may_hold(bag, settings.least_share)]):
            if size >= plain:
                break
            held = place(t, block, free, settings)
            if held:
                break
        if not held:
            return found, set(range(len(block))) - set(free)
        share, used, missing, extra = held
        found.append((row_of(t.name, t, (plain, size), share, missing, extra), used))
        free = [i for i in free if i not in used]


def scan_window(block: list[str], settings: Settings) -> list[dict]:
    """The confirmed licenses of a window, best first; without any the best candidate alone."""
    known = compressors()[1]
    found, _ = confirm(block, known, settings)
    if found:
        return list({row["license_id"]: row for row, _ in reversed(found)}.values())[::-1]
    plain, size, best = ranked(block, known)[0]
    share, _, missing, extra = compare(best.words, block)
    return [row_of(None, best, (plain, size), share, missing, extra)]


def spelled_out(found: list[str]) -> list[str]:
    """The words with the tag repeated before each further identifier of an SPDX expression."""
    out: list[str] = []
    expression = False  # whether the word before is an identifier of an expression
    for w in found:
        before, expression = expression, bool(out) and out[-1] == TAG
        if before and w in ("or", "and"):
            out += [w, TAG]
        else:
            out.append(w)
            if before and w == "with":
                expression = None  # what follows names an exception, and the expression may go on after it
            elif before is None:
                expression = True
    return out


def scan_block(block: str, settings: Settings) -> dict[str | None, dict]:
    """The best row for each license found in the windows of a block; None stands for no license."""
    all_words, step = spelled_out(words(block)), settings.window // 2
    best: dict[str | None, dict] = {}
    for at in range(0, max(1, len(all_words) - step), step):
        for row in scan_window(all_words[at:at + settings.window], settings) if all_words else []:
            old = best.get(row["license_id"])
            if old is None or row["matched_share"] > old["matched_share"]:
                best[row["license_id"]] = row
    if len(best) > 1:
        best.pop(None, None)
    return best


def take_full_texts(lines: list[str], settings: Settings) -> tuple[list[tuple[int, int, dict]], list[str]]:
    """(first line, last line, row) of each full license text, and the lines without their words. Such texts have long parts
    without a cue, so they are looked for in all lines, in windows that hold the longest."""
    _, _, full, step = compressors()
    spans: list[tuple[int, int, dict]] = []
    found = [words(line) for line in lines]
    every, line_of = [w for own in found for w in own], [i for i, own in enumerate(found) for _ in own]
    taken: set[int] = set()
    shortest = settings.least_share * min(len(t.words) for t in full)
    for at in range(0, max(1, len(every) - step), step):
        free = [i for i in range(at, min(at + 2 * step, len(every))) if i not in taken]
        rows, _ = confirm([every[i] for i in free], full, settings) if len(free) >= shortest else ([], set())
        for row, used in rows:
            taken |= {free[i] for i in used}
            spans.append((line_of[free[min(used)]], line_of[free[max(used)]], row))
    touched = {line_of[i] for i in taken}
    kept: dict[int, list[str]] = {i: [] for i in touched}
    for i, w in enumerate(every):
        if line_of[i] in touched and i not in taken:
            kept[line_of[i]].append(w)
    return spans, [" ".join(kept[i]) if i in touched else line for i, line in enumerate(lines)]


def scan_text(text: str, settings: Settings) -> list[dict]:
    """A row per block and license of a text; notices are blocks of one line."""
    full_spans, lines = take_full_texts(text.split("\n"), settings)
    found = [[span] for span in full_spans]
    for cues, around in blocks("\n".join(lines), settings.gap):
        notices = [(i, row) for i in cues for name, row in scan_block(lines[i], settings).items() if name]
        whole: dict[str | None, dict] = {}
        if {i for i, _ in notices} != set(cues):
            whole = scan_block(around, settings)
            if notices:
                whole.pop(None, None)
        # a notice inside a license text of the same name is part of that text
        full = {re.split("[ -]", name)[0] for name in whole if name}
        spans = [(i, i, row) for i, row in notices if re.split("[ -]", row["license_id"])[0] not in full]
        spans += [(cues[0], cues[-1], row) for name, row in whole.items()
                  if name is None or name not in {r["license_id"] for _, _, r in spans}]
        found.append(sorted(spans, key=lambda s: (s[0], s[1], str(s[2]["license_id"]))))
    found = sorted((spans for spans in found if spans), key=lambda spans: spans[0][:2])
    return [{"block": number, "first_line": a, "last_line": b, **row} for number, spans in enumerate(found) for a, b, row in spans]


ROWS = ("block int, first_line int, last_line int, license_id string, candidate string, size_reduction double, "
        "matched_share double, missing array<string>, extra array<string>")


def scan_licenses(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, block, its lines, license_id, candidate, size_reduction (the share of the compressed size that the template
    saves), matched_share, and the wording differences: `missing` words of the template, `extra` words of the block."""
    rows = narrow(docs, id_column, text_column).filter(F.col("text").rlike(CUE))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in ROWS.split(", "))]

    def make():
        def add(columns):
            found = [{"doc_id": i, **row} for i, text in zip(columns["doc_id"], columns["text"]) for row in scan_text(text, settings)]
            if found:
                yield {n: [row[n] for row in found] for n in names}

        return add, lambda: iter(())

    return explode_texts(rows, make, f"doc_id {id_type}, {ROWS}")
