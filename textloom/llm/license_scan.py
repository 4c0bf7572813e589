"""License scans by conditional compression.

Lines that hold a trigger word, the paragraph around them, and the lines before and after, over blank
lines too, as far as each added one is compressed better with a template, are candidate blocks. Each block is
compressed alone and with each license template as zstandard raw dictionary; the share of its size
that a template saves ranks the templates. The best ones are confirmed by exact wording: the words that have to
be inserted, deleted or replaced between the block and the part of the template it covers. A block
names a license if these are at most ``differences`` per cent of its words.

Null and empty texts, and texts without a trigger word, have no block: license is null, n_blocks 0. Of several
blocks the one with the fewest differences per word names the document, then the longest, then the
first. Repeated rows are scanned alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Public wordings of licenses and of the notices that refer to them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}

TRIGGER = r"(?i)licen[sc]|copyright|warrant(?:y|ies)|permission (?:is hereby granted|to use)|redistribution|public domain|creative commons|\bcc(?:0| by)\b"
_trigger = re.compile(TRIGGER)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


@dataclass(frozen=True)
class LicenseOptions:
    confirm: int = 3  # templates with the largest savings that are compared word by word
    least_saving: int = 15  # per cent
    differences: int = 10  # per cent of the words
    around: int = 12  # lines of a paragraph after a trigger line that are one of its blocks; others have no bound


class _Scanner:
    def __init__(self, options: LicenseOptions):
        self.options = options
        self.plain = zstandard.ZstdCompressor(9, write_content_size=False)
        self.with_template = []
        for name, wordings in TEMPLATES.items():
            for text in wordings:
                raw = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.with_template.append((name, WORD.findall(text.lower()), zstandard.ZstdCompressor(9, dict_data=raw, write_content_size=False)))

    def blocks(self, lines: list[str]):
        """(first line, end line, block): each trigger line alone and with those of its paragraph that follow it, and
        the whole paragraph once."""
        done = 0
        for i, line in enumerate(lines):
            if _trigger.search(line):
                yield i, i + 1, line
                z = i + 1
                while z < len(lines) and z <= i + self.options.around and lines[z].strip():
                    z += 1
                if z > i + 1:
                    yield i, z, " ".join(lines[i:z])
                if i >= done:
                    a = i
                    while a > 0 and lines[a - 1].strip():
                        a -= 1
                    done = i + 1
                    while done < len(lines) and lines[done].strip():
                        done += 1
                    if (a, done) not in ((i, z), (i, i + 1)):
                        yield a, done, " ".join(lines[a:done])

    def sizes(self, block: str, k: int) -> tuple[int, int]:
        """Compressed size, and how much template k saves of it."""
        folded = _folded(block)
        alone = len(self.plain.compress(folded))
        return alone, alone - len(self.with_template[k][2].compress(folded))

    def grown(self, lines: list[str], i: int, k: int) -> tuple[int, int]:
        """Bounds of the lines around line i, blank ones aside, each of which template k saves enough of."""
        bounds, now = [i, i + 1], self.sizes(lines[i], k)
        for side, step in ((1, 1), (0, -1)):
            at = i + step
            while 0 <= at < len(lines):
                if WORD.search(lines[at].lower()):
                    wider = self.sizes(" ".join(lines[bounds[0] : at + 1] if side else lines[at : bounds[1]]), k)
                    if 100 * (wider[1] - now[1]) < self.options.least_saving * max(1, wider[0] - now[0]):
                        break
                    bounds[side], now = at + side, wider
                at += step
        return bounds[0], bounds[1]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(saving, template) of those with the largest savings, if these are large enough."""
        folded = _folded(block)
        alone = len(self.plain.compress(folded))
        savings = sorted(((alone - len(c.compress(folded))) / alone, -k) for k, (_, _, c) in enumerate(self.with_template))
        return [(saving, -k) for saving, k in reversed(savings[-self.options.confirm :]) if 100 * saving >= self.options.least_saving]

    def judge(self, block: str, ranked: list[tuple[float, int]] | None = None):
        """(differences, words, -saving, name) of the best template, or None."""
        words, best = WORD.findall(block.lower()), None
        for saving, k in self.ranked(block) if ranked is None else ranked:
            if not words:
                break
            name, template, _ = self.with_template[k]
            wrong = differences(words, template)
            if 100 * wrong <= self.options.differences * min(len(words), len(template)):
                found = (wrong / len(template), -len(template), -saving, name, wrong)
                best = min(best, found) if best else found
        return best

    def scan(self, text: str):
        n, best, covered = 0, None, 0
        lines = text.split("\n")

        def take(at, found):
            nonlocal n, best
            n += 1
            if found and (best is None or (*found[:3], at) < (*best[0][:3], best[1])):
                best = (found, at)

        for a, z, block in self.blocks(lines):
            ranked = self.ranked(block)
            take(a, self.judge(block, ranked))
            if z == a + 1 and a >= covered and len(lines) > 1:
                for x, y in sorted({self.grown(lines, a, k) for _, k in ranked} - {(a, z)}):
                    found = self.judge(" ".join(lines[x:y]))
                    take(x, found)
                    if found:
                        covered = max(covered, y)
        return n, best


def _folded(block: str) -> bytes:
    return " ".join(block.lower().split()).encode()


def differences(words: list[str], template: list[str]) -> int:
    """Words inserted, deleted or replaced between the template and the part of words that covers it best."""
    match = SequenceMatcher(None, words, template, autojunk=False)
    same = [b for b in match.get_matching_blocks() if b.size]
    if not same:
        return len(template)
    a, z = same[0].a, same[-1].a + same[-1].size
    inside = words[max(0, a - same[0].b) : z + len(template) - (same[-1].b + same[-1].size)]
    wrong = 0
    for kind, i, j, k, m in SequenceMatcher(None, inside, template, autojunk=False).get_opcodes():
        if kind != "equal":
            wrong += max(j - i, m - k)
    return wrong


def scan_licenses(docs: DataFrame, options: LicenseOptions = LicenseOptions()) -> DataFrame:
    """doc_id, license, line (of the block), saving (share of the block's size), n_differences, n_blocks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # texts without a trigger never leave the JVM
    slim = docs.select("doc_id", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text"))

    def run(batches):
        scanner = _Scanner(options)
        for b in batches:
            out = [scanner.scan(t) if t else (0, None) for t in b.column("text").to_pylist()]
            hit = [x[1] for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([h[0][3] if h else None for h in hit], pa.string()),
                    pa.array([h[1] if h else None for h in hit], pa.int32()),
                    pa.array([-h[0][2] if h else None for h in hit], pa.float64()),
                    pa.array([h[0][4] if h else None for h in hit], pa.int32()),
                    pa.array([x[0] for x in out], pa.int32()),
                ],
                names=["doc_id", "license", "line", "saving", "n_differences", "n_blocks"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, license string, line int, saving double, n_differences int, n_blocks int")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
