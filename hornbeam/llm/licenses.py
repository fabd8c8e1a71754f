"""License notices in documents, by conditional compression.

Blocks of text that may hold a notice are compressed alone and with each template as a zstandard raw-content
dictionary, in pieces of twice the template's words (PIECE words at least) that overlap by half, as a short notice saves
next to nothing of a long block. The bytes that a template saves of a piece, as a share of those that it saves of itself,
are about 1 if the piece holds its wording and about 0 if not. Templates are ranked by that gain, and all of at
least LEAST are confirmed by their wording, the best first: the template's words are aligned with the block's, and words
that are missing, or foreign within the aligned span, must be at most ALLOWED of the template's words, with no difference
in words that tell licenses apart (those with a digit, and KEYS). LEAST is far below what a confirmed wording saves: it
spares alignments, and tests hold it against aligning every template.

Candidate blocks: each line with one of TRIGGERS, and each paragraph (text between blank lines) with one or, if it has
more than WINDOW words, windows of WINDOW words that overlap by half; a license is counted by line, else by paragraph. Whole texts are
searched. All work is local to a document: nothing is shuffled but the few notices found.

Defined cases: null and empty texts hold no notice; a notice that occurs in several blocks of a document is one row
with n_blocks > 1; rows that repeat a doc_id are joined to one row; a null doc_id is kept; very long texts without a
line break are windows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, ALLOWED, PIECE, LEAST, LEVEL = 400, 0.1, 60, 0.2, 3
#: Usual wordings of notices, by SPDX identifier or a name of our own in lower case.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
#: What a license is if the text has another's clause too: the notice that both begin with names the shorter one.
WITH = [("BSD-2-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-4-Clause"), ("BSD-3-Clause", "BSD-4-Clause")]
KEYS = frozenset("lesser affero noncommercial sharealike noderivatives mit apache mozilla bsd".split())
#: Every template has one of these; a block without any is no candidate.
TRIGGERS = ("licens", "rights reserved", "permission", "redistribut", "advertising materials")
_WORD = re.compile(r"[^\W_]+(?:[-./'][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def candidates(text: str, triggers: tuple[str, ...] = TRIGGERS) -> list[tuple[list[str], list[str]]]:
    """For each paragraph that may hold a notice, its lines that may, and the paragraph itself or windows of it."""
    has = lambda s: any(t in s for t in triggers)
    if not has(text.lower()):
        return []
    found = []
    for paragraph in re.split(r"\n[^\S\n]*\n", text):
        if not has(paragraph.lower()):
            continue
        lines = paragraph.split("\n")
        whole = paragraph.split()
        if len(whole) > WINDOW:
            windows = [" ".join(whole[at : at + WINDOW]) for at in range(0, len(whole), WINDOW // 2)]
            windows = [w for w in windows if has(w.lower())]
        else:
            windows = [paragraph] if len(lines) > 1 else []
        found.append(([x for x in lines if has(x.lower()) and len(x.split()) <= WINDOW], windows))
    return found


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        quiet = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**quiet)
        self.templates = []
        for name, text in templates:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given = zstandard.ZstdCompressor(dict_data=raw, **quiet)
            own = len(self.alone.compress(text.encode())) - len(given.compress(text.encode()))
            self.templates.append((name, words(text), given, own, max(PIECE, 2 * len(text.split()))))

    def differences(self, template: list[str], block: list[str], matcher: SequenceMatcher) -> int | None:
        """Words by which the block's wording of the template differs; None if a telling word does. matcher has the block."""
        matcher.set_seq1(template)
        parts = [m for m in matcher.get_matching_blocks() if m.size]
        if not parts:
            return None
        # a stray word far from the rest of the wording is no part of it
        best = max(parts, key=lambda m: m.size)
        parts = [m for m in parts if abs((m.b - m.a) - (best.b - best.a)) <= max(2, len(template) // 4)]
        same = {i for m in parts for i in range(m.a, m.a + m.size)}
        begin, end = parts[0].b, parts[-1].b + parts[-1].size
        there = {i for m in parts for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(template) if i not in same]
        foreign = [w for i, w in enumerate(block[begin:end], begin) if i not in there]
        if any(w in KEYS or any(c.isdigit() for c in w) for w in missing + foreign):
            return None
        return max(len(missing), len(foreign)) if missing or foreign else 0

    def ranked(self, block: str) -> list[tuple[float, float, int]]:
        """Gain, share of a piece's compressed size that is saved, and number of each template that saves enough, the best first."""
        whole, pieces = block.split(), {}
        for size in {t[4] for t in self.templates}:
            cut = [" ".join(whole[at : at + size]).encode("utf-8", "surrogatepass") for at in range(0, max(1, len(whole) - size // 2), size // 2)]
            pieces[size] = [(x, len(self.alone.compress(x))) for x in cut]
        found = []
        for i, (_, _, given, own, size) in enumerate(self.templates):
            saved, alone = max((alone - len(given.compress(x)), alone) for x, alone in pieces[size])
            if saved >= LEAST * own:
                found.append((saved / own, saved / alone, i))
        return sorted(found, key=lambda x: (-x[0], x[2]))

    def confirmed(self, block: str) -> dict[str, tuple[float, int]]:
        """The licenses whose wording the block has, with size reduction and differing words."""
        own = words(block)
        there, matcher = set(own), SequenceMatcher(None, (), own, autojunk=False)
        out: dict[str, tuple[float, int]] = {}
        for _, reduction, i in self.ranked(block):
            name, template = self.templates[i][:2]
            # words that the block has nowhere are missing in every alignment
            if sum(w not in there for w in template) <= ALLOWED * len(template):
                n = self.differences(template, own, matcher)
                if n is not None and n <= ALLOWED * len(template) and (name not in out or n < out[name][1]):
                    out[name] = (reduction, n)
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """License, size reduction and differing words for each block; what a line shows, its paragraph doesn't again."""
        out = []
        for lines, windows in candidates(text or ""):
            by_line = [(name, *x) for line in lines for name, x in self.confirmed(line).items()]
            seen = {x[0] for x in by_line}
            out += by_line + [(name, *x) for w in windows for name, x in self.confirmed(w).items() if name not in seen]
        for name, longer in WITH:
            if any(x[0] == longer for x in out):
                out = [(longer, *x[1:]) if x[0] == name else x for x in out]
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, n_blocks (blocks in which it was confirmed), differences (least) and reduction (largest)."""
    templates = templates or TEMPLATES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                for x in scanner.scan(text.as_py()):
                    rows.append(i)
                    found.append(x)
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32())], names=["doc_id", "license", "reduction", "differences"])

    rows = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, license string, reduction double, differences int")
    return rows.groupBy("doc_id", "license").agg(F.count("*").alias("n_blocks"), F.min("differences").alias("differences"), F.max("reduction").alias("reduction"))
