"""License notices by conditional compression.

Candidate blocks are runs of sentences that share the vocabulary of the templates and hold a telling word. Each block is
compressed with zstandard alone and with every template as a raw dictionary; all templates that save bytes are
compared word by word, and the one that is covered best is confirmed with its exact differences in wording."""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import map_batches

SCHEMA = ("doc_id long, licenses array<struct<license:string,start:long,end:long,saved:long,coverage:double,"
          "differences:array<string>>>")

#: Wordings of notices by licence, the first entries being the usual one-line forms.
TEMPLATES = {
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
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission of the copyright holder."),
}
TELLING = re.compile(r"(?i)licen[cs]|copyright|rights reserved|permission (?:is|to)|redistribut|free software|public domain|creative commons|warrant|unencumbered|\bcc ?by|\bcc0")
SENTENCE = re.compile(r"[^\n.;!?]+(?:[.;!?](?=[^\s.;!?])[^\n.;!?]*)*[.;!?]*")
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@functools.cache
def prepared():
    """(licence, wording, its words, its compressor) of every template, the plain compressor and the vocabulary."""
    import zstandard as zstd

    def compressor(**more):
        settings = zstd.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstd.ZstdCompressor(compression_params=settings, **more)

    rows = []
    for name, wordings in TEMPLATES.items():
        for text in wordings:
            bare = " ".join(words(text))
            raw = zstd.ZstdCompressionDict(bare.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            rows.append((name, text, words(text), compressor(dict_data=raw)))
    return rows, compressor(), frozenset(w for r in rows for w in r[2])


def blocks(text: str) -> list[tuple[int, int]]:
    """Runs of consecutive sentences at least three fifths of whose words are template words, one of them telling."""
    _, _, vocabulary = prepared()
    out, run = [], None
    for m in SENTENCE.finditer(text):
        own = words(m.group())
        if not own:
            continue
        if 5 * sum(w in vocabulary for w in own) >= 3 * len(own):
            run = (run[0], m.end()) if run else (m.start() + len(m.group()) - len(m.group().lstrip()), m.end())
        else:
            if run:
                out.append(run)
            run = None
    if run:
        out.append(run)
    return [(a, b) for a, b in out if TELLING.search(text, a, b)]


def differences(wording: list[str], found: list[str]) -> tuple[float, int, int, list[str]]:
    """Share of the wording's words found in order, the places of the first and last of them, and the differences between."""
    matcher = difflib.SequenceMatcher(None, wording, found, autojunk=False)
    same = [b for b in matcher.get_matching_blocks() if b.size]
    if not same:
        return 0.0, 0, 0, []
    first, last = same[0].b, same[-1].b + same[-1].size
    notes = []
    for tag, a1, a2, b1, b2 in difflib.SequenceMatcher(None, wording, found[first:last], autojunk=False).get_opcodes():
        if tag != "equal":
            notes.append(f"{tag}: {' '.join(wording[a1:a2])} -> {' '.join(found[first + b1:first + b2])}")
    return sum(b.size for b in same) / len(wording), first, last, notes


def recognised(text: str, start: int, end: int, least: float = 0.8) -> list[dict]:
    """The licences that the block states, each with the part of the block it takes; a block may hold several."""
    todo, out = [(start, end)], []
    while todo:
        a, b = todo.pop()
        if hit := stated(text, a, b, least):
            out.append(hit)
            todo += [(a, hit["start"]), (hit["end"], b)]
    return sorted(out, key=lambda x: x["start"])


def stated(text: str, start: int, end: int, least: float) -> dict | None:
    """The licence whose wording is covered best there; all templates that save bytes are compared."""
    rows, plain, _ = prepared()
    places = [(m.start(), m.end()) for m in WORD.finditer(text, start, end)]
    found = [text[a:b].lower() for a, b in places]
    if not found:
        return None
    raw = " ".join(found).encode()
    alone = len(plain.compress(raw))
    saved = sorted(((alone - len(r[3].compress(raw)), -k) for k, r in enumerate(rows)), reverse=True)
    best, held = None, Counter(found)
    for gain, k in saved:
        name, _, wording, _ = rows[-k]
        # no more of the wording can be found in order than in any order
        if gain <= 0 or sum((Counter(wording) & held).values()) < least * len(wording):
            continue
        share, first, last, notes = differences(wording, found)
        extra = (last - first) / len(wording)
        if share >= least and extra <= 1.5 and (best is None or (share - 0.05 * len(notes), len(wording)) > best[0]):
            best = ((share - 0.05 * len(notes), len(wording)), name, first, last, gain, share, notes)
    if best is None:
        return None
    _, name, first, last, gain, share, notes = best
    return {"license": name, "start": places[first][0], "end": places[last - 1][1], "saved": gain, "coverage": round(share, 6), "differences": notes}


def scan(text: str) -> list[dict]:
    if not TELLING.search(text):
        return []
    return [x for a, b in blocks(text) for x in recognised(text, a, b)]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses) for each row: licence, place in code points (end exclusive), bytes saved by the template,
    share of its words that were found, and the differences in wording, in the order of the text.

    Null and empty texts have none; null or repeated ids pass through; no rows: no rows. Columns besides ``doc_id`` and
    ``text`` are not read."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(texts, lambda batch: {"doc_id": batch.column(0), "licenses": [scan(t) for t in batch.column(1).to_pylist()]}, SCHEMA)
