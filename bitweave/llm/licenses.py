"""License scans by conditional compression.

Candidate blocks are windows of ``WINDOW`` characters, overlapping by ``OVERLAP``, around the license words of a text; the
license words hold one word of every wording, so no block that could be confirmed is left out. Each block is compressed
with every template as a zstandard raw dictionary and alone; templates are ranked by the share of bytes that they save
and held against the block word by word, in that order:

* a notice (a whole text) whose template saves ``least`` of the bytes must be there with at most ``missing`` of its words
  missing and ``added`` as many others between, in the block or around it;
* a phrase (a few words that name a license) must be there in order, with at most ``slack`` other words in each gap, none
  of them forbidden. So few characters save less than the noise of a block, so no saving is asked for.

A block may confirm several templates. Each finding tells from where to where the wording goes (characters), the bytes
saved and the difference: ``-word`` for what is missing, ``+word`` for what is added. What is said in the negative ("not
under the MIT License") is reported as negated and gives a document no license. A phrase within a confirmed notice of
its license isn't reported again.

Nulls: a null or empty text has no finding; a null id is an id like others. Very long texts are scanned whole. Ties: equal
savings fall to the template first by name. Repeated rows: each has its own findings. Equal blocks are judged once a
batch. Empty table: an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.held import held, small_batches

BASE = "licen[sc]e|copyright|warrant|spdx|public domain|all rights reserved|creativecommons|creative commons|cc[ -]by|cc0|as is"
_WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9+]", re.I)
_BROKEN = re.compile(r"-[ \t]*\r?\n\s*")
_STOP = re.compile(r"[.;:!?](\s|$)")
_NOT = frozenset({"not", "never", "no", "isn", "aren", "wasn", "weren", "cannot", "neither", "nor", "without", "unlike"})
WINDOW, OVERLAP, SLACK, MISSING, ADDED, LEAST = 1_200, 400, 2, 0.1, 0.15, 0.05


@dataclass(frozen=True)
class Template:
    """An identifier, a notice to compress with, phrases of which one must occur, words that none of them may have between."""

    name: str
    text: str
    phrases: tuple[str, ...]
    forbidden: tuple[str, ...] = ()


TEMPLATES = (
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', ("apache license version 2.0", "apache-2.0", "apache 2.0 license")),
    Template("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ("mit license", "license mit", "spdx-license-identifier mit")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license version 3", "gnu general public license v3", "gpl-3.0", "gplv3", "gnu general public license either version 3", "gnu general public license as published by the free software foundation either version 3"), ("lesser", "affero")),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license version 2", "gnu general public license v2", "gpl-2.0", "gplv2", "gnu general public license either version 2", "gnu general public license as published by the free software foundation either version 2"), ("lesser", "affero")),
    Template("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 or version 3 of the License.", ("gnu lesser general public license", "lgpl-2.1", "lgpl-3.0", "lgplv3")),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", ("gnu affero general public license", "agpl-3.0", "agplv3")),
    Template("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.', ("bsd 3-clause", "bsd-3-clause", "3-clause bsd")),
    Template("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.', ("bsd 2-clause", "bsd-2-clause", "2-clause bsd")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license v 2.0", "mozilla public license version 2.0", "mpl-2.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.", ("cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0"), ("noncommercial", "sharealike", "noderivatives")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0.", ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0")),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0.", ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0"), ("sharealike", "noderivatives")),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal. This work is dedicated to the public domain.", ("cc0 1.0", "cc0-1.0", "dedicated to the public domain")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.", ("free and unencumbered software released into the public domain",)),
    Template("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.', ("isc license", "license isc", "spdx-license-identifier isc")),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.", ("zlib license", "spdx-license-identifier zlib")),
    Template("All-Rights-Reserved", "Copyright (c). All rights reserved. No part of this work may be reproduced without permission.", ("all rights reserved",)),
)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, from, to) of each word; one broken over lines at its hyphen is whole."""
    out: list[tuple[str, int, int]] = []
    for m in _WORD.finditer(text):
        if out and _BROKEN.fullmatch(text, out[-1][2], m.start()):
            out[-1] = (f"{out[-1][0]}-{m[0].lower()}", out[-1][1], m.end())
        else:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def words(text: str) -> list[str]:
    return [w for w, _, _ in spans(text)]


def hints(templates: tuple[Template, ...]) -> str:
    """A pattern that is in every text that holds a phrase or a notice: of each phrase one word, whatever stands between
    its words; notices hold one of BASE many times."""
    out = [BASE]
    for phrase in (p for t in templates for p in t.phrases):
        own = words(phrase)
        if not any(re.search(BASE, w) for w in own):
            anchor = max((w for w in own if re.search("[a-z]", w)), key=len, default=own[0])
            own = re.escape(anchor).replace(r"\-", r"-\s*")
            out.append(own if len(anchor) > 2 else rf"\b{own}\b")
    return "|".join(dict.fromkeys(out))


def windows(text: str, hint: re.Pattern | None) -> list[tuple[int, int]]:
    """(from, to) of the candidate blocks: stretches around license words (all of the text without ``hint``), cut into
    overlapping windows."""
    reach, joined = WINDOW // 2, []
    if hint is None:
        joined = [[0, len(text)]]
    else:
        for m in hint.finditer(text):
            lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = hi
            else:
                joined.append([lo, hi])
    out = []
    for lo, hi in joined:
        while hi - lo > WINDOW:
            out.append((lo, lo + WINDOW))
            lo += WINDOW - OVERLAP
        out.append((lo, hi))
    return out


def wording(block: list[str], phrase: list[str], slack: int = SLACK, forbidden: frozenset[str] = frozenset()) -> list[tuple[int, int, list[str]]]:
    """(first word, last word, words between) of each place where the phrase occurs in order, at most ``slack`` others in
    each gap, none of them forbidden; of those that begin at one word the one with the fewest between."""
    out = []
    for i, w in enumerate(block):
        if w != phrase[0]:
            continue
        states = {i: []}
        for p in phrase[1:]:
            nxt: dict[int, list[str]] = {}
            for at, extra in states.items():
                for j in range(at + 1, min(len(block), at + 2 + slack)):
                    if block[j] == p and forbidden.isdisjoint(block[at + 1 : j]):
                        more = extra + block[at + 1 : j]
                        if j not in nxt or len(more) < len(nxt[j]):
                            nxt[j] = more
            states = nxt
        if states:
            j = min(states, key=lambda j: (len(states[j]), j))
            out.append((i, j, states[j]))
    return out


def aligned(block: list[str], notice: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """First and last word of the notice in the block, its words that are missing, and others between."""
    parts = [m for m in difflib.SequenceMatcher(None, notice, block, autojunk=False).get_matching_blocks() if m.size > 1]
    if not parts:
        return None
    lo, hi = parts[0].b, parts[-1].b + parts[-1].size
    in_notice, in_block = [False] * len(notice), [False] * len(block)
    for m in parts:
        in_notice[m.a : m.a + m.size] = [True] * m.size
        in_block[m.b : m.b + m.size] = [True] * m.size
    return lo, hi - 1, [w for w, x in zip(notice, in_notice) if not x], [block[k] for k in range(lo, hi) if not in_block[k]]


class Scanner:
    def __init__(self, templates: tuple[Template, ...] = None, slack: int = SLACK, missing: float = MISSING, added: float = ADDED, least: float = LEAST, level: int = 3):
        import zstandard

        self.templates = sorted(templates or TEMPLATES, key=lambda t: t.name)
        self.phrases = [[words(p) for p in t.phrases] for t in self.templates]
        self.notices = [words(t.text) for t in self.templates]
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        given = lambda t: zstandard.ZstdCompressionDict(" ".join([*t.phrases, t.text]).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=given(t)) for t in self.templates]
        self.slack, self.missing, self.added, self.least = slack, missing, added, least
        self.hint = re.compile(hints(tuple(self.templates)), re.I)
        self.reach = max(len(t.text) for t in self.templates) * 3 // 2

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of bytes saved, template), most first."""
        raw = " ".join(w for w, _, _ in spans(block)).encode()
        own = len(self.alone.compress(raw))
        saved = [((own - len(c.compress(raw))) / own, k) for k, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def negated(self, text: str, at: int) -> bool:
        """Whether a negation is among the six words before, in the same sentence."""
        before = text[max(0, at - 80) : at]
        stops = [m.end() for m in _STOP.finditer(before)]
        own = before[stops[-1] :] if stops else before
        return not _NOT.isdisjoint(re.findall("[a-z]+", own.lower())[-6:])

    def judge(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str, float, str, bool]]:
        """from, to, license, saved, difference, negated of what the block text[lo:hi] confirms."""
        out = []
        own = spans(text[lo:hi])
        block = [w for w, _, _ in own]
        for saved, k in self.ranked(text[lo:hi]):
            t, notice = self.templates[k], self.notices[k]
            for phrase in self.phrases[k]:
                for i, j, extra in wording(block, phrase, self.slack, frozenset(t.forbidden)):
                    a, b = lo + own[i][1], lo + own[j][2]
                    out.append((a, b, t.name, saved, " ".join("+" + w for w in extra), self.negated(text, a)))
            if saved < self.least:
                continue
            here = difflib.SequenceMatcher(None, notice, block, autojunk=False).find_longest_match()
            if here.size >= min(8, len(notice)):  # looked for around, as a notice may be longer than a block
                begin = max(0, lo + own[here.b][1] - self.reach)
                wide = spans(text[begin : lo + own[here.b][2] + self.reach])
                got = aligned([w for w, _, _ in wide], notice)
                if got and len(got[2]) <= self.missing * len(notice) and len(got[3]) <= self.added * len(notice):
                    out.append((begin + wide[got[0]][1], begin + wide[got[1]][2], t.name, saved, " ".join(["-" + w for w in got[2]] + ["+" + w for w in got[3]]), False))
        return out

    def find(self, text: str, judged: dict | None = None, every: bool = False) -> list[tuple[int, int, str, float, str, bool]]:
        """All findings of a text in order, each once, with the most that a block saved; ``every``: by all windows."""
        best: dict[tuple[int, int, str], tuple[float, str, bool]] = {}
        for lo, hi in windows(text, None if every else self.hint):
            key = text if len(text) <= WINDOW else None
            got = judged.get(key) if judged is not None and key else None
            if got is None:
                got = self.judge(text, lo, hi)
                if judged is not None and key:
                    judged[key] = got
            for a, b, name, saved, diff, no in got:
                if (a, b, name) not in best or best[a, b, name][0] < saved:
                    best[a, b, name] = (saved, diff, no)
        rows = sorted((a, b, name, *x) for (a, b, name), x in best.items())
        return [r for r in rows if not any(o is not r and o[2] == r[2] and o[0] <= r[0] and r[1] <= o[1] and (o[:2] != r[:2]) for o in rows)]


def _scan(templates: tuple[Template, ...], slack: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        args = (templates, slack)
        scanner = held(("licenses", args), lambda: Scanner(*args))
        for pdf in batches:
            judged: dict = {}
            rows = [(k, *r) for k, t in zip(pdf["k"], pdf["t"]) for r in scanner.find(t, judged)]
            yield pd.DataFrame(rows, columns=["k", "from", "to", "license", "saved", "difference", "negated"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """key, from, to (characters), license, saved, difference, negated of each wording found; a narrow plan."""
    kind = dict(docs.dtypes)[key]
    # the word filter runs in the JVM; only texts with a license word reach Python
    slim = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(f"(?i)({hints(templates)})"))
    return slim.mapInPandas(_scan(templates, slack), f"k {kind}, from long, to long, license string, saved double, difference string, negated boolean").withColumnRenamed("k", key)


def documents(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, licenses (ascending), n_blocks (wordings), saved (the most) of each document with a finding that isn't negated."""
    return found.where("not negated").groupBy(key).agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.countDistinct("from", "to").alias("n_blocks"), F.max("saved").alias("saved"))
