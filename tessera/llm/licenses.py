"""Licence scan: sparse TF-IDF cosine of sentences to licence templates, then inheritance along directories.

A text's sentences are read twice, line by line and with the lines of a paragraph joined (comment leaders removed).
Those that hold a term without which no template reaches the threshold are compared with every template by the cosine of
TF-IDF vectors with two terms or more in common (term counts; idf = ln((1 + n) / (1 + df)) + 1 over the templates; unknown
terms have df 0). The templates are few and fixed, so their weights travel to the texts: one pass, no shuffle of texts.

Templates are notices, which say under what licence something stands, and sentences of the licences' own texts: all of
them for short licences, titles and opening sentences for long ones. A text with two or more of a licence's own sentences
has that licence; licences share sentences, so the one counts of which most is there and least is left out before the
last of them (a sentence counts for the templates that it is nearest to). Else the best notice at or over the threshold is the text's own
licence; reserved rights count only where nothing else is found. A text is the licence file of its directory if it names
itself one, if a fair share of its words stand in such sentences, or if it holds the opening of a long licence. A text without a licence of its own takes that of the nearest directory above it that has a
licence file. Directories are resolved once each, so a directory that holds most files is one row there.

The gate to the comparison follows from the templates: by Cauchy and Schwarz the squared weights of a template's terms in
a sentence at the threshold add up to its square or more, so no sentence at the threshold is left out by it.

Defined results: null text counts as empty and has no licence of its own, but can inherit; a null path has no directory;
ties go to the licence that comes first by name, and of licence files of one directory to the best score, then the least
path; rows that repeat get equal results; an empty table gives no rows; clashing columns are not read; very long texts
are read whole, and a sentence of any length is one sentence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Words of ordinary prose, the most frequent first; the gate to the comparison does without them as far as it can.
COMMON = "the of and to a in is that it for as be with this are not by or you at all can any use work may under without your from found file".split()
ENDS = re.compile(r"(?<=[.!?])\s+", re.ASCII)
PARTS = re.compile(r"\n[\s#/*;%-]*\n", re.ASCII)
SPACE = " \t\n\r\f\v"
LEADERS = SPACE + "#/*;%-"
WORDS = re.compile(r"\S+", re.ASCII)
#: Of the licences found in a text, this one counts only if there is no other: files under a licence also reserve rights.
RESERVED = "proprietary"
THRESHOLD = 0.6
#: Share of words in licence sentences from which on a text is a licence file.
FILE_SHARE = 0.25
FILE_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-].*)?$"
#: Usual wordings of licence notices.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": ("Licensed under the ISC license.", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved.", "Proprietary and confidential, all rights reserved."),
}


BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Sentences of the licences' own texts, whole where they are short.
BODIES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": (
        *BSD[:3],
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        *BSD[3:],
    ),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
        "Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        VERBATIM,
        "The licenses for most software are designed to take away your freedom to share and change it.",
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        VERBATIM,
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        VERBATIM,
        "This is the first released version of the Lesser GPL.",
        "It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        VERBATIM,
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        VERBATIM,
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
}
#: Licences of whose text only the opening is listed.
LONG = frozenset(("Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"))


def template_weights(templates: dict[str, tuple[str, ...]] = TEMPLATES, bodies: dict[str, tuple[str, ...]] | None = None) -> tuple[list[tuple[str, str, float, float]], float]:
    """(template, term, idf, unit weight) rows, and the idf of unknown terms. Templates are named licence#k, or licence@k for its own sentences."""
    listed = [(f"{name}{sign}{k}", text) for sign, of in (("#", templates), ("@", bodies or {})) for name, texts in sorted(of.items()) for k, text in enumerate(texts)]
    named = [(name, Counter(re.findall(TERM, text.lower()))) for name, text in listed]
    df = Counter(t for _, terms in named for t in terms)
    idf = {t: math.log((1 + len(named)) / (1 + d)) + 1 for t, d in df.items()}
    rows = []
    for name, terms in named:
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in terms.items()))
        rows += [(name, t, idf[t], c * idf[t] / norm) for t, c in sorted(terms.items())]
    return rows, math.log(1 + len(named)) + 1


def gate(rows: list[tuple[str, str, float, float]], threshold: float) -> set[str]:
    """Terms of which every sentence at or over the threshold to some template holds one.

    Terms of a template that weigh too little together can be left out, for one of the others is there; common words
    are left out first.
    """
    of: dict[str, list[tuple[int, float, str]]] = {}
    for name, term, _, weight in rows:
        of.setdefault(name, []).append((COMMON.index(term) if term in COMMON else len(COMMON), weight, term))
    kept: set[str] = set()
    for terms in of.values():
        left_out = 0.0
        for _, weight, term in sorted(terms):
            if left_out + weight * weight < threshold * threshold - 1e-9:
                left_out += weight * weight
            else:
                kept.add(term)
    return kept


class Scanner:
    """Finds the licence of one text."""

    def __init__(self, threshold: float, templates: dict[str, tuple[str, ...]], bodies: dict[str, tuple[str, ...]]):
        rows, self.unknown = template_weights(templates, bodies)
        self.threshold = threshold
        self.idf = {t: i for _, t, i, _ in rows}
        self.weights: dict[str, list[tuple[str, float]]] = {}
        for name, term, _, weight in rows:
            self.weights.setdefault(term, []).append((name, weight))
        self.term = re.compile(TERM)
        self.gate = gate(rows, threshold)
        self.find = ahocorasick.Automaton()
        for term in self.gate:
            self.find.add_word(term, len(term))
        if self.gate:
            self.find.make_automaton()

    def hits(self, low: str) -> list[int]:
        """Where gate terms end that stand between other characters than letters and digits; low: in lower case."""
        out, n = [], len(low)
        for end, size in self.find.iter(low):
            after, before = low[end + 1 : end + 2], low[end - size : end - size + 1] if end >= size else ""
            if not (after.isascii() and after.isalnum() or before.isascii() and before.isalnum()):
                out.append(end)
        return out

    def best(self, sentence: str) -> tuple[float, list[str], int] | None:
        """The score and the nearest templates of a sentence at or over the threshold, and its terms."""
        terms = self.term.findall(sentence)
        if self.gate.isdisjoint(terms):
            return None
        counts, dots, common, norm = Counter(terms), Counter(), Counter(), 0.0
        for t, c in sorted(counts.items()):
            w = c * self.idf.get(t, self.unknown)
            norm += w * w
            for name, weight in self.weights.get(t, ()):
                dots[name] += w * weight
                common[name] += 1
        found = [(round(d / math.sqrt(norm), 12), name) for name, d in dots.items() if common[name] > 1 and d / math.sqrt(norm) >= self.threshold]
        score = max((f[0] for f in found), default=0.0)
        return (score, [name for d, name in found if d == score], len(terms)) if found else None

    def read(self, sentences: list[str], known: dict) -> list[tuple[float, list[str], int]]:
        """The licence sentences of one reading."""
        hits = []
        for s in sentences:
            if s not in known:
                known[s] = self.best(s)
            if known[s]:
                hits.append(known[s])
        return hits

    def body(self, hits: list[tuple[float, list[str], int]]) -> tuple[str, float] | None:
        """The licence of whose own sentences most are there and least are left out before the last of them, and their mean score.

        Between licences that are alike in this, the better notice decides.
        """
        there: dict[str, dict[int, float]] = {}
        notices: dict[str, float] = {}
        for score, names, _ in hits:
            for name in names:
                licence, sign, k = re.split("([#@])", name)
                if sign == "@":
                    own = there.setdefault(licence, {})
                    own[int(k)] = max(score, own.get(int(k), 0.0))
                else:
                    notices[licence] = max(score, notices.get(licence, 0.0))
        ranked = [(max(s) + 1 - 2 * len(s), -notices.get(x, 0.0), -round(sum(s.values()) / len(s), 12), x) for x, s in there.items() if len(s) > 1]
        return (min(ranked)[3], -min(ranked)[2]) if ranked else None

    def of(self, text: str) -> tuple[str, float, float, bool] | None:
        """Licence, score, share of the words in licence sentences, and whether a long licence opens in the text."""
        low = text.lower()
        if not self.gate or not (at := self.hits(low)):
            return None
        known: dict[str, tuple | None] = {}
        lines = [s for a, z in _pieces(low, "\n", at) for s in ENDS.split(low[a:z])]
        # only paragraphs with a gate term can hold a licence sentence
        joined, start = [], 0
        for m in [*PARTS.finditer(low), None]:
            end = m.start() if m else len(low)
            if bisect_left(at, start) < bisect_left(at, end):
                joined += ENDS.split(_one_line(low[start:end]))
            start = m.end() if m else end
        readings = [self.read(lines, known), self.read(joined, known)]
        if not any(readings):
            return None
        share = max(sum(n for *_, n in hits) for hits in readings) / max(1, len(WORDS.findall(text)))
        if own := self.body(readings[0] + readings[1]):
            return *own, share, own[0] in LONG
        # of a notice and a licence's own sentence that are as near, the notice counts
        named = [((x := re.split("[#@]", name)[0]) == RESERVED, -score, "@" in name, x) for hits in readings for score, names, _ in hits for name in names]
        _, score, _, name = min(named)
        return name, -score, share, False


def _one_line(paragraph: str) -> str:
    """The lines of a paragraph joined by a blank, without white space at their ends and comment leaders."""
    first, *rest = paragraph.split("\n")
    return " ".join([first.rstrip(SPACE), *(line.lstrip(LEADERS).rstrip(SPACE) for line in rest)])


def _pieces(text: str, sign: str, at: list[int]) -> Iterator[tuple[int, int]]:
    """Ends of the pieces between signs that hold one of the places."""
    done = -1
    for place in at:
        if place > done:
            start, end = text.rfind(sign, 0, place) + 1, text.find(sign, place)
            done = end if end >= 0 else len(text)
            yield start, done


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES, bodies: dict[str, tuple[str, ...]] = BODIES) -> DataFrame:
    """doc_id, path, own_license, own_score, share, opens (null without a licence). files: doc_id, path, text."""
    scanner = None

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal scanner
        if scanner is None:
            scanner = Scanner(threshold, templates, bodies)
        found = [scanner.of(t) if t else None for t in b.column("text").to_pylist()]
        columns = [pa.array([f and f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), *columns], ["doc_id", "path", "own_license", "own_score", "share", "opens"])

    slim = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, batch, "doc_id long, path string, own_license string, own_score double, share double, opens boolean")


def scanned(files: DataFrame, **options) -> DataFrame:
    """files: doc_id, path, text. doc_id, path, own_license, own_score, license_file, license, inherited_from."""
    own = own_licences(files, **options)
    place = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    holds = F.coalesce((F.col("share") >= FILE_SHARE) | F.col("opens") | F.col("own_license").isNotNull() & F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME), F.lit(False))
    named = cut(own.select("doc_id", "path", F.when(F.col("path").isNotNull(), place).alias("dir"), "own_license", "own_score", holds.alias("license_file")))
    best = F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("l"))).alias("b")
    sources = cut(named.where("license_file AND dir IS NOT NULL").groupBy("dir").agg(best).select(F.col("dir").alias("holder"), F.col("b.l").alias("held")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("holder")))
    steps = named.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", F.col("a.holder").alias("h"))
    near = steps.join(sources, F.col("h") == F.col("holder")).groupBy("dir").agg(F.max(F.struct("depth", "holder", "held")).alias("n"))
    # written out, so that a directory of very many files can be dealt to several tasks in the join
    near = cut(near.select(F.col("dir").alias("d"), "n.holder", "n.held"))
    out = named.join(near, named.dir == near.d, "left")
    inherits = F.col("own_license").isNull() & F.col("held").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", "license_file", F.coalesce("own_license", "held").alias("license"), F.when(inherits, F.col("holder")).alias("inherited_from"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """documents have no paths; a document stands under its source, in a directory for each 100 ids under one for each 1000."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 1000 AS string)"), F.expr("cast(doc_id div 100 AS string)"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(documents_as_files(table(spark, sf_dir, "documents")))
