"""Licence scan against dense TF-IDF vectors and a walk up each path."""

import math
import random
import re
import textwrap
import time

import numpy as np

from tessera.llm import licenses


def dense(templates):
    """Score of a sentence against every template, over vectors of all terms."""
    named = [(name, re.findall(licenses.TERM, t.lower())) for name, texts in sorted(templates.items()) for t in texts]

    def score(sentence):
        terms = re.findall(licenses.TERM, sentence.lower())
        words = sorted({*terms, *(w for _, t in named for w in t)})
        place = {w: k for k, w in enumerate(words)}
        idf = np.array([math.log((1 + len(named)) / (1 + sum(w in t for _, t in named))) + 1 for w in words])

        def vector(own):
            v = np.bincount([place[w] for w in own], minlength=len(words)) * idf
            return v / max(1e-300, np.sqrt(v @ v))

        own = vector(terms)
        found = [(-round(float(own @ vector(t)), 12), name) for name, t in named if len({*terms} & {*t}) > 1]
        return min(found, default=(0.0, None)), len(terms)

    return score


def licence(text, score):
    readings = [text.lower().split("\n"), [re.sub(r"\s*\n[\s#/*;%-]*", " ", p) for p in re.split(r"\n[\s#/*;%-]*\n", text.lower())]]
    best, share = [], 0.0
    for parts in readings:
        hits = [(s, n) for p in parts for x in re.split(r"(?<=[.!?])\s+", p) for s, n in [score(x)] if -s[0] >= licenses.THRESHOLD]
        best += [(name == "proprietary", s, name) for (s, name), _ in hits]
        share = max(share, sum(n for _, n in hits) / max(1, len(text.split())))
    return (min(best)[2], -min(best)[1], share) if best else None


def test_scan_is_that_of_dense_vectors(spark):
    rng = random.Random(11)
    score = dense(licenses.TEMPLATES)
    sentences = [t for texts in licenses.TEMPLATES.values() for t in texts]
    prose = "lorem ipsum the of and software work use version may under at any code".split()
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(sentences).split() if rng.random() < 0.5 else rng.choices(prose, k=rng.randint(1, 25))
            words = [w for w in words if rng.random() > rng.choice([0, 0, 0.15, 0.4])]
            for k in range(len(words)):
                if rng.random() < 0.08:
                    words[k] = rng.choice(["\n# ", "\n", " "]) + rng.choice([words[k].upper(), words[k], "zeta"])
            parts.append(" ".join(words))
        name = rng.choice(["LICENSE", "a.py", "b.c", "COPYING.md", "notes.txt"])
        rows.append((i, "/".join([*rng.choices("abc", k=rng.randint(0, 3)), name]), rng.choice(["\n", "\n\n", " "]).join(parts)))
    rows += [(900, "a/b/x", None), (901, None, sentences[0]), (902, "a/y", ""), (903, "LICENSE", sentences[0] + " x" * 100_000), (904, "q/LICENSE", ". ".join(sentences)), (905, "q/LICENSE", ". ".join(sentences))]
    own = {i: licence(t or "", score) for i, _, t in rows}
    out = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string"), bodies={}).collect()}
    assert sum(v is not None for v in own.values()) > 60
    holders = {}
    for i, path, _ in rows:
        got = own[i]
        assert out[i].own_license == (got and got[0]) and (got is None or abs(out[i].own_score - got[1]) < 1e-9)
        file = got is not None and (got[2] >= licenses.FILE_SHARE or bool(re.match(r"(?i)(licen[cs]e|copying|notice|unlicense)([.-].*)?$", (path or "").rpartition("/")[2])))
        assert out[i].license_file == file
        if file and path is not None:
            place = path.rpartition("/")[0]
            holders[place] = min(holders.get(place, (9.0,)), (-out[i].own_score, path, got[0]))
    for i, path, _ in rows:
        if own[i] and own[i][0] or path is None:
            continue
        steps = path.split("/")[:-1] or [""]
        above = [(p, holders[p][2]) for p in ("/".join(steps[:k]) for k in range(len(steps), 0, -1)) if p in holders]
        assert (out[i].license, out[i].inherited_from) == ((above[0][1], above[0][0]) if above else (None, None))


PREAMBLE = "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software."
#: The openings of licence files as they are distributed, wrapped and indented in their ways.
HEADS = {
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n\n",
    "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n\n",
    "ISC": "ISC License\n\nCopyright (c) 2020 Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM\nLOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR\nOTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR\nPERFORMANCE OF THIS SOFTWARE.\n",
    "MIT": "MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}
BSD_TEXT = (
    "Copyright (c) 2020, Some One\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED."
)
THIRD = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"


def test_licence_files_are_known_by_their_own_sentences(spark):
    terms = "\n\n".join(textwrap.fill(f"{k}. Section {k}. {PREAMBLE}", 70) for k in range(40))  # what follows in long licences
    heads = HEADS | {"BSD-2-Clause": BSD_TEXT.format(""), "BSD-3-Clause": BSD_TEXT.format(THIRD)}
    rows = []
    for k, (name, head) in enumerate(heads.items()):
        text = head + terms if name in licenses.LONG else head
        shown = "".join(f" * {line}\n" for line in head.split("\n"))
        rows += [(10 * k, f"{name}/text", text), (10 * k + 1, f"{name}/sub/a.txt", "no licence here"), (10 * k + 2, f"{name}/head", head), (10 * k + 3, f"{name}/shown", "/*\n" + shown + " */"), (10 * k + 4, f"x{k}/code.c", head + "\nint x;" + " y" * 2000)]
    rows.append((900, "r/readme", "This program is under the GNU General Public License. See its version 3, 29 June 2007, for more. " + "word " * 100))
    out = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(heads):
        assert [(out[10 * k + j].own_license, out[10 * k + j].license_file) for j in (0, 2, 3)] == [(name, True)] * 3
        assert (out[10 * k + 1].license, out[10 * k + 1].inherited_from) == (name, name)
        # a short licence at the head of much code speaks for this file alone
        assert out[10 * k + 4].own_license == name and out[10 * k + 4].license_file == (name in licenses.LONG)
    assert not out[900].license_file


def test_long_blanks_are_read_in_linear_time():
    scanner = licenses.Scanner(licenses.THRESHOLD, licenses.TEMPLATES, licenses.BODIES)
    for blank in (" ", "\n", " \n", "\t#", "* "):
        text = "licensed under the mit license" + blank * (1_000_000 // len(blank)) + "x\n"
        began = time.perf_counter()
        assert scanner.of(text)[0] == "MIT"
        assert time.perf_counter() - began < 2
