"""License scan by conditional compression.

A license has several forms: its one-line notice, its names, its SPDX ids and addresses, the header of a file, and its body or the
sentence of it that tells licenses apart. Words are compared casefolded, whatever lies between them, so a notice may be in capitals,
broken over lines or behind comment signs. A candidate block is the text around trigger words, as far as the longest form reaches.

A block is compressed alone and with every form as a raw zstandard dictionary. The forms are ranked by the size they save, and
the first whose wording is confirmed names the license: its words stand in the block up to a few differences (``allowed``), given as
``-missing +added old>new``; a missing, added or replaced word that names a license (``NAMING``, or a word with a digit) is never
one of them. The words of all its places are taken out and what lies between them are blocks again, ranked anew, so a block gives
as many licenses as it holds, and where forms overlap the one that explains most of the block decides: the BSD body with its third
clause is one BSD-3-Clause, not a BSD-2-Clause beside it. A form that lacks naming words of its own in a block cannot be confirmed
there and is not compressed. Reductions rank; no threshold on them rejects anything.

Defined cases: null and empty texts hold nothing; the same license on several lines gives a row each, on one line a single row;
``start`` is the start of the line in which the notice begins; ``reduction`` is the share of the block's compressed size that the
form saved when it won; equal reductions are ordered by license and form; repeated rows give repeated results; an empty table
gives none. Licenses outside ``TEMPLATES`` are not reported.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

# Common one-line notices; the further forms follow below.
TEMPLATES = {
    "0BSD": "Released under the Zero-Clause BSD License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "Released under the zlib License.",
}
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""
_BSD_CLAUSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_BODY = _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."
_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_BOOST_BODY = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_GPL2_BODY = """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free
for all its users."""
_GPL3_BODY = "The GNU General Public License is a free, copyleft license for software and other kinds of works."
_AGPL_BODY = """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically
designed to ensure cooperation with the community in the case of network server software."""
_LGPL3_BODY = """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
General Public License, supplemented by the additional permissions listed below."""
_APACHE_BODY = """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through
9 of this document."""
_MPL_BODY = """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights
(other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform,
distribute, and otherwise exploit its Contributions"""
_GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."""
_GNU_HEADER_ONLY = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} {version}
as published by the Free Software Foundation."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at"""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at"""


def _gnu(short: str, name: str, n: str) -> list[str]:
    numbers = [f"version {n}", f"version {n}.0", f"v{n}", f"v{n}.0", n, f"{n}.0", f"v. {n}", f"v. {n}.0"]
    out = [f"{called} {v}" for called in (name, f"{name} ({short})", short, f"GNU {short}", f"{short} license") for v in numbers]
    out += [f"{v} of the {called}" for called in (name, f"GNU {short}", short) for v in numbers[:2]]
    out += [f"{short}{v}" for v in (n, f"v{n}", f"v{n}.0", f"-{n}", f"-{n}.0", f"-v{n}", f"-{n}.0-only", f"-{n}.0-or-later")]
    for what in ("program", "library", "software", "file"):
        out.append(_GNU_HEADER.format(what=what, name=name, n=n))
        out += [_GNU_HEADER_ONLY.format(what=what, name=name, version=v) for v in numbers[:2]]
    return out


def _creative(code: str, said: str) -> list[str]:
    names = [f"CC {code} 4.0", f"CC-{code}-4.0", f"CC-{code} 4.0", f"Creative Commons {said} 4.0", f"creativecommons.org/licenses/{code}/4.0"]
    return [*names, *([f"CC {code.replace('-', ' ')} 4.0"] if "-" in code else [])]


def _bsd(*clauses: str) -> list[str]:
    """The body with its clauses numbered and not: a number is a word of its own."""
    return [" ".join([_BSD_OPENING, *clauses]), " ".join([_BSD_OPENING, *(f"{k}. {c}" for k, c in enumerate(clauses, 1))])]


FORMS = {
    "0BSD": ["Zero-Clause BSD", "0-Clause BSD", "BSD Zero Clause", "opensource.org/licenses/0BSD", "0BSD license", _ISC_GRANT],
    "AGPL-3.0": [*_gnu("AGPL", "GNU Affero General Public License", "3"), _AGPL_BODY],
    "Apache-2.0": [
        "Apache License, Version 2.0", "Apache License 2.0", "Apache License v2", "Apache License v2.0", "Apache License v. 2.0", "Apache Software License 2.0",
        "Apache Software License, Version 2.0", "Apache 2.0", "Apache 2 license", "Apache v2", "Apache-2.0", "ASL 2.0", "apache.org/licenses/LICENSE-2.0", "www.apache.org/licenses/LICENSE-2.0",
        "apache.org/licenses/LICENSE-2.0.txt", "www.apache.org/licenses/LICENSE-2.0.txt", "www.apache.org/licenses/LICENSE-2.0.html", _APACHE_HEADER,
        _APACHE_BODY,
    ],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "BSD 2 Clause", "two-clause BSD", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License", "opensource.org/licenses/BSD-2-Clause", *_bsd(_BSD_SOURCE, _BSD_BINARY)],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "BSD 3 Clause", "three-clause BSD", "BSD-3-Clause", "New BSD License", "Modified BSD License", "opensource.org/licenses/BSD-3-Clause", _BSD_CLAUSE, *_bsd(_BSD_SOURCE, _BSD_BINARY, _BSD_CLAUSE)],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License - Version 1.0", "BSL-1.0 license", "boost.org/LICENSE_1_0.txt", _BOOST_BODY],
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 license", "creativecommons.org/publicdomain/zero/1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License - v 2.0", "EPL 2.0", "EPL-2.0", "EPL v2.0", "eclipse.org/legal/epl-2.0"],
    "GPL-2.0": [*_gnu("GPL", "GNU General Public License", "2"), _GPL2_BODY],
    "GPL-3.0": [*_gnu("GPL", "GNU General Public License", "3"), _GPL3_BODY],
    "ISC": ["ISC License", "licensed under ISC", "under the ISC", "license: ISC", "opensource.org/licenses/ISC", _ISC_BODY],
    "LGPL-2.1": [*(f for f in _gnu("LGPL", "GNU Lesser General Public License", "2.1") if "2.1.0" not in f), "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": [*_gnu("LGPL", "GNU Lesser General Public License", "3"), _LGPL3_BODY],
    "MIT": ["MIT License", "MIT-License", "MIT licensed", "licensed under MIT", "released under MIT", "under the MIT", "license: MIT", "opensource.org/licenses/MIT", _MIT_BODY],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0", "MPL v2", "MPLv2", "mozilla.org/MPL/2.0", _MPL_HEADER, _MPL_BODY],
    "Unlicense": ["The Unlicense", "licensed under Unlicense", "license: Unlicense", "unlicense.org license"],
    "Zlib": ["zlib License", "zlib-License", "zlib/libpng license", "opensource.org/licenses/Zlib", _ZLIB_BODY],
}
# A word that holds one of these lets the words around it in; every form holds one.
TRIGGERS = ("licen", "copyright", "released", "permission", "spdx", "gpl", "cc0", "creative", "apache", "mozilla")
SHORT_TRIGGERS = ("0bsd", "asl", "bsd", "epl", "isc", "mit", r"mpl(?:v2)?", "cc")  # whole words only
# Words that name a license: none of them may be missing, added or replaced. So may no word with a digit.
NAMING = frozenset(
    "mit x11 isc apache asl bsd gnu affero lesser library general public mozilla mpl gpl lgpl agpl cc cc0 cc-by cc-by-nc cc-by-sa by by-nc by-sa by-nd by-nc-sa by-nc-nd nc sa nd "
    "attribution attribution-noncommercial attribution-sharealike noncommercial sharealike eclipse epl zlib boost universal freebsd unlicense zero-clause two-clause three-clause four-clause new modified simplified".split()
)
SPDX = "spdx-license-identifier"
LEVEL = 9
SLACK = 15  # differing words in a hundred

_word = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}.-]*[\p{L}\p{N}]|[\p{L}\p{N}]")
_trigger = regex.compile("|".join(TRIGGERS) + rf"|\b(?:{'|'.join(SHORT_TRIGGERS)})\b")


def _plain(word: str) -> str:
    return word.casefold().replace("licence", "license")


def words(text: str) -> list[str]:
    return [_plain(w) for w in _word.findall(text)]


def naming(word: str) -> bool:
    return word in NAMING or any(c.isdigit() for c in word)


def allowed(n: int) -> int:
    """Differing words that a form of n words may have."""
    return 0 if n < 5 else max(1, n * SLACK // 100)


class Form:
    def __init__(self, license: str, text: str):
        self.license, self.words = license, words(text)
        self.distinct, self.fixed, self.most = set(self.words), [naming(w) for w in self.words], allowed(len(self.words))
        self.named = {w for w, f in zip(self.words, self.fixed, strict=True) if f}
        given = zstandard.ZstdCompressionDict(" ".join(self.words).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=given)

    def possible(self, held: set[str]) -> bool:
        """Whether words hold enough of the form's: each one missing is a difference."""
        return self.named <= held and len(self.distinct - held) <= self.most

    def find(self, own: Sequence[str]) -> list[tuple[int, int, int, tuple]]:
        """(differences, first word, end, what differs) of the best places that do not overlap, none with another naming word."""
        bad = self.most + 1
        # per number of template words read: (differences, -first word, what differs)
        column = [(0, 0, ())]
        for k, w in enumerate(self.words):
            column.append((bad if self.fixed[k] else min(bad, column[-1][0] + 1), 0, (*column[-1][2], f"-{w}")))
        ends = []
        for j, w in enumerate(own):
            new, extra = [(0, -(j + 1), ())], bad if naming(w) else 1
            for k, t in enumerate(self.words):
                d, s, told = column[k]
                if t == w:
                    best = (d, s, told)
                else:
                    best = (bad, 0, ())
                    if d < self.most and extra == 1 and not self.fixed[k]:
                        best = (d + 1, s, (*told, f"{t}>{w}"))
                    d, s, told = new[k]
                    if d < self.most and not self.fixed[k] and (d + 1, s) < best[:2]:
                        best = (d + 1, s, (*told, f"-{t}"))
                    d, s, told = column[k + 1]
                    if d < self.most and extra == 1 and (d + 1, s) < best[:2]:
                        best = (d + 1, s, (*told, f"+{w}"))
                new.append(best)
            column = new
            d, s, told = column[-1]
            if d <= self.most:
                ends.append((d, -s, j + 1, told))
        out: list[tuple[int, int, int, tuple]] = []
        for e in sorted(ends, key=lambda e: (e[0], e[2] - e[1], e[1])):
            if all(e[2] <= o[1] or o[2] <= e[1] for o in out):
                out.append(e)
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], more: dict[str, list[str]] | None = None):
        texts = dict.fromkeys((name, text) for given in (templates, more or {}) for name in given for text in ([given[name]] if isinstance(given[name], str) else given[name]))
        self.forms = sorted((Form(*t) for t in texts), key=lambda f: (f.license, f.words))
        self.ids = {_plain(name + end): name for name in templates for end in ("", "-only", "-or-later")}
        self.tags = {name: Form(name, f"{SPDX} {name}") for name in templates}
        self.reach = max(len(f.words) + f.most for f in self.forms)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.found = lru_cache(maxsize=4096)(self._found)

    def reductions(self, own: Sequence[str], forms: Iterable[Form]) -> list[tuple[float, Form]]:
        """(share of the block's compressed size that the form saves, form), best first."""
        raw = " ".join(own).encode()
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(f.given.compress(raw)) / alone, f) for f in forms), key=lambda x: (-x[0], x[1].license, x[1].words))

    def ranking(self, block: str) -> list[tuple[float, str]]:
        """(reduction, license) by the best form of every license, best first."""
        best: dict[str, float] = {}
        for g, f in self.reductions(words(block), self.forms):
            best.setdefault(f.license, g)
        return sorted(((g, n) for n, g in best.items()), key=lambda x: (-x[0], x[1]))

    def _tagged(self, own: tuple[str, ...]):
        """The licenses of SPDX expressions: ids joined by and, or; what follows with is an exception."""
        for k, w in enumerate(own):
            at = k + 1
            while w == SPDX and at < len(own):
                if own[at] in self.ids:
                    yield self.tags[self.ids[own[at]]], 0, at if at > k + 1 else k, at + 1, ()
                at += 3 if own[at + 1 : at + 2] == ("with",) else 1
                if own[at : at + 1] not in (("and",), ("or",)):
                    break
                at += 1

    def _found(self, own: tuple[str, ...]) -> list[tuple]:
        """(form, reduction, first word, end, what differs) of the winners in a block, then in what they leave of it."""
        tagged: dict[Form, list[tuple]] = {}
        for form, *place in self._tagged(own):
            tagged.setdefault(form, []).append(tuple(place))
        out, blocks = [], [(0, len(own), [*self.forms, *tagged])]
        while blocks:
            lo, hi, forms = blocks.pop()
            part = own[lo:hi]
            held = set(part)
            ranked = self.reductions(part, [f for f in forms if f in tagged or f.possible(held)])
            for rank, (gain, form) in enumerate(ranked):
                if form in tagged:
                    places = [(d, a - lo, b - lo, told) for d, a, b, told in tagged[form] if lo <= a and b <= hi]
                else:
                    places = form.find(part)
                if places:
                    # neither the winner nor a form refused before it can be confirmed in what is left
                    later, end = [f for _, f in ranked[rank + 1 :]], 0
                    for _, a, b, told in sorted(places, key=lambda p: p[1]):
                        out.append((form, gain, lo + a, lo + b, told))
                        blocks.append((lo + end, lo + a, later))
                        end = b
                    blocks.append((lo + end, hi, later))
                    blocks = [b for b in blocks if b[0] < b[1] and b[2]]
                    break
        return out

    def text(self, text: str):
        """(start, license, reduction, number of other words, differences) of every notice."""
        if not _trigger.search(text.casefold()):
            return
        spans = [(m.start(), m.end(), _plain(m.group())) for m in _word.finditer(text)]
        own = [w for *_, w in spans]
        near: list[list[int]] = []
        for k, w in enumerate(own):
            if _trigger.search(w):
                if near and k - self.reach <= near[-1][1]:
                    near[-1][1] = min(len(own), k + self.reach + 1)
                else:
                    near.append([max(0, k - self.reach), min(len(own), k + self.reach + 1)])
        if not near:
            return
        lines = [0, *(m.end() for m in regex.finditer("\n", text))]
        starts = [s for s, *_ in spans]
        out: dict[tuple[int, str], tuple] = {}
        for lo, hi in near:
            for form, gain, a, b, told in self.found(tuple(own[lo:hi])):
                a, b = a + lo, b + lo
                at = bisect.bisect_right(lines, spans[a][0]) - 1
                stop = bisect.bisect_left(lines, spans[b - 1][1])
                stop = lines[stop] if stop < len(lines) else len(text)
                # of a very long line only the words around the notice
                first, last = max(bisect.bisect_left(starts, lines[at]), a - self.reach), min(bisect.bisect_left(starts, stop), b + self.reach)
                row = (lines[at], form.license, round(gain, 4), last - first - (b - a), " ".join(told))
                if row[:2] not in out or row[2] > out[row[:2]][2]:
                    out[row[:2]] = row
        yield from sorted(out.values())


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, start (code points), license, reduction, n_other_words, differences for every confirmed notice."""
    templates, more = (TEMPLATES, FORMS) if templates is None else (templates, None)

    def run(batches):
        scanner = Scanner(templates, more)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out += [(doc_id, *found) for found in scanner.text(text.as_py())]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            names = ["doc_id", "start", "license", "reduction", "n_other_words", "differences"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    rows = docs.select("doc_id", "text").filter("text is not null")
    return rows.mapInArrow(run, "doc_id long, start long, license string, reduction double, n_other_words long, differences string")
