import random

import pytest
import zstandard

from zonewise.llm import licenses


def size(raw: bytes, given: str | None = None) -> int:
    if given is None:
        return len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False).compress(raw))
    raw_dict = zstandard.ZstdCompressionDict(given.encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False, dict_data=raw_dict).compress(raw))


def differing(a: list[str], b: list[str]) -> int:
    """Edit distance in words, where no word that names a license may differ."""
    cost = lambda w: 99 if licenses.naming(w) else 1
    row = [0]
    for w in b:
        row.append(row[-1] + cost(w))
    for v in a:
        new = [row[0] + cost(v)]
        for k, w in enumerate(b):
            new.append(min(row[k] + (0 if v == w else max(cost(v), cost(w))), row[k + 1] + cost(v), new[k] + cost(w)))
        row = new
    return row[-1]


def slow(block: list[str], templates: dict[str, str]) -> set:
    """Every template against the whole block, the best confirmed one taken out, and again for what is left."""
    raw = " ".join(block).encode()
    ranked = sorted((size(raw, " ".join(licenses.words(t))) / size(raw), n, t) for n, t in templates.items())
    for share, name, t in ranked:
        t = licenses.words(t)
        most = licenses.allowed(len(t))
        fits = []
        for a in range(len(block)):
            for b in range(a + max(1, len(t) - most), min(len(block), a + len(t) + most) + 1):
                d = differing(block[a:b], t)
                if d <= most:
                    fits.append((d, b - a, a))
        taken: list[tuple] = []
        for d, n, a in sorted(fits):
            if all(a + n <= x or x + m <= a for _, m, x in taken):
                taken.append((d, n, a))
        if taken:
            out = {(name, round(1 - share, 9), a, a + n, d) for d, n, a in taken}
            at = 0
            for a, b in [*sorted((a, a + n) for _, n, a in taken), (len(block), len(block))]:
                if at < a:
                    out |= {(m, g, x + at, y + at, d) for m, g, x, y, d in slow(block[at:a], templates)}
                at = b
            return out
    return set()


@pytest.mark.parametrize("seed", range(5))
def test_winners_equal_every_template_against_every_block(seed):
    r = random.Random(seed)
    texts = {**licenses.TEMPLATES, "BSD-3-Clause": licenses._BSD_CLAUSE}
    block = []
    for _ in range(3):
        own = licenses.words(r.choice(list(texts.values())))
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(own))
            own[k : k + r.choice([0, 1])] = r.choice([[], ["and"], ["under"], ["version"], ["2.0"]])
        block += r.choices(["some", "words", "license", "under", "the"], k=r.randrange(5)) + own
    scanner = licenses.Scanner(texts)
    got = {(f.license, round(g, 9), a, b, len(told)) for f, g, a, b, told in scanner.found(tuple(block))}
    assert got == slow(block, texts) and len(got) <= 3


BSD = [licenses._BSD_OPENING, licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_CLAUSE]


def names(scanner, text):
    return [(row[1], row[4]) for row in scanner.text(text)]


def test_the_ranking_names_the_license(monkeypatch):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.FORMS)
    three, two = "\n * ".join(BSD), "\n * ".join(BSD[:3])
    assert names(scanner, three) == [("BSD-3-Clause", "")] and names(scanner, two) == [("BSD-2-Clause", "")]
    assert names(scanner, licenses._ISC_BODY) == [("ISC", "")] and names(scanner, licenses._ISC_GRANT) == [("0BSD", "")]
    # without reductions forms stand in their own order, and the shorter body takes the words of the longer one
    flat = licenses.Scanner(licenses.TEMPLATES, licenses.FORMS)
    monkeypatch.setattr(flat, "reductions", lambda own, forms: sorted(((0.0, f) for f in forms), key=lambda x: (x[1].license, x[1].words)))
    assert [n for n, _ in names(flat, three)] == ["BSD-2-Clause", "BSD-3-Clause"] and [n for n, _ in names(flat, licenses._ISC_BODY)] == ["0BSD"]


def test_every_form_is_found_in_running_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.FORMS)
    for form in scanner.forms:
        for said in (" ".join(form.words), " ".join(form.words).upper(), "\n# ".join(form.words)):
            got = {row[1] for row in scanner.text("Some words stand here.\n" + said + "\nand some words after it")}
            assert got == {form.license}, (form.license, form.words)


def test_several_licenses_in_one_block(spark):
    text = "\n".join(["Copyright A. B.", *BSD[:3], "", licenses._ISC_BODY, licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT"], "Parts: GPL v3, LGPL-2.1-or-later"])
    numbered = " ".join([BSD[0], *(f"{k}. {c}" for k, c in enumerate(BSD[1:], 1))]).replace("the copyright holder", "the University")
    rows = [(1, text), (2, numbered), (2, numbered), (3, "permission to use this software is granted"), (4, None), (5, "")]
    got = sorted((r.doc_id, r.license, r.start) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    at = text.index
    mit = at("Released under the MIT")
    parts = at("Parts")
    want = [(1, "BSD-2-Clause", at("Redistribution and")), (1, "GPL-3.0", parts), (1, "ISC", at("Permission to")), (1, "LGPL-2.1", parts), (1, "MIT", mit), (1, "MIT", text.rindex("Released under the MIT"))]
    assert got == [*sorted(want), (2, "BSD-3-Clause", 0), (2, "BSD-3-Clause", 0)]
