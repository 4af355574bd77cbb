import bisect
import random
from collections import Counter, defaultdict

import pytest

from zonewise.llm import licenses, packing, queries
from zonewise.operators.workset import Scratch


def plain_best_fit(sizes, opened, lengths):
    """One item after the other into the bin with the least room, as the textbook says."""
    rooms, bins = [], []
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(rooms, (s, -1))
        if k == len(rooms):
            size = opened if opened >= s else min((c for c in lengths if c >= s), key=packing.cost)
            bins.append(0)
            room, b = size, len(bins) - 1
        else:
            room, b = rooms.pop(k)
        bins[b] += s
        bisect.insort(rooms, (room - s, b))
    return sorted(min((c for c in lengths if c >= used), key=packing.cost) for used in bins)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_equal_plain_best_fit(seed):
    r = random.Random(seed)
    lengths = (16, 32, 64)
    sizes = [min(64, max(1, int(r.expovariate(0.08)))) for _ in range(r.choice([1, 50, 700]))]
    for opened in lengths:
        made = packing.best_fit(Counter(sizes), opened, lengths)
        assert sorted(c for c, _, n in made for _ in range(n)) == plain_best_fit(sizes, opened, lengths)
    best = sum(packing.cost(c) * n for c, _, n in packing.plan(Counter(sizes), lengths))
    assert best == pytest.approx(min(sum(map(packing.cost, plain_best_fit(sizes, o, lengths))) for o in lengths))


def check_bins(rows, lengths, docs):
    bins, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        of_doc[r.doc_id].append(r)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert at == b[0].bin_tokens and {(r.capacity, r.bin_tokens) for r in b} == {(min(c for c in lengths if c >= at), at)}
    for doc_id, n in docs.items():
        assert sum(r.length for r in of_doc[doc_id]) == n
    assert set(of_doc) == set(docs)


def test_query_packs_every_document(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: len(r.text.split()) + 1 for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_best_fit_packing(spark, folder).collect()
    check_bins(rows, packing.LENGTHS, docs)
    sizes = [min(8192, n - k) for n in docs.values() for k in range(0, n, 8192)]
    got = sum(packing.cost(c) for c in {r.bin_id: r.capacity for r in rows}.values())
    assert got == pytest.approx(min(sum(map(packing.cost, plain_best_fit(sizes, o, packing.LENGTHS))) for o in packing.LENGTHS))


def test_packing_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "w " * 1000)] + [(k, "a b c") for k in range(10, 60)] + [(70, "same"), (70, "same"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS length", "'b' AS bin_id", "1 AS n")
    with Scratch(spark) as scratch:
        got = packing.pack(df, scratch, (8, 32)).collect()
        assert packing.pack(df.limit(0), scratch).count() == 0
    want = Counter()
    for d, t in rows:
        want[d] += len((t or "").split()) + 1
    check_bins(got, (8, 32), dict(want))


def test_license_scan_query(spark):
    folder = "/root/testdata/sf0.01"
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        at = 0
        for line in r.text.split("\n"):
            want |= {(r.doc_id, at, name) for name, t in licenses.TEMPLATES.items() if t in line}
            at += len(line) + 1
    got = {(r.doc_id, r.start, r.license) for r in queries.op9_license_scan(spark, folder).collect()}
    assert got == want and want


def test_license_wording_and_edges(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, None), (2, ""), (3, gpl.upper()), (4, gpl.replace("version 3", "version 2")), (5, "licensed under CC BY-NC 4.0, see there"), (6, "license to fish"),
        (7, "x" * 10_000 + " Released under the MIT License. " + "y" * 10_000), (8, "Released under\nthe MIT License.\nReleased under the BSD 3-Clause License."),
        (9, gpl), (9, gpl), (10, "Licensed under CC BY 4.0."), (None, "Licensed under the Apache\nLicense,\nVersion 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS start", "'l' AS license")
    got = sorted((r.doc_id or 0, r.license) for r in licenses.scan(df).collect())
    assert got == [
        (0, "Apache-2.0"), (3, "GPL-3.0"), (4, "GPL-2.0"), (5, "CC-BY-NC-4.0"), (7, "MIT"), (8, "BSD-3-Clause"), (8, "MIT"), (9, "GPL-3.0"), (9, "GPL-3.0"), (10, "CC-BY-4.0"),
    ]
    assert licenses.scan(df.limit(0)).count() == 0
    gains = licenses.Scanner(licenses.TEMPLATES).ranking(gpl)
    assert gains[0][1] == "GPL-3.0" and gains[0][0] > gains[-1][0]


def test_license_forms_and_differences(spark):
    body = licenses._MIT_BODY.replace("hereby", "herewith").replace("\n", "\n * ")
    rows = [
        (1, "// SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR Apache-2.0"), (3, "Licensed under the MIT License"), (4, "GPL v3"),
        (5, "Copyright 2020 A. B.\n\n * " + body), (6, "Released under the very MIT License."), (7, "This work is licensed under a GNU General Public License, version 2."),
        (8, "GNU Library General Public License, version 2"), (9, "Licensed under CC BY-ND 4.0."), (10, "Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or\n"
         "promote products derived from this\nsoftware without specific prior written permission."), (11, "the limit of permission was admitted"),
    ]
    got = sorted((r.doc_id, r.license, r.differences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [
        (1, "MIT", ""), (2, "Apache-2.0", ""), (2, "GPL-2.0", ""), (3, "MIT", "-released"), (4, "GPL-3.0", ""), (5, "MIT", "hereby>herewith"), (6, "MIT", "+very"), (7, "GPL-2.0", "the>a"),
        (10, "BSD-3-Clause", ""),
    ]
    assert all(any(licenses._trigger.search(w) for w in f.words) for f in licenses.Scanner(licenses.TEMPLATES, licenses.FORMS).forms)


def test_license_capitals_and_broken_lines(spark):
    caps = [(k, f"line\n{t.upper()}\nline") for k, t in enumerate(licenses.TEMPLATES.values())]
    rows = [*caps, (50, "Released\nunder\nthe\nMIT\nLicense."), (51, "x " * 950 + licenses.TEMPLATES["Apache-2.0"].upper()), (52, "SPDX-\nLicense-Identifier"), (53, "licensed  under\n\n\n\n\n\nthe Apache License,\n\n\n\nVersion 2.0")]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [*enumerate(licenses.TEMPLATES), (50, "MIT"), (51, "Apache-2.0"), (53, "Apache-2.0")]
