import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from zonewise.llm import divergence, queries
from zonewise.operators.workset import Scratch

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least=10, top=10):
    """Straight from the definition, a term and a pair of sources at a time."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((r[0] or "", r[1] or "", r[2] or "") for r in rows):
        found = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        share = lambda count, kept=kept: {t: 1 + 1000000000 * (count[t] + 2) // (sum(count[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


def audited(spark, df, **how):
    with Scratch(spark) as scratch:
        rows = divergence.audit(df, scratch, **how).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_query_on_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text").collect()
    got = queries.op12_source_divergence(spark, folder).collect()
    assert {tuple(r) for r in got} == expected(rows) and len(got) == len(set(got))


def drawn(seed, n):
    draw = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(draw.choice(["en", "en", "de"]), f"s{min(draw.randint(0, 9), draw.randint(0, 9))}", " ".join(draw.choices(words, weights, k=draw.randint(0, 25)))) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 10])
def test_any_cut_of_the_tree_gives_the_same(spark, monkeypatch, least):
    rows = drawn(least, 400)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = expected(rows, least)
    assert audited(spark, df, least=least) == want
    monkeypatch.setattr(divergence, "NODES", 7)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "_SLICE", 3)
    monkeypatch.setattr("zonewise.operators.workset.BROADCAST_ROWS", 0)
    assert audited(spark, df, least=least) == want


def test_odd_rows(spark):
    rows = [
        (None, None, None), (None, None, ""), ("", "", "x"), ("xx", "only", "a b"), ("yy", "a", "1 2 3"), ("yy", "b", None),
        *[("en", "u", "Ä ä ÀB aB\x00Ab_ab ßs 中文é")] * 12, *[("en", None, "ab 中文é " * 3)] * 10, ("en", "long", "q" * 200_000 + " ab" * 200_000),
        *[("en", "v", "zz ab")] * 9,
    ]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS place", "2 AS p", "3 AS kept", "4 AS term", "5 AS n")
    assert audited(spark, df) == expected(rows)
    assert audited(spark, df.limit(0)) == set()


def test_shares_are_exact(spark):
    big = 9_000_000_000_000_000_000
    cases = [(0, 0, 1), (1, 3, 2), (10**17, 10**18, 10**6), (big - 2, big - 2, 1), (7, 7, 3)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * kept) for n, total, kept in cases]


def test_equal_beginnings_share_nodes():
    tree = divergence.Tree()
    tree.insert("en", [0, 1, 2], [50, 30, 20], [10, 10, 10], 3)
    tree.insert("en", [0, 1, 4], [50, 30, 25], [10, 10, 10], 2)
    tree.insert("de", [0, 1], [50, 30], [10, 10], 1)
    assert len(tree.parent) == 6 and tree.terms[:2] == [5, 5]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    both = lambda p, q: f(p, q) - f(p, 10) - f(10, q) + f(10, 10)
    got = {tuple(map(int, x[:3])): int(x[3]) for x in zip(*tree.corrections(), strict=True)}
    assert got[0, 0, 1] == 5 * both(50, 30) and got[0, 1, 4] == 2 * both(30, 25) and got[1, 0, 1] == both(50, 30)
