import re

import numpy as np
import pytest
import xxhash

from zonewise.llm import queries, simhash
from zonewise.llm.components import components
from zonewise.operators.workset import Scratch


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    prints = {d: brute_print(t) for d, t in rows}
    ids, fp = np.array(list(prints)), np.array(list(prints.values()), np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3)]
    found = brute_components(ids, links)
    return {d: (f"{prints[d]:016x}", found[d]) for d in prints}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_near_duplicates(spark, path).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("homes", [4096, 3])
def test_edges_connect_all_near_prints(spark, homes, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [0 if k == 0 else sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 5, 600)]
    crowd = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fp = np.unique(np.r_[base[rng.integers(0, 40, 600)] ^ np.array(flips, np.uint64), crowd, np.array([0, 2**64 - 1], np.uint64)])
    monkeypatch.setattr(simhash, "replicas", lambda p, f=simhash.replicas: f(p, homes))
    got = simhash.edges(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")).collect()
    signed = fp.view(np.int64).tolist()
    links = [(signed[i], signed[j]) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3)]
    assert {(r.a, r.b) for r in got} <= {(max(p), min(p)) for p in links}
    assert brute_components(signed, got) == brute_components(signed, links)


def test_edge_cases(spark):
    near = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "One two"), (7, "ONE  two"), (7, "ONE  two"), (9, near), (10, near + " x"), (11, "É one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'a' AS anchor", "2 AS component_id")
    with Scratch(spark) as scratch:
        got = simhash.near_duplicates(df, scratch).collect()
        assert simhash.near_duplicates(df.limit(0), scratch).count() == 0
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (1, 1), (2, 1), (3, 1), (7, 7), (7, 7), (9, 9), (10, 9), (11, 11)]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(160, 159), (7, 7), (3, 2)]
    df = spark.createDataFrame(pairs, "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(df, scratch).collect()}
    nodes = {n for p in pairs for n in p}
    assert {n: got.get(n, n) for n in nodes} == brute_components(nodes, pairs)
