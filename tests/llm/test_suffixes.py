import hashlib

import numpy as np
import pytest

from zonewise.llm import queries, suffixes
from zonewise.operators.workset import Scratch


def brute(rows, length=100):
    first = {}
    out = {}
    for doc, text in sorted(rows):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            s = hashlib.blake2b(body[i : i + length], digest_size=12).digest()
            if first.setdefault(s, (doc, i)) != (doc, i):
                gone[i : i + length] = True
        rest = np.frombuffer(body, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
        out[doc] = (len(body), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS doc", "1 AS kind", "2 AS spans")
    with Scratch(spark) as scratch:
        return told(suffixes.digest(df, suffixes.repeats(df, scratch, **how)))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert told(queries.op4_suffix_dedup(spark, path)) == brute(rows)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_cut_and_joined_passages(spark, batches, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffixes, "SORT_BYTES", 3000)
    monkeypatch.setattr(suffixes, "CROWDED", 3)
    rng = np.random.default_rng(batches)
    pool = ["".join(rng.choice(list("abcdé \n"), 400)) for _ in range(4)] + ["ab" * 200, "q" * 300]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.integers(0, 5)):
            p = pool[rng.integers(len(pool))]
            a, b = sorted(rng.integers(0, 400, 2))
            parts += [p[a:b], "".join(rng.choice(list("xyz"), rng.integers(0, 120)))]
        rows.append((k * 3, "".join(parts)))
    assert run(spark, rows, batches=batches) == brute(rows)


def test_edge_cases(spark):
    long = "".join(chr(97 + (i * i // 7) % 26) for i in range(300_000))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (9, long), (10, long[1000:250_000]), (12, "é" * 49 + "a"), (13, "é" * 51)]
    assert run(spark, rows) == brute(rows)
    doubled = run(spark, [(1, "x" * 150 + long[:500]), (1, "x" * 150 + long[:500]), (None, long[:500]), (None, long[:500])])
    assert doubled[1] == brute([(1, "x" * 150 + long[:500])])[1] and doubled[None][1] == 0
    assert run(spark, [], batches=3) == {}
