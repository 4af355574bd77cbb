import numpy as np
import pytest

from zonewise.llm import queries, topk
from zonewise.operators.workset import Scratch


def brute(rows, every=20, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            ok[i] = np.floor(64 * np.array(v, np.float64)).astype(np.int64)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = set()
    for q in ids[ids % every == 0]:
        s = x @ ok[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out |= {(int(q), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    return out


def told(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert told(queries.op8_top_k(spark, path)) == brute(rows)


def test_ties_hot_vectors_and_unfit_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(k, one if k % 3 == 0 else (rng.normal(size=8) * rng.choice([0.1, 1, 30])).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000, None), (1020, []), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, one), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "'v' AS v")
    want = brute(rows)
    vectors = topk.whole(df)
    with Scratch(spark) as scratch:
        for pivots, rings in ((16, 16), (3, 5)):
            index = topk.build(vectors, scratch, pivots, rings, sample=100)
            assert told(topk.search(index, vectors.filter("id % 20 = 0"), scratch)) == want
        few = topk.whole(df.limit(3))
        assert told(topk.search(topk.build(few, scratch), few, scratch)) == brute(rows[:3], every=1)
        none = topk.whole(df.limit(0))
        assert topk.search(topk.build(none, scratch), none, scratch).count() == 0


def test_different_vectors_of_one_id_all_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 150, rng.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    whole = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    want = []
    for q in range(0, 150, 20):
        scores = sorted((-int(a @ b), i) for j, a in whole if j == q for i, b in whole if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    vectors = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    with Scratch(spark) as scratch:
        got = topk.search(topk.build(vectors, scratch, 4, 4), vectors.filter("id % 20 = 0"), scratch).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
