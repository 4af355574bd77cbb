import re
import zlib

import numpy as np
import pandas as pd

from zonewise.llm import decontaminate, quality, queries


def test_quality_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op7_quality_classifier(spark, folder).collect()
    assert len({r.doc_id for r in got}) == len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    seen = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in seen]) > 0.97
    assert np.mean([b for a, b in seen if a == 1]) > 0.99 and np.mean([b for a, b in seen if a == 0]) < 0.15


def test_fit_keeps_clean_documents_at_every_sample_size():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").iloc[:6000]
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").set_index("doc_id").quality
    y = labels.reindex(docs.doc_id).to_numpy()
    x = np.stack([quality.features(t) for t in docs.text]).astype(float)
    rng, test = np.random.default_rng(0), np.arange(len(x)) % 3 == 1
    good, every = np.flatnonzero((y == 1) & ~test), np.flatnonzero(~test)
    for n_pos, n_unl, bad_kept in ((30, 60, 1.0), (150, 350, 1.0), (700, 1500, 0.3), (1300, 4000, 0.1)):
        model = quality.fit(x[rng.permutation(good)[:n_pos]], x[rng.permutation(every)[:n_unl]], 0.86)
        kept = model.score(x) >= 0.5
        assert kept[test & (y == 1)].mean() > 0.99 and kept[test & (y == 0)].mean() <= bad_kept


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 50_000), (3, "x " * 50_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS x", "true AS trusted", "named_struct('a', 1) AS `odd name`")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert [r._score for r in quality.score(docs, None).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (None, 1), (6, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r._score <= 1 for r in scored) and scored[0]._score == scored[1]._score and scored[3]._score == scored[4]._score
    assert quality.train(docs.limit(0), labels) is None


def brute_coverage(doc, item, least=5):
    """Greedy string tiling, written the slow way."""
    in_doc, in_item, total = set(), set(), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in in_doc and j + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total / max(1, len(item))
        in_doc |= set(range(i, i + n))
        in_item |= set(range(j, j + n))
        total += n


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())


def test_tiles_equal_slow_tiling():
    rng = np.random.default_rng(5)
    for _ in range(60):
        doc, item = (rng.integers(0, rng.integers(2, 5), rng.integers(5, 45)).tolist() for _ in range(2))
        assert sum(n for *_, n in decontaminate.tiles(doc, item)) == round(brute_coverage(doc, item) * len(item))


def test_decontamination_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {}
    for d, ws in docs:
        grams = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
        for i, it in items:
            if any(tuple(it[k : k + 5]) in grams for k in range(len(it) - 4)):
                share = sum(n for *_, n in decontaminate.tiles(ws, it)) / len(it)
                if share >= 0.8:
                    want[d, i] = share
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.op3_benchmark_decontamination(spark, folder).collect()}
    assert got == want and want


def test_decontamination_edges_and_reordered_passages(spark):
    item = [f"word{k}" for k in range(30)]
    moved = " ".join(item[20:] + ["x", "y"] + item[:10] + ["z"] + item[10:20])
    rows = [(1, None), (2, ""), (3, moved.upper()), (4, " ".join(item[:20])), (5, "- ".join(item)), (6, "q " * 100_000 + " ".join(item)), (7, "a b c d"), (8, moved), (8, moved), (None, moved)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "0.5 AS coverage")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "a b c d"), (2, None), (0, "other " * 6), (3, "")], "item_id long, text string")
    for block in (10, 1000):
        got = decontaminate.leaks(docs, bench, block_words=block).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 0), (3, 0), (5, 0), (6, 0), (8, 0), (8, 0)]
        assert {r.n_tiles for r in got if r.doc_id == 8} == {3}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_long_passages_leak_below_the_coverage(spark):
    item = [f"word{k}" for k in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(item[:790])), (2, " ".join(item[100:149])), (3, " ".join(item[300:325] + ["x"] + item[500:525])), (4, "a b")], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, r.longest) for r in got) == [(1, 7, 0.79, 790), (3, 7, 0.05, 25)]
