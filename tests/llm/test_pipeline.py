from collections import defaultdict

import corpus_pipeline
from test_packing_licenses import check_bins
from test_quality_decontamination import words
from test_simhash import brute as brute_groups
from zonewise.llm import decontaminate, packing, quality

FOLDER = "/root/testdata/sf0.01"


def test_every_stage_equals_its_brute_force(spark, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == list(corpus_pipeline.COLUMNS)
            kept = {r.doc_id: r.text for r in rows}
            assert len(kept) == len(rows)
        if name == "quality_classifier":
            model = quality.train(docs, labels)
            assert kept == {d: t for d, t in before.items() if model.score(quality.features(t)[None].astype(float))[0] >= 0.5}
            good = {r.doc_id for r in labels.filter("quality = 1").collect()}
            assert good <= set(kept) and len(kept) < len(before)
        elif name == "near_duplicates":
            groups = brute_groups(before.items())
            assert kept == {d: before[d] for d, (_, c) in groups.items() if d == c}
        elif name == "suffix_dedup":
            assert kept == without_repeats(before)
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        elif name == "decontamination":
            leaked = {d for d, t in before.items() if any(leak(words(t), it) for _, it in items)}
            assert leaked and set(kept) == set(before) - leaked
        else:
            check_bins(rows, packing.LENGTHS, {d: len(t.split()) + 1 for d, t in before.items()})
        docs = after
    assert corpus_pipeline.run(spark, FOLDER).count() == len(rows)


def leak(doc, item):
    return bool(item) and sum(n for *_, n in decontaminate.tiles(doc, item)) >= 0.8 * len(item)


def without_repeats(texts, length=100):
    seen, out = defaultdict(lambda: None), {}
    for d in sorted(texts):
        body = texts[d].encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            s = body[i : i + length]
            if seen[s] is None:
                seen[s] = (d, i)
            else:
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(c for c, g in zip(body, gone, strict=True) if not g).decode(errors="ignore") if any(gone) else texts[d]
    return {d: t for d, t in out.items() if t or not texts[d]}


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", None, 3), (4, "same text of a row", "en", "s", 18), (4, "same text of a row", "en", "s", 18)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs, most in ((df, 5), (df.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
            assert docs.count() <= most


def test_stages_decide_by_row_where_ids_are_missing_or_repeated(spark):
    texts = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcd"]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(1, texts[0]), (7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (7, texts[2].upper()), (8, texts[1]), (9, texts[3])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text.lower()) for r in corpus_pipeline.drop_near_duplicates(spark, df, FOLDER).collect())
    assert kept == [(1, texts[0]), (7, texts[1]), (7, texts[2]), (9, texts[3])]
    rows = [(None, item), (None, texts[0]), (5, item), (5, texts[1]), (6, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], df.schema)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_leaked(spark, df, FOLDER).collect()}
    assert kept == {(None, texts[0]), (5, texts[1]), (6, None)}
