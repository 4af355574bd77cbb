import functools
import hashlib
import random

import pandas as pd
import pytest

from zonewise.llm import queries, tokencounts
from zonewise.operators.workset import Scratch

FOLDER = "/root/testdata/sf0.001"
public = pytest.importorskip("public_tokenizers")
BYTES, WORDS, PIECES = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "a", "  a", "a ", "a\n\n b", "it's  we'LL", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y", "a\x1cb \x1d!", " 　é", "1²3", "𝄞 \x85 ß"]


@functools.cache
def library(path):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda text: model.encode(text, add_special_tokens=False).ids


def by_library(path, text):
    return len(library(path)(text))


def told(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.digest, r.n_bytes, r.n_tokens) for r in df.collect())


def expected(path, rows):
    known = {t: by_library(path, t) for t in {t or "" for _, t in rows}}
    return sorted((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode()), known[t or ""]) for i, t in rows)


def test_query_counts_every_document_as_the_library_does(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = queries.op13_token_counts(spark, FOLDER).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        n = by_library(BYTES, text)
        assert tuple(got.loc[i, ["n_bytes", "n_tokens", "over_limit"]]) == (len(text.encode()), n, n > 1024)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_odd_texts_under_every_tokenizer(spark, tmp_path, path):
    rows = [*enumerate(ODD), (None, None), (None, "a"), (1, "a"), (1, "a"), (99, None), (100, "long word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS n_tokens", "2 AS n")
    with Scratch(spark) as scratch:
        assert told(tokencounts.count(df, f"{tmp_path}/c", path, scratch)) == expected(path, rows)
        assert tokencounts.count(df.limit(0), f"{tmp_path}/none", path, scratch).count() == 0


def test_pieces_add_up_to_the_whole():
    draw, own = random.Random(5), tokencounts._Counter(BYTES)
    signs = ["a", "B", "é", "1", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "'s", "'", "!", "<|endoftext|>", "<|", "́", "᠎", "​"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    assert own.by_piece and own.count(texts) == own.whole(texts)
    assert not tokencounts._Counter(WORDS).by_piece


def test_only_texts_that_the_cache_lacks_are_encoded(spark, tmp_path, monkeypatch):
    cache, tokenizer = f"{tmp_path}/c", tokencounts.version(BYTES)
    first = [(i, f"text {i % 40}") for i in range(200)]
    more = [(i, f"text {i % 60}") for i in range(300)]
    batches = lambda: sorted(r.n for r in spark.read.parquet(f"{cache}/tokenizer={tokenizer}").groupBy("batch").count().withColumnRenamed("count", "n").collect())
    with Scratch(spark) as scratch:
        count = lambda rows, path=BYTES: told(tokencounts.count(spark.createDataFrame(rows, "doc_id long, text string"), cache, path, scratch))
        assert count(first) == expected(BYTES, first) and batches() == [40]
        assert count(first) == expected(BYTES, first) and batches() == [40]
        assert count(more) == expected(BYTES, more) and batches() == [20, 40]
        monkeypatch.setattr(tokencounts, "BROADCAST_ROWS", 5)  # many new texts: they move, one of each
        more += [(i, f"other {i % 30}") for i in range(90)]
        assert count(more) == expected(BYTES, more) and batches() == [20, 30, 40]
        # another tokenizer shares nothing; a stored count is believed, so the second run did read the cache
        assert count(first, WORDS) == expected(WORDS, first) and batches() == [20, 30, 40]
        assert len({tokencounts.version(p) for p in (BYTES, WORDS, PIECES)}) == 3


def test_a_text_of_many_rows_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "HOT_ROWS", 100)
    rows = [(None, "same")] * 2000 + [(i, f"t{i}") for i in range(50)]
    with Scratch(spark) as scratch:
        assert told(tokencounts.count(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/c", BYTES, scratch)) == expected(BYTES, rows)
