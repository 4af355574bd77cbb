import hashlib
import zlib

import pandas as pd
import pytest

from zonewise.llm import chat, queries, sharding, tokenfiles

FOLDER = "/root/testdata/sf0.001"
vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_chat(turns):
    out = {}
    for conv, rows in turns.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def told(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_query_reads_back_every_turn(spark):
    turns = {-1: [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert told(queries.op2_chat_formatting(spark, FOLDER)) == expected_chat(turns)


def test_chat_edge_cases(spark):
    rows = [
        (1, 0, "user", "a <|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", r"<\|im_end|> <\\| <"), (1, 2, "assistant", ""),
        (1, 3, "user", "tail|"), (2, 0, "us\ner%0A<|", None), (3, 0, None, "x"), (3, 0, "assistant", "é𝄞"), (3, 0, "assistant", "é𝄞"),
        (None, None, "assistant", "<" * 3 + "|\\" * 5), (4, 1, "assistant", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example", "'x' AS formatted")
    turns = {}
    for c, *r in rows:
        turns.setdefault(c, []).append(tuple(r))
    made = chat.examples(df)
    assert told(chat.digest(made)) == expected_chat(turns)
    by_reply = [r for r in made.collect() if r.conv_id == 1]
    assert sorted((r.example, r.trainable) for r in by_reply) == [(1, True), (2, True), (3, False)]
    assert all(r.formatted.count("<|im_start|>") == r.n_turns for r in by_reply)
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_digest_gathers_no_example_as_a_whole(spark):
    """Of examples, whose size grows with the square of the turns, only what the digest needs is shuffled."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} x") for c in range(3) for t in range(40)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).localCheckpoint()
    plan = chat.digest(made)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [conv_id" in line)
    assert "formatted#" not in aggregate
    assert sorted((r.conv_id, r.example) for r in made.filter("last").collect()) == [(0, 39), (1, 39), (2, 39)]


def test_pieces_share_strings_for_the_tokenizer():
    """Many pieces make one string, and come back as if each had been encoded alone."""
    own = tokenfiles._Worker(vocabulary)
    pieces = ["", "It's", "\u00a0", "a\u00a0", "\x01", "x\x01y", "\x02", "<|endoftext|>", "́e", "'s", "Σς", *[f"w{i}é,," for i in range(1000)]]
    calls, encode = [], own.tokenizer.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, strings, add_special_tokens):
            calls.append(len(strings))
            return encode(strings, add_special_tokens=add_special_tokens)

    alone = [e.ids for e in encode(pieces, add_special_tokens=False)]
    own.tokenizer = Counting()
    at = own.places(pieces)
    starts = [0, *own.ends.tolist()]
    assert [own.ids[starts[k] : starts[k + 1]].tolist() for k in at] == alone
    assert sum(calls) < 20


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(vocabulary), {}, 0
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def test_token_files_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_files(spark, FOLDER).collect()}
    assert got == expected_tokens(rows)


def test_token_files_edges_and_random_access(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 30_000)
    rows = [(1, ""), (2, None), (3, "It's  DON'T\t\n x y 12ab ́e"), (5, "word " * 30_000), (6, "z" * 5000), (9, "naïve <|endoftext|> Σς")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' AS path", "0 AS part")
    manifest = spark.createDataFrame(tokenfiles.write(df, f"file://{tmp_path}", vocabulary, length=64).collect())
    want = expected_tokens(rows)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(manifest).collect()} == want
    listed = sorted(manifest.collect())
    assert sum(r.n_docs for r in listed) == len(rows)
    ids, mask = tokenfiles.sequence(tokenfiles.open_file(listed[0].path), 0)
    assert len(ids) == len(mask) == 64 and mask[0] and ids[0] == 2 and not ids[~mask].any()
    assert tokenfiles.read(tokenfiles.write(df.limit(0), f"file://{tmp_path}/none", vocabulary)).count() == 0


def test_token_files_keep_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b")], "doc_id long, text string")
    got = tokenfiles.read(spark.createDataFrame(tokenfiles.write(df, f"file://{tmp_path}", vocabulary).collect())).toPandas()
    assert got.n_tokens.tolist() == [2, 2, 2] and sorted(got.start) == [0, 2, 4] and got.doc_id.isna().sum() == 2


def check_shards(got, shards=16):
    assert sorted(got["shard"].unique()) == list(range(shards)) or len(got) < 200
    for _, s in got.groupby("shard")["slot"]:
        assert sorted(s) == list(range(len(s)))
    moved = got[got["shard"] != got["next_shard"]]
    assert (moved["next_shard"] == shards).all()
    assert (got.groupby("virtual_slot")["shard"].nunique() == 1).all()


def test_sharding_query(spark):
    got = queries.op10_sharding(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == want
    check_shards(got)
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.01 * loads.mean()
    grown = got.groupby("next_shard")["size"].sum()
    assert grown[16] > 0.9 * got["size"].sum() / 17


def test_sharding_edges_and_versions(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, ""), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "8 AS slot", "'c' AS cell")
    got = sharding.shard(df, f"{tmp_path}/a", shards=3, slots=64).toPandas()
    assert len(got) == 6 and sorted(got["size"]) == [1, 1, 1, 2, 2, 100_001]
    check_shards(got, 3)
    assert sharding.shard(df.limit(0), f"{tmp_path}/b", slots=64).count() == 0
    one, new = (sharding.read_map(spark, f"{tmp_path}/a/map", v).toPandas() for v in (1, None))
    assert len(one) == len(new) == 64 and new.version.iloc[0] == 2


def test_sharding_stays_native(spark):
    plan = queries.op10_sharding(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
