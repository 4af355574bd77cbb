"""Token counts from a digest cache.

A text is known by the digest of its normal form (null becomes empty, nothing else may change a count), a tokenizer by the
digest of its file, its library and the library's version. Digests of all texts are joined to the stored counts; texts
that are not stored move once, one copy of each, are encoded, and their counts are appended to the cache. The result
joins digests to counts again, so copies and known texts are never encoded and, where few texts are new, never moved.

The cache is a folder: a folder per tokenizer, in it one per append, so appends of several programs do not meet.
Counts are a function of the key: a text that two of them have counted stands twice with the same count.

Counts are the library's: ``tokenizers`` for .json, ``sentencepiece`` for .model, no added begin, end or special tokens, special
strings inside texts as by its default, nothing cut or padded. Where the file describes a byte-level BPE whose
pre-tokenizer always cuts before white space, counts of pieces between such cuts are added up and remembered by
the worker; every other tokenizer gets whole texts.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows without a key and repeated rows stay rows of
their own; very long texts are counted in bounded lots of pieces; an empty table gives an empty result; columns other than
key and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workset import BROADCAST_ROWS, Scratch, hot_above, salted_join
from ..sources.layers import exists

# A text that more rows share than this (in a large table: more than a hundred thousandth) is joined to its count by several tasks.
HOT_ROWS = 500
# Pieces in one lot of a text, pieces a worker remembers, and the longest it remembers; texts encoded at once in bytes.
LOT, REMEMBERED, LONGEST, AT_ONCE = 200_000, 500_000, 48, 1 << 20

# White space as the pre-tokenizer has it: without the four separators that Python counts as such.
_PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_CACHE = "digest binary, n_tokens long"
_workers: dict[str, _Counter] = {}


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def version(path: str) -> str:
    """Digest of all that decides a count besides the text."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__} plain\n".encode() + file.read()).hexdigest()


def _cuts_before_space(told: dict) -> bool:
    """Does this tokenizer file describe one that may be fed piece by piece?"""
    cut = told.get("pre_tokenizer") or {}
    plain = all(told.get(k) is None for k in ("normalizer", "truncation", "padding"))
    by_bytes = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    model = told.get("model") or {}
    steady = model.get("type") == "BPE" and not model.get("dropout")
    marks = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens") or [])
    return plain and by_bytes and steady and marks


class _Counter:
    """The tokenizer of this worker process."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            self.by_piece = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                self.by_piece = _cuts_before_space(json.load(file))

    def whole(self, texts: list[str]) -> list[int]:
        out, lot, size = [], [], 0
        for text in texts:
            lot.append(text)
            size += len(text)
            if size > AT_ONCE:
                out += self.encode(lot)
                lot, size = [], 0
        return out + (self.encode(lot) if lot else [])

    def sums(self, split: list[list[str]]) -> list[int]:
        """Tokens of each list of pieces; pieces that are new to the worker are encoded for all lists at once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        counts = dict(zip(new, self.whole(new), strict=True))
        known.update((p, n) for p, n in counts.items() if len(p) <= LONGEST)
        if all(len(p) <= LONGEST for p in new):
            return [sum(map(known.__getitem__, pieces)) for pieces in split]
        return [sum(known[p] if len(p) <= LONGEST else counts[p] for p in pieces) for pieces in split]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.whole(texts)
        out, split, size = [], [], 0
        for text in texts:
            if size + len(text) > AT_ONCE:
                out += self.sums(split)
                split, size = [], 0
            if len(text) <= AT_ONCE:
                split.append(_PIECE.findall(text))
                size += len(text)
            else:
                found = _PIECE.finditer(text)
                out.append(sum(self.sums([some])[0] for some in iter(lambda f=found: [m.group() for m in islice(f, LOT)], [])))
        return out + self.sums(split)


def counter(path: str) -> _Counter:
    if path not in _workers:
        _workers[path] = _Counter(path)
    return _workers[path]


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """digest, n_tokens of the texts counted under one tokenizer version; None before the first append."""
    folder = f"{cache}/tokenizer={tokenizer}"
    if not exists(spark, folder):
        return None
    return spark.read.schema(f"{_CACHE}, batch string").parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append(texts: DataFrame, cache: str, path: str, tokenizer: str) -> None:
    """Encode distinct texts (digest, text) and add their counts to the cache."""

    def encode(batches):
        own = counter(path)
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            for k in range(0, len(keys), 512):
                counts = own.count(bodies.slice(k, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([keys.slice(k, 512), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    texts.mapInArrow(encode, _CACHE).write.parquet(f"{cache}/tokenizer={tokenizer}/batch={uuid.uuid4().hex}")


def count(docs: DataFrame, cache: str, path: str, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (hex), n_bytes, n_tokens of every row; texts that ``cache`` does not hold are encoded and added to it.

    The result reads tables of ``scratch`` and the cache.
    """
    spark, tokenizer = docs.sparkSession, version(path)
    body = F.coalesce(F.col(text), F.lit(""))
    # the position is settled with the row, so it may spread the rows of a text over tasks
    at = F.monotonically_increasing_id().alias("_at")
    keys = scratch.settle(docs.select(F.col(key), digest(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), at))
    copies = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    known = stored(spark, cache, tokenizer)
    texts = docs.select(digest(body).alias("digest"), body.alias("text"))
    one_of_each = lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
    if known is None:
        append(one_of_each(texts), cache, path, tokenizer)
    else:
        missing = scratch.settle(copies.select("digest").join(known, "digest", "left_anti"))
        n = missing.count()
        if n and n <= BROADCAST_ROWS:  # few are new: all other texts stay where they are
            append(one_of_each(texts.join(F.broadcast(missing), "digest", "left_semi")), cache, path, tokenizer)
        elif n:
            append(one_of_each(texts).join(missing, "digest", "left_semi"), cache, path, tokenizer)
    counted = salted_join(keys, stored(spark, cache, tokenizer), ["digest"], "inner", F.col("_at"), hot_rows=hot_above(keys.count(), HOT_ROWS), hot=copies)
    return counted.select(F.col(key), F.lower(F.hex("digest")).alias("digest"), "n_bytes", "n_tokens")
