"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A document and a benchmark item that share a seed (five words in a row)
are tiled: the longest match of unmarked words on both sides becomes a tile, its words are marked, and so on while matches of at
least five words are left (running Karp-Rabin: candidate matches grow from hashed seeds, longest first). Tiles may come in any
order, so reordered passages count. An item has leaked into a document if tiles cover at least ``COVERAGE`` of the item's words,
or, however long the item is, at least ``ENOUGH`` of its words.

The items' seeds go to the tasks in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark takes several passes, so what a
task holds is bounded. Documents are not shuffled.

Defined cases: null and empty texts match nothing; items of fewer than five words cannot be tiled and match nothing; an item_id
on several rows: each text is tested, the best coverage counts; repeated documents each keep their row; an empty table
on either side gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Rolling, mix

SEED_WORDS, COVERAGE, ENOUGH = 5, 0.8, 50
BLOCK_WORDS = 2_000_000
_BLOCK_BYTES = 1 << 20

_word = regex.compile(rb"[0-9a-z\x80-\xff]+")
_in_word = np.zeros(256, bool)
_in_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64


def words(text: str) -> list[bytes]:
    return _word.findall(text.lower().encode())


def tiles(doc: list, item: list, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in doc, start in item, length), longest first; ties go to the earliest place."""
    seeds: dict[tuple, list[int]] = {}
    for j in range(len(item) - least + 1):
        seeds.setdefault(tuple(item[j : j + least]), []).append(j)
    found, seen = [], set()
    for i in range(len(doc) - least + 1):
        for j in seeds.get(tuple(doc[i : i + least]), ()):
            if (i, j) in seen:
                continue
            n = least
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            seen.update((i + k, j + k) for k in range(n - least + 1))
            found.append((-n, i, j))
    heapq.heapify(found)
    in_doc, in_item, out = set(), set(), []
    while found:
        n, i, j = heapq.heappop(found)
        free = [k for k in range(-n) if i + k not in in_doc and j + k not in in_item]
        if len(free) == -n:
            in_doc.update(range(i, i - n))
            in_item.update(range(j, j - n))
            out.append((i, j, -n))
            continue
        # what is left unmarked of this match competes again under its new length
        cuts = [0, *(c for c in range(1, len(free)) if free[c] != free[c - 1] + 1), len(free)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a >= least:
                heapq.heappush(found, (a - b, i + free[a], j + free[a]))
    return out


def _grams(hashes: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """Hash of every run of n word hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _in_word[data]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass
class Block:
    """Some benchmark items and their seeds, ready to be met by documents."""

    ids: list
    items: list[list[bytes]]
    keys: np.ndarray  # sorted seed hashes
    item: np.ndarray  # of each seed
    place: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        items = [words(t or "") for _, t in rows]
        keys, item, place = [np.zeros(0, np.uint64)], [], []
        for k, ws in enumerate(items):
            data = np.frombuffer(b" ".join(ws), np.uint8)
            start, end = _spans(data)
            g = _grams(Rolling(data, 3).at(start, end)) if len(ws) else np.zeros(0, np.uint64)
            keys.append(g)
            item += [k] * len(g)
            place += range(len(g))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        sieve = np.zeros(1 << 22, bool)
        sieve[(flat >> _U(42)).astype(np.int64)] = True
        return cls([i for i, _ in rows], items, flat[order], np.array(item, np.int64)[order], np.array(place, np.int64)[order], sieve)

    def near(self, texts: list[bytes], coverage: float, enough: int) -> list[tuple[int, int]]:
        """(text, item) whose shared seeds alone could reach the coverage or the number of words."""
        sizes = np.array([len(t) + 1 for t in texts])
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        start, end = _spans(data)
        if len(start) < SEED_WORDS or not len(self.keys):
            return []
        doc = np.searchsorted(np.cumsum(sizes), start, side="right")
        g = _grams(Rolling(data, 3).at(start, end))
        hit = np.flatnonzero(self.sieve[(g >> _U(42)).astype(np.int64)] & (doc[: len(g)] == doc[SEED_WORDS - 1 :]))
        lo, hi = np.searchsorted(self.keys, g[hit], side="left"), np.searchsorted(self.keys, g[hit], side="right")
        hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(hit):
            return []
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        seeds = np.unique(np.stack([np.repeat(doc[hit], n), self.item[at], self.place[at]], axis=1), axis=0)
        out, cut = [], np.flatnonzero(np.r_[True, (seeds[1:, :2] != seeds[:-1, :2]).any(axis=1), True])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            covered = np.minimum(np.diff(seeds[a:b, 2]), SEED_WORDS).sum() + SEED_WORDS
            if covered >= min(coverage * len(self.items[seeds[a, 1]]), enough):
                out.append((int(seeds[a, 0]), int(seeds[a, 1])))
        return out


def _blocks(benchmark: DataFrame, most: int):
    rows, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        n += len((r[1] or "").split())
        if n >= most:
            yield Block.of(rows)
            rows, n = [], 0
    if rows:
        yield Block.of(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED_WORDS, block_words: int = BLOCK_WORDS, enough: int = ENOUGH) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest for every leaked pair."""
    if least < SEED_WORDS:
        raise ValueError("tiles shorter than a seed cannot be found")
    out = None
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    rows = docs.select("doc_id", "text").filter("text is not null")
    for block in _blocks(benchmark, block_words):

        def run(batches, block=block):
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                k = 0
                while k < len(ids):
                    lot, size, first = [], 0, k
                    while k < len(ids) and (not lot or size < _BLOCK_BYTES):
                        lot.append(texts[k].as_py().lower().encode())
                        size += len(lot[-1])
                        k += 1
                    found = []
                    for d, i in block.near(lot, coverage, enough):
                        made = tiles(_word.findall(lot[d]), block.items[i], least)
                        covered = sum(n for _, _, n in made)
                        share = covered / len(block.items[i])
                        if share >= coverage or covered >= enough:
                            found.append((ids[first + d], block.ids[i], share, len(made), made[0][2]))
                    if found:
                        cols = [pa.array(c) for c in zip(*found, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "coverage", "n_tiles", "longest"]).cast(out_schema)

        out_schema = pa.schema(
            [("doc_id", pa.string() if doc_type == "string" else pa.int64()), ("item_id", pa.int64() if item_type != "string" else pa.string()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]
        )
        found = rows.mapInArrow(run, f"doc_id {doc_type}, item_id {'string' if item_type == 'string' else 'long'}, coverage double, n_tiles long, longest long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, coverage double, n_tiles long, longest long")
    return out
