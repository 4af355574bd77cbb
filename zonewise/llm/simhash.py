"""SimHash near-duplicates through a covering code.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of one of two 31-bit blocks. In
each block the words of the [31, 26] Hamming code are the anchors: its covering radius is 1 and every word has exactly one nearest
anchor, its home. A fingerprint is replicated to every anchor within covering radius plus threshold (1 + 1) of its
block, at most 16 per block, and compared with the fingerprints at home there. All links are found, since a partner
one bit away from a word lies within 2 of the word's home.

Equal fingerprints are one node. Within an anchor only the edges of a spanning forest are written, never all pairs; an anchor
with very many homes is spread over several tasks, each with a part of the homes. Components follow from the edges.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; rows with a null doc_id get a
fingerprint and link others, and take part in no component id unless nothing else is in it (then null); repeated rows
and repeated doc_ids each keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.workset import BROADCAST_ROWS, Scratch
from .components import components

# What a word is, the seed, the size of a shingle and the threshold.
WORD, SEED, SHINGLE, THRESHOLD = rb"[^\x20\x09-\x0D]+", 42, 3, 3
BLOCK = 31
# An anchor with more homes than this is spread over tasks of this many homes.
HOMES = 4096

_word = regex.compile(WORD)
_bits = np.arange(64, dtype=np.uint64)
_PIECE = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; memory for hashes stays bounded in very long texts."""
    words = _word.findall(text.lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _PIECE):
        hashes = np.fromiter((hashed(b" ".join(words[i : i + shingle]), SEED) for i in range(k, min(n, k + _PIECE))), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << _bits, np.uint64(0))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), and a column of strings to be kept beside them."""
    more = [keep] if keep else []

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column("text")], np.uint64)
            cols = [batch.column("doc_id"), pa.array(made.view(np.int64)), *(batch.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", *more])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + (f", {keep} string" if keep else ""))


def anchors(block: Column) -> tuple[Column, Column]:
    """The home anchor of a 31-bit word, and all anchors within distance 2.

    Bit i of a word (from 1) has the syndrome i, so a word's syndrome s is the xor of its bits' numbers, and an error
    pattern leads to a code word when its own syndrome is s: bit s alone, or any two bits i and i xor s.
    """
    masks = [sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> b & 1) for b in range(5)]
    syndrome = sum(((F.bit_count(block.bitwiseAND(F.lit(m))) % 2) * (1 << b) for b, m in enumerate(masks)), F.lit(0)).cast("int")
    near = [
        [0] if s == 0 else [1 << (s - 1), *(1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, BLOCK + 1) if i < i ^ s)] for s in range(BLOCK + 1)
    ]
    table = F.array(*[F.array(*[F.lit(p).cast("long") for p in patterns]) for patterns in near])
    flips = F.element_at(table, syndrome + 1)
    return block.bitwiseXOR(F.get(flips, F.lit(0))), F.transform(flips, lambda p: block.bitwiseXOR(p))


def _placed(number: int) -> Column:
    """Anchors of one block of ``fp``, the home among them marked."""
    block = F.shiftrightunsigned("fp", BLOCK * number).bitwiseAND(F.lit((1 << BLOCK) - 1))
    home, near = anchors(block)
    return F.transform(near, lambda a: F.struct((a * 2 + number).alias("anchor"), (a == home).alias("home")))


def replicas(prints: DataFrame, homes: int = HOMES) -> DataFrame:
    """anchor, part, fp, home: distinct fingerprints at every anchor near them, ready to be compared per (anchor, part)."""
    every = prints.select("fp", F.explode(F.concat(_placed(0), _placed(1))).alias("x")).select(F.col("x.anchor").alias("anchor"), "fp", F.col("x.home").alias("home"))
    crowded = every.filter("home").groupBy("anchor").count().filter(F.col("count") > homes)
    crowded = crowded.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("parts"))
    every = every.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # as a home a fingerprint lies in one part, as a partner in all of them
    spread = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (F.col("home") & (p == own)).alias("home")))
    return every.select("anchor", "fp", F.explode(spread).alias("x")).select("anchor", F.col("x.part").alias("part"), "fp", F.col("x.home").alias("home"))


def _forest(prints: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between homes and all fingerprints of one anchor."""
    label = np.arange(len(prints))
    edges = []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= threshold)
        labels = np.unique(label[near])
        if len(labels) > 1:
            first = {}
            for j in near:
                first.setdefault(label[j], j)
            own = label[i]
            edges += [(i, j) for other, j in first.items() if other != own]
            label[np.isin(label, labels)] = labels[0]
    return edges


def _small_runs(start: np.ndarray, size: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within short runs, all runs at once: every row against the row d places on."""
    at, left = [], np.repeat(start + size, size) - np.arange(size.sum()) - (start[0] if len(start) else 0)
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(left > d)
        hit = i[(home[i] | home[i + d]) & (np.bitwise_count(prints[i] ^ prints[i + d]) <= threshold)]
        at.append((hit, hit + d))
    return tuple(np.concatenate(x) if at else np.zeros(0, np.int64) for x in (zip(*at, strict=True) if at else ((), ())))


SHORT = 24


def _edges_of(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole groups, given as sorted runs of equal ``anchor`` (a structured or plain key)."""
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[cut, len(anchor)])
    with_home = np.add.reduceat(home.astype(np.int64), cut) > 0
    a, b = [], []
    small = (size <= SHORT) & (size > 1) & with_home
    keep = np.repeat(small, size)
    if keep.any():
        sizes = size[small]
        starts = np.cumsum(sizes) - sizes
        p, h = prints[keep], home[keep]
        i, j = _small_runs(starts, sizes, p, h, threshold)
        a.append(p[i])
        b.append(p[j])
    for k in np.flatnonzero((size > SHORT) & with_home):
        own = slice(cut[k], cut[k] + size[k])
        forest = _forest(prints[own], home[own], threshold)
        if forest:
            i, j = np.array(forest).T
            a.append(prints[own][i])
            b.append(prints[own][j])
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def edges(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links a, b between distinct fingerprints that connect all that are within ``threshold`` bits."""
    placed = replicas(prints)
    ordered = placed.repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def compare(batches):
        held = None
        for batch in chain_last(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "fp", "home")]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                # the last group may go on in the next batch
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                done = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            elif held is not None:
                done = len(held[0])
            else:
                return
            if not done:
                continue
            ready, held = [x[:done] for x in held], [x[done:] for x in held]
            group = np.cumsum(np.r_[0, (np.diff(ready[0]) != 0) | (np.diff(ready[1]) != 0)])
            a, b = _edges_of(group, ready[2].view(np.uint64), ready[3], threshold)
            if len(a):
                pairs = np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def chain_last(batches):
    """The batches that have rows, then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, root: bool = False) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``threshold`` bits) for every row.

    ``root`` adds a fingerprint that stands for the component: where doc_ids are repeated, components may share their smallest one.
    """
    if threshold > 3:
        raise ValueError("two blocks with one error each cover at most three differing bits")
    marked = scratch.settle(fingerprints(docs, key, text, shingle))
    classes = scratch.settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = scratch.settle(edges(classes.select("fp"), threshold))
    groups = components(found, scratch)
    # every fingerprint's component, then the smallest document of the component
    named = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = scratch.settle(named.join(least, "component").select("fp", "component_id", *(["component"] if root else [])))
    if of_print.count() <= BROADCAST_ROWS // 10:
        of_print = F.broadcast(of_print)
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id", *(["component"] if root else []))
