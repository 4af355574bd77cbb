"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or earlier in the same
document) is removed; strings are judged on the input.

Which suffixes are kept: a full array of 100 TB of text would need five times its size, so each window of ``LENGTH`` bytes
samples the suffix at the smallest of its ``GRAM``-byte hashes. Equal windows sample at the same place, whatever surrounds
them. One entry stands for the run of neighbouring windows that sample it: the fingerprint of the gram (``gram``), of all
bytes of those windows (``body``), and the place. Arrays are ordered by gram, body and place, so equal strings are
neighbours and the earliest comes first.

The family: documents arrive in batches of ascending doc_id. Each task sorts its own part of a batch and settles what
repeats inside it; the batch is then merge-scanned with the existing levels, where equal bodies show that all windows of an entry
start earlier; what is new becomes a level, and two levels of equal size are merged into one. Entries with equal gram and
different bodies lie where a repeat begins or ends: their windows, and only theirs, are compared one by one at the end.

Fingerprints of 128 bits stand for equal strings. A gram that is crowded in one task's part is spread over several scan tasks by body
(its entries count as ends of repeats, which is always safe).

Defined cases: a null text is empty; rows without a doc_id stay whole and repeat nothing; repeated rows (same doc_id and text) are
one document and get equal results; different texts under one doc_id are judged as parts of one document; texts of any
length are hashed in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workset import Scratch
from .bytehash import Rolling, window_minima

LENGTH, GRAM = 100, 40
BATCHES = 4
# A task sorts the entries of about this much text at a time, hashing blocks of the second size.
SORT_BYTES, BLOCK_BYTES = 8 << 20, 1 << 18
# A gram with more bodies than this in one sort is spread over SALTS scan tasks.
CROWDED, SALTS = 1000, 64

NEW, COVERED, ENDS, HOT = 0, 1, 2, 3
ENTRY = "gram long, body long, doc long, place long"
_MARKED = f"{ENTRY}, kind int"


def _blocks(batches, length: int):
    """Lots of (doc, offset, bytes): short texts together, long ones in segments that overlap by length - 1."""
    lot, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
            body = text.as_py().encode()
            for k in range(0, max(1, len(body) - length + 1), BLOCK_BYTES):
                piece = body[k : k + BLOCK_BYTES + length - 1]
                if len(piece) >= length:
                    lot.append((doc, k, piece))
                    size += len(piece)
                if size >= BLOCK_BYTES:
                    yield lot
                    lot, size = [], 0
    if lot:
        yield lot


def _joined(lot: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for *_, b in lot])
    return np.frombuffer(b"".join(b for *_, b in lot), np.uint8), sizes, np.cumsum(sizes) - sizes


def entries(lot: list, length: int, gram: int) -> list[np.ndarray]:
    """gram, body, doc and place of every sampled suffix of a lot.

    ``place`` packs the sample's offset, its distance from the first window's start and from the last one's: 16 bits for the two.
    """
    data, sizes, starts = _joined(lot)
    by_gram, by_body = Rolling(data, 1), Rolling(data, 2)
    grams = by_gram.grams(gram)
    sampled = window_minima(grams, length - gram + 1)
    row = np.repeat(np.arange(len(lot)), sizes)[: len(sampled)]
    at = np.flatnonzero(np.arange(len(sampled)) + length <= (starts + sizes)[row])
    s = sampled[at]
    cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(at) != 1)) + 1
    first, last, s = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]], s[np.r_[0, cut]]
    row = row[first]
    offset = s - starts[row] + np.array([k for _, k, _ in lot])[row]
    return [
        grams[s].view(np.int64),
        by_body.at(first, last + length).view(np.int64),
        np.array([d for d, *_ in lot], np.int64)[row],
        offset << 16 | (s - first) << 8 | (s - last),
    ]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows that are no run's first and stand at another place than it (a repeated row stands at the same)."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return ~new & ((doc != doc[first]) | (place != place[first]))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(end + (np.cumsum(_runs(doc)) << 42)) & ((1 << 42) - 1)
    new = _runs(doc)
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], reach[np.r_[heads[1:] - 1, len(doc) - 1]]


def _span(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes covered by an entry's windows."""
    offset = place >> 16
    return offset - (place >> 8 & 255), offset - (place & 255) + length


def _table(kind: int, a, b, doc, place) -> pa.RecordBatch:
    n = len(doc)
    cols = [pa.array(np.asarray(c, np.int64)) for c in (a, b, doc, place)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, kind, np.int32))], names=["gram", "body", "doc", "place", "kind"])


def sample(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The sorted parts of a batch: new entries, spans covered inside the part (start in gram, end in body), crowded grams."""

    def run(batches):
        held, size = [], 0

        def settled():
            g, b, d, p = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((p, d, b, g))
            g, b, d, p = g[order], b[order], d[order], p[order]
            new = _runs(g, b)
            later = _later(new, d, p)
            doc, start, end = _merged(d[later], *_span(p[later], length))
            yield _table(NEW, g[new], b[new], d[new], p[new])
            yield _table(COVERED, start, end, doc, np.zeros(len(doc)))
            names, counts = np.unique(g[new], return_counts=True)
            hot = names[counts > CROWDED]
            if len(hot):
                yield _table(HOT, hot, hot, hot, hot)

        for lot in _blocks(batches, length):
            held.append(entries(lot, length, gram))
            size += sum(len(b) for *_, b in lot)
            if size >= SORT_BYTES:
                yield from settled()
                held, size = [], 0
        if held:
            yield from settled()

    return docs.mapInArrow(run, _MARKED)


def scan(ordered: DataFrame, length: int) -> DataFrame:
    """Merge-scan of levels (old) and a batch, each partition sorted by gram, body, old first, place."""

    def run(batches):
        held = None
        names = ("gram", "body", "doc", "place", "old", "hot")
        for batch in _then_none(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                if held[0][0] == held[0][-1]:
                    continue
                done = int(np.searchsorted(held[0], held[0][-1]))  # the last gram may go on
            elif held is None:
                return
            else:
                done = len(held[0])
            g, b, d, p, old, hot = (x[:done] for x in held)
            held = [x[done:] for x in held]
            new = _runs(g, b)
            later = _later(new, d, p) & ~old
            doc, start, end = _merged(d[later], *_span(p[later], length))
            yield _table(COVERED, start, end, doc, np.zeros(len(doc)))
            own = new & ~old
            yield _table(NEW, g[own], b[own], d[own], p[own])
            # grams with several bodies, at least one of them of this batch
            run_of = np.cumsum(_runs(g)) - 1
            many = np.bincount(run_of, weights=new) > 1
            fresh = np.bincount(run_of, weights=own) > 0
            ends = new & (hot | (many & fresh)[run_of])
            yield _table(ENDS, g[ends], b[ends], d[ends], p[ends])

    return ordered.mapInArrow(run, _MARKED)


def _then_none(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


class Family:
    """Levels of the index, and what has been found so far, as tables in the shared folder."""

    def __init__(self, scratch: Scratch, length: int = LENGTH, gram: int = GRAM):
        if length - gram > 255 or gram > length:
            raise ValueError("a window may be at most 255 bytes longer than its gram")
        self.scratch, self.length, self.gram = scratch, length, gram
        self.levels: list[tuple[int, DataFrame, DataFrame]] = []  # size in batches, entries, the table that holds them
        self.covered: list[DataFrame] = []
        self.ends: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Take in a batch (doc, text) whose documents all come after those before."""
        self._merge()
        part = self.scratch.settle(sample(docs, self.length, self.gram), by="kind")
        fresh = part.filter(F.col("kind") == NEW).select("gram", "body", "doc", "place", F.lit(False).alias("old"))
        every = fresh
        for _, level, _ in self.levels:
            every = every.unionAll(level.select("gram", "body", "doc", "place", F.lit(True).alias("old")))
        # at most one gram in CROWDED entries of a part can be here, and usually none is
        hot = self.scratch.settle(part.filter(F.col("kind") == HOT).select(F.col("gram").alias("_gram")).distinct())
        crowded = hot.count()
        if crowded:
            hot = F.broadcast(hot) if crowded <= 100_000 else hot
            every = every.join(hot, F.col("gram") == F.col("_gram"), "left").withColumn("hot", F.col("_gram").isNotNull()).drop("_gram")
        else:
            every = every.withColumn("hot", F.lit(False))
        salt = F.when(F.col("hot"), F.pmod("body", F.lit(SALTS))).otherwise(0)
        ordered = every.repartition("gram", salt).sortWithinPartitions("gram", "body", F.desc("old"), "doc", "place")
        found = self.scratch.settle(scan(ordered, self.length), by="kind")
        self.covered += [self._spans(part), self._spans(found)]
        self.ends.append(found.filter(F.col("kind") == ENDS).select("doc", "place"))
        self.levels.append((1, found.filter(F.col("kind") == NEW), found))
        self.scratch.drop_part(part, f"kind={NEW}")

    def _spans(self, table: DataFrame) -> DataFrame:
        return table.filter(F.col("kind") == COVERED).select("doc", F.col("gram").alias("start"), F.col("body").alias("end"))

    def _merge(self) -> None:
        """Two youngest levels of equal size become one, as often as that is so."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, _), (_, b, _) = pair = self.levels[-2:]
            both = a.select("gram", "body", "doc", "place").unionAll(b.select("gram", "body", "doc", "place"))
            both = both.withColumn("kind", F.lit(NEW)).repartition("gram").sortWithinPartitions("gram", "body", "doc", "place")
            merged = self.scratch.settle(both, by="kind")
            self.levels[-2:] = [(2 * n, merged.filter(F.col("kind") == NEW), merged)]
            for *_, table in pair:
                self.scratch.drop_part(table, f"kind={NEW}")

    def close(self) -> None:
        """Give up the levels; what has been found stays."""
        for *_, table in self.levels:
            self.scratch.drop_part(table, f"kind={NEW}")
        self.levels = []

    def spans(self, docs: DataFrame) -> DataFrame:
        """doc, start, end of covered bytes, in pieces that may overlap; ``docs`` holds every text added."""
        ends = self.ends[0]
        for e in self.ends[1:]:
            ends = ends.unionAll(e)
        per_doc = ends.distinct().groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("place").alias("places"))
        texts = docs.join(per_doc, docs["doc"] == per_doc["_doc"]).select("doc", "text", "places")
        ordered = windows(texts, self.length).repartition("gram", "body").sortWithinPartitions("gram", "body", "doc", "place")
        out = repeated(ordered, self.length)
        for s in self.covered:
            out = out.unionAll(s)
        return out


def windows(texts: DataFrame, length: int) -> DataFrame:
    """Fingerprints of all windows of the entries in ``places``; of equal ones in a part only the earliest goes on."""

    def run(batches):
        held, size = [], 0

        def settled():
            g, b, d, p = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((p, d, b, g))
            g, b, d, p = g[order], b[order], d[order], p[order]
            new = _runs(g, b)
            later = _later(new, d, p)
            doc, start, end = _merged(d[later], p[later], p[later] + length)
            yield _table(NEW, g[new], b[new], d[new], p[new])
            yield _table(COVERED, start, end, doc, np.zeros(len(doc)))

        for batch in batches:
            for doc, text, places in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                body, place = text.as_py().encode(), places.values.to_numpy()
                offset = place >> 16
                first, last = offset - (place >> 8 & 255), offset - (place & 255)
                for k in range(0, max(1, len(body) - length + 1), BLOCK_BYTES):
                    piece = np.frombuffer(body[k : k + BLOCK_BYTES + length - 1], np.uint8)
                    here = (last >= k) & (first < k + BLOCK_BYTES) & (last + length <= len(body))
                    if not here.any() or len(piece) < length:
                        continue
                    lo = np.maximum(first[here] - k, 0)
                    n = np.minimum(last[here] - k, len(piece) - length) - lo + 1
                    at = np.unique(np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
                    one, two = Rolling(piece, 2).at(at, at + length), Rolling(piece, 4).at(at, at + length)
                    held.append([one.view(np.int64), two.view(np.int64), np.full(len(at), doc), at + k])
                    size += len(at)
                    if size >= SORT_BYTES // 16:
                        yield from settled()
                        held, size = [], 0
        if held:
            yield from settled()

    return texts.mapInArrow(run, _MARKED)


def repeated(ordered: DataFrame, length: int) -> DataFrame:
    """Spans of windows that are not the earliest of their fingerprint, from partitions sorted by it; covered spans pass."""

    def run(batches):
        first = None
        for batch in batches:
            spans = batch.filter(pa.array(batch.column("kind").to_numpy() == COVERED))
            if spans.num_rows:
                yield pa.RecordBatch.from_arrays([spans.column(c) for c in ("doc", "gram", "body")], names=["doc", "start", "end"])
            batch = batch.filter(pa.array(batch.column("kind").to_numpy() == NEW))
            if not batch.num_rows:
                continue
            g, b, d, p = (batch.column(c).to_numpy() for c in ("gram", "body", "doc", "place"))
            if first is not None:
                g, b, d, p = (np.r_[x, y] for x, y in zip(first, (g, b, d, p), strict=True))
            new = _runs(g, b)
            later = _later(new, d, p)
            k = int(np.flatnonzero(new)[-1])
            first = [x[k : k + 1] for x in (g, b, d, p)]
            doc, start, end = _merged(d[later], p[later], p[later] + length)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end)], names=["doc", "start", "end"])

    return ordered.mapInArrow(run, "doc long, start long, end long")


def repeats(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and spans (array of start, end in bytes; pieces may overlap) of the documents that hold a repeat."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(docs, batches)
    family = Family(scratch, length, gram)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = rows if low is None else rows.filter(F.col("doc") > low)
        family.add(batch if high is None else batch.filter(F.col("doc") <= high))
    family.close()
    found = family.spans(rows).filter("end > start")
    return scratch.settle(found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that divide the documents into about equal batches (how equal does not matter for the result)."""
    if batches < 2:
        return []
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*[F.lit(k / batches) for k in range(1, batches)]), F.lit(1000))).first()[0]
    return sorted(set(at or []))


def kept(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    out, at, runs = [], 0, 0
    reach = -1
    for start, end in sorted(spans):
        if start > reach:
            runs += 1
            out.append(body[at:start])
        reach = max(reach, end)
        at = max(at, end)
    out.append(body[at:])
    return b"".join(out), runs


def apply(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``_kept`` (remaining text without the characters that were cut in part) and ``_spans`` (maximal removed runs)."""
    named = found.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_found"))
    both = docs.join(named, F.col("doc_id") == F.col("_id"), "left").drop("_id")

    def run(batches):
        for batch in batches:
            made = []
            for text, spans in zip(batch.column("text"), batch.column("_found"), strict=True):
                body = (text.as_py() or "").encode()
                if spans.is_valid:
                    places = spans.values.flatten()
                    made.append(kept(body, list(zip(places[0].to_pylist(), places[1].to_pylist(), strict=True))))
                else:
                    made.append((body, 0))
            rest = batch.drop_columns(["_found"])
            rest = rest.append_column("_kept", pa.array([m[0].decode(errors="ignore") for m in made], pa.string()))
            yield rest.append_column("_spans", pa.array([m[1] for m in made], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(run, f"{schema}, _kept string, _spans long")


def digest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 without carrying the kept text further."""
    named = found.select(F.col("doc_id").alias("_id"), "spans")
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(named, F.col("doc_id") == F.col("_id"), "left").drop("_id")

    def run(batches):
        for batch in batches:
            size, removed, runs, hashes = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                body, rest, n = text.as_py().encode(), None, 0
                if spans.is_valid:
                    places = spans.values.flatten()
                    rest, n = kept(body, list(zip(places[0].to_pylist(), places[1].to_pylist(), strict=True)))
                rest = body if rest is None else rest
                size.append(len(body))
                removed.append(len(body) - len(rest))
                runs.append(n)
                hashes.append(hashlib.sha256(rest).hexdigest())
            cols = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
