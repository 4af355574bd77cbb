"""Token ids in Arrow's random-access file format.

Every file is a sequence of record batches whose columns are fixed-size lists, so a memory map gives sequence i without copying:
``ids`` (the token ids, 16 bits where the vocabulary allows), ``mask`` (true for real tokens, false for the padding after a
file's last one) and ``first`` (true where a document begins); ``doc_ids`` names the documents that begin in the sequence.
Files hold ascending ranges of doc_id, documents follow each other without gaps and each ends with the end id.

A file is written under a name of its own by every attempt of its task, and only the names that successful tasks
return reach the manifest: lost executors and repeated attempts leave at most unlisted files.

Defined cases: a null text is empty (the end id alone); null doc_ids come first; equal doc_ids are ordered by a hash of
the text; an empty table gives a manifest without documents. Texts are cut at ASCII white space, which the tokenizer drops,
and every different piece is encoded once per worker, many pieces in one string with a mark after each.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20
SEQUENCE, PER_BATCH = 2048, 64
# A task encodes about this much text at a time; a worker remembers so many pieces.
LOT_BYTES, REMEMBERED = 16 << 20, 1_000_000
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"

_WHITE = "\t\n\v\f\r"
# Pieces that a string for the tokenizer holds, and the character after each.
_JOINED, _MARK = 200, "\x01"
_workers: dict[str, _Worker] = {}


class _Worker:
    """The tokenizer of this worker process and the ids of the pieces it has met, one after the other in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark, other = (self.tokenizer.encode(c, add_special_tokens=False).ids for c in (_MARK, "\x02"))
        # an id of its own, and not one that stands for anything unknown
        self.mark = mark[0] if len(mark) == 1 and mark != other else None
        self.forget()

    def forget(self) -> None:
        self.place = {"": 0}
        self.ids, self.ends = np.zeros(0, self.type), np.zeros(1, np.int64)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings in a row, and how many each has."""
        lots = (self.tokenizer.encode_batch_fast(strings[k : k + 20_000], add_special_tokens=False) for k in range(0, len(strings), 20_000))
        ids = [e.ids for lot in lots for e in lot]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.type, sizes.sum()), sizes

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encode`` of pieces that do not hold the mark, which spares most of the cost of a call."""
        if self.mark is None:
            return self._encode(pieces)
        after = f" {_MARK} "
        ids, _ = self._encode([after.join(pieces[k : k + _JOINED]) + after for k in range(0, len(pieces), _JOINED)])
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(pieces):
            return self._encode(pieces)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def places(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.forget()
        new = [w for w in pieces if w not in self.place]
        if new:
            first = len(self.place)
            # like pieces follow each other: what the tokenizer looks up for them is in the processor's cache
            plain, marked = sorted(w for w in new if _MARK not in w), [w for w in new if _MARK in w]
            new = plain + marked
            (ids, sizes), (more, n_more) = self._encode_pieces(plain), self._encode(marked)
            self.ids = np.r_[self.ids, ids, more]
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(np.r_[sizes, n_more])]
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))


def worker(path: str) -> _Worker:
    if path not in _workers:
        _workers[path] = _Worker(path)
    return _workers[path]


def _pieces(text: str) -> str:
    for c in _WHITE:
        if c in text:
            text = text.replace(c, " ")
    return text


def encode(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids end. Every different piece is encoded once."""
    own = worker(path)
    split = pc.split_pattern(pa.array(map(_pieces, texts), pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    place = own.places(coded.dictionary.to_pylist())
    index = place[coded.indices.to_numpy()]
    ends = own.ends[index]
    n = np.diff(own.ends, prepend=0)[index]
    upto = np.cumsum(n)
    out = own.ids[np.repeat(ends - upto, n) + np.arange(upto[-1] if len(upto) else 0)]
    return out, np.r_[0, upto][split.offsets.to_numpy()[1:]]


def _schema(code: str, length: int) -> pa.Schema:
    ids = pa.uint16() if code == "H" else pa.uint32()
    return pa.schema(
        [("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length)), ("first", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))]
    )


class _Writer:
    """Cuts a stream of documents into sequences and writes full batches as they come."""

    def __init__(self, path: str, code: str, length: int):
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(at), recursive=True)
        self.schema, self.length, self.code = _schema(code, length), length, code
        self.sink = system.open_output_stream(at)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.full = length * PER_BATCH
        self.ids, self.starts, self.docs = array(code), [], []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray, end_id: int) -> None:
        self.starts.append(len(self.ids))
        self.docs.append(doc_id)
        self.n_docs += 1
        self.n_tokens += len(ids) + 1
        for k in range(0, len(ids), self.full):
            self.ids.frombytes(ids[k : k + self.full].tobytes())
            self._flush()
        self.ids.append(end_id)
        self._flush()

    def _flush(self) -> None:
        while len(self.ids) >= self.full:
            self._write(self.full)

    def _write(self, n: int) -> None:
        rows = -(-n // self.length)
        whole = rows * self.length
        ids = np.zeros(whole, np.dtype(f"<u{self.ids.itemsize}"))
        ids[:n] = np.frombuffer(self.ids, ids.dtype)[:n]
        inside = sum(s < n for s in self.starts) if self.starts and self.starts[-1] >= n else len(self.starts)
        starts = np.array(self.starts[:inside], np.int64)
        first = np.zeros(whole, bool)
        first[starts] = True
        offsets = np.searchsorted(starts, np.arange(rows + 1) * self.length)
        values = [pa.array(ids), pa.array(np.arange(whole) < n), pa.array(first)]
        lists = [pa.FixedSizeListArray.from_arrays(v, self.length) for v in values]
        lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.docs[:inside], pa.int64())))
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += rows
        self.ids = self.ids[n:]
        self.starts = [s - n for s in self.starts[inside:]]
        self.docs = self.docs[inside:]

    def close(self) -> None:
        if self.ids:
            self._write(len(self.ids))
        self.out.close()
        self.sink.close()


def _lots(batches):
    names, texts, size = [], [], 0
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            names.append(doc_id)
            texts.append(body.as_py())
            size += len(texts[-1])
            if size >= LOT_BYTES:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, length: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into files under ``folder``; returns the manifest, a lazy table that writes when it is run."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // FILE_BYTES))
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def files(batches):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        out = _Writer(name, worker(path).type.char, length)
        for names, texts in _lots(batches):
            ids, ends = encode(path, texts)
            for doc_id, a, b in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out.add(doc_id, ids[a:b], end_id)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [task.partitionId()], "path": [name], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]},
            schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]),
        )

    return ordered.mapInArrow(files, MANIFEST)


def open_file(path: str) -> pa.RecordBatchFileReader:
    """A reader over a memory map where the file is local: batches are views, not copies."""
    system, at = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at))


def sequence(reader: pa.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view into the file) and mask of sequence i."""
    batch = reader.get_batch(i // PER_BATCH)
    at, length = i % PER_BATCH, batch.schema.field("ids").type.list_size
    ids = batch.column("ids").flatten().to_numpy()[at * length : (at + 1) * length]
    return ids, batch.column("mask").flatten().slice(at * length, length).to_numpy(zero_copy_only=False)


def documents(reader: pa.RecordBatchFileReader):
    """Each document of a file: doc_id, start in the file, token count, crc32 of its ids as 32-bit little-endian numbers."""
    open_doc, start, count, crc, at = None, 0, 0, 0, 0
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        ids = batch.column("ids").flatten().to_numpy()[mask].astype("<u4")
        starts = np.flatnonzero(batch.column("first").flatten().to_numpy(zero_copy_only=False)[mask])
        names = batch.column("doc_ids").flatten().to_pylist()
        cuts = [0, *starts.tolist(), len(ids)]
        for k in range(len(cuts) - 1):
            if k:
                if open_doc is not None:
                    yield open_doc[0], start, count, crc
                open_doc, start, count, crc = (names[k - 1],), at + cuts[k], 0, 0
            crc = zlib.crc32(ids[cuts[k] : cuts[k + 1]], crc)
            count += cuts[k + 1] - cuts[k]
        at += len(ids)
    if open_doc is not None:
        yield open_doc[0], start, count, crc


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    # starts of files: sums per thousand files first, so that no task orders all of them
    files = manifest.withColumn("lot", F.floor(F.col("part") / 1024))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = files.groupBy("lot").agg(F.sum("n_tokens").alias("n_tokens")).select("lot", before(Window.orderBy("lot")).alias("first"))
    inside = before(Window.partitionBy("lot").orderBy("part"))
    listed = files.withColumn("inside", inside).join(lots, "lot").select("part", "path", (F.col("first") + F.col("inside")).alias("base"))

    def tell(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = list(documents(open_file(path)))
                for k in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array([base + s for s in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.repartition("part").mapInArrow(tell, "doc_id long, start long, n_tokens long, ids_crc32 long")
