"""The elements of one array of a large JSON document, read by byte ranges of the file.

A FeatureCollection is one JSON value however large it is, so no line and no record tells a reader where to start. Here a file
is a number of ranges, a row each. A first pass tells of every range what it does to the state of a scan, for both
states it could begin in (outside a string or inside one): whether the state flips, how the nesting depth moves, and where
the wanted array may begin. Running sums over these few numbers per range give every range the exact state at its first
byte. The second pass then cuts out the elements that begin in the range, reading on behind its end for the last one.
Nothing is guessed from the text, so braces, quotes and key names inside strings do no harm.

Bytes are read through Arrow's file systems, which know local files, HDFS and the usual object stores. Files of one range
are cut without the first pass. Only the number of ranges comes to the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stores import open_store, reachable

RANGE_BYTES = 16 << 20
# Bytes that are read behind a range to see a key and its bracket whole; more tasks than this are never asked for.
_BESIDE, _TASKS = 1 << 16, 100_000
# A batch of cut elements goes on at this size.
_BATCH_BYTES = 4 << 20

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_QUOTE, _BACKSLASH, _BRACE = ord('"'), ord("\\"), ord("{")

_SIDE = "struct<moves:bigint,least:bigint,begins:array<struct<at:bigint,depth:bigint,least:bigint>>>"
_EFFECT = f"path string, k bigint, start bigint, stop bigint, flips int, from_outside {_SIDE}, from_inside {_SIDE}"


def readable(spark: SparkSession, path: str) -> bool:
    """Can the path be read by ranges: on a file system that Arrow knows, and not compressed?"""
    return reachable(spark, path) and not re.search(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$", path)


class _File:
    def __init__(self, path: str):
        system, at = open_store(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> bytes:
        start, stop = max(start, 0), min(stop, self.size)
        return self.file.read_at(stop - start, start) if stop > start else b""

    def backslashes_before(self, at: int) -> int:
        """How many backslashes stand directly before a position."""
        n, step = 0, 64
        while at - n > 0:
            block = self.read(at - n - step, at - n)
            here = len(block) - len(block.rstrip(b"\\"))
            n += here
            if here < len(block):
                break
            step = min(step * 8, 1 << 20)
        return n


def _quotes(data: np.ndarray, backslashes: int) -> np.ndarray:
    """Positions of the quotes that begin or end a string."""
    at = np.flatnonzero(data == _QUOTE)
    behind = np.zeros(len(at), bool)
    inner = at > 0
    behind[inner] = data[at[inner] - 1] == _BACKSLASH
    behind[~inner] = backslashes > 0
    keep = np.ones(len(at), bool)
    for k in np.flatnonzero(behind):
        j = at[k] - 1
        while j >= 0 and data[j] == _BACKSLASH:
            j -= 1
        run = at[k] - 1 - j + (backslashes if j < 0 else 0)
        keep[k] = run % 2 == 0
    return at[keep]


class _Range:
    """Brackets and quotes of a stretch of bytes."""

    def __init__(self, data: bytes, backslashes: int):
        self.data = np.frombuffer(data, np.uint8)
        self.quotes = _quotes(self.data, backslashes)
        step = _STEP[self.data]
        self.places = np.flatnonzero(step)
        self.steps = step[self.places].astype(np.int64)

    def flips(self) -> int:
        return len(self.quotes) % 2

    def in_string(self, at, begins_inside: int):
        return (np.searchsorted(self.quotes, at) + begins_inside) % 2

    def nesting(self, begins_inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Brackets outside strings: their positions, their steps, the depth behind each (from 0 at the start)."""
        outside = self.in_string(self.places, begins_inside) == 0
        steps = self.steps[outside]
        return self.places[outside], steps, np.cumsum(steps)


def _effect(file: _File, start: int, stop: int, key: re.Pattern) -> dict:
    whole = file.read(start, stop + _BESIDE)
    part = _Range(whole[: stop - start], file.backslashes_before(start))
    found = [m for m in key.finditer(whole) if m.start() < stop - start]
    own = set(part.quotes.tolist()) if found else set()
    sides = []
    for inside in (0, 1):
        places, _, depth = part.nesting(inside)
        begins = []
        for m in found:
            if m.start() in own and part.in_string(m.start(), inside) == 0:
                before = np.searchsorted(places, m.start())
                after = depth[np.searchsorted(places, m.end() - 1) :]
                begins.append({"at": start + m.end() - 1, "depth": int(depth[before - 1]) if before else 0, "least": int(after.min()) if len(after) else None})
        sides.append({"moves": int(depth[-1]) if len(depth) else 0, "least": int(depth.min(initial=0)), "begins": begins})
    return {"flips": part.flips(), "from_outside": sides[0], "from_inside": sides[1]}


def _elements(file: _File, start: int, stop: int, inside: int, depth: int, array: int):
    """Objects directly in the array that begins at ``array``, of those that begin in the range."""
    data = file.read(start, stop)
    part = _Range(data, file.backslashes_before(start))
    places, steps, level = part.nesting(inside)
    level = level + depth
    behind = start + places > array
    ended = np.flatnonzero(behind & (level <= 1))
    upto = ended[0] if len(ended) else len(places)
    opens = np.flatnonzero(behind & (steps == 1) & (level == 3) & (part.data[places] == _BRACE))
    opens = places[opens[opens < upto]]
    closes = places[(steps == -1) & (level == 2)]
    ends = np.searchsorted(closes, opens)
    for first, k in zip(opens.tolist(), ends.tolist(), strict=True):
        if k < len(closes):
            yield data[first : closes[k] + 1]
        else:
            state = int(part.in_string(len(data), inside))
            yield data[first:] + _rest(file, stop, state, int(level[-1]))


def _rest(file: _File, start: int, inside: int, depth: int) -> bytes:
    """The bytes from ``start`` to the end of the element that is open there."""
    out, step = [], 1 << 16
    while start < file.size:
        data = file.read(start, start + step)
        part = _Range(data, file.backslashes_before(start))
        places, steps, level = part.nesting(inside)
        done = np.flatnonzero((steps == -1) & (level + depth == 2))
        if len(done):
            return b"".join([*out, data[: places[done[0]] + 1]])
        out.append(data)
        inside = int(part.in_string(len(data), inside))
        depth += int(level[-1]) if len(level) else 0
        start += len(data)
        step = min(step * 4, RANGE_BYTES)
    raise ValueError(f"the document ends within an element (byte {start})")


def array_elements(spark: SparkSession, path, key: str, range_bytes: int | None = None) -> DataFrame:
    """``value``: the text of every object in the array ``key`` at the top of each JSON document.

    A document without such an array has no rows, and elements that are no objects are left out. A document that ends within
    an element is an error.
    """
    size = range_bytes or RANGE_BYTES
    # the names and lengths of the files; their content is not read here
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    n_of = F.ceil(F.col("length") / size).cast("long")
    n_files, n = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(n_of), F.lit(0))).first()
    spread = lambda df: df.repartition(max(1, min(n, _TASKS)))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n_of - 1)).alias("k"))
    start = F.col("k") * size
    ranges = spread(ranges.select("path", "k", start.alias("start"), F.least(start + size, "length").alias("stop")))
    begin = re.compile(rb'"' + re.escape(key.encode()) + rb'"[ \t\r\n]*:[ \t\r\n]*\[')

    def effects(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row |= _effect(_File(row["path"]), row["start"], row["stop"], begin)
            yield pa.RecordBatch.from_pylist(rows, schema=effect_schema)

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file, out, held = _File(row["path"]), [], 0
                array = row["array"]
                if array is None and row["start"] == 0:  # a file of one range has not been looked at before
                    told = _effect(file, 0, row["stop"], begin)["from_outside"]["begins"]
                    array = min((b["at"] for b in told if b["depth"] == 1), default=None)
                if array is None:
                    continue
                for value in _elements(file, row["start"], row["stop"], row["inside"], row["depth"], array):
                    out.append(value)
                    held += len(value)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    if n == n_files:
        known = ranges.select("path", "start", "stop", F.lit(0).alias("inside"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("array"))
    else:
        effect_schema = _arrow_schema(spark)
        known = spread(_states(ranges.mapInArrow(effects, _EFFECT)))
    return known.mapInArrow(cut, "value binary").select(F.col("value").cast("string").alias("value"))


def _arrow_schema(spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(_EFFECT))


def _states(effects: DataFrame) -> DataFrame:
    """The state at the start of every range that may hold elements. Windows run over the ranges of a file, some numbers each."""
    file = Window.partitionBy("path")
    before = file.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = effects.withColumn("inside", (sofar("flips") % 2).cast("int"))
    known = known.withColumn("side", F.when(F.col("inside") == 0, F.col("from_outside")).otherwise(F.col("from_inside")))
    known = known.withColumn("depth", sofar("side.moves"))
    known = known.withColumn("own", F.get(F.filter("side.begins", lambda b: b["depth"] + F.col("depth") == 1), F.lit(0)))
    known = known.withColumn("array", F.min("own.at").over(file))
    # the least depth since the array began: at 1 it has ended
    low = F.when(F.col("own.at") == F.col("array"), F.col("depth") + F.col("own.least")).when(F.col("start") > F.col("array"), F.col("depth") + F.col("side.least"))
    known = known.withColumn("low", low).withColumn("ended", F.coalesce(F.min("low").over(before) <= 1, F.lit(False)))
    return known.filter((F.col("stop") > F.col("array")) & ~F.col("ended")).select("path", "start", "stop", "inside", "depth", "array")
