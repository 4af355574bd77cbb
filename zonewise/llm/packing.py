"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it; all pieces are packed by best fit in falling order of
length. Which bin size to open is decided jointly over all permitted lengths: for every permitted size the whole packing is
planned with that size opened wherever it is large enough (longer pieces open the least-cost size that holds them), every
bin is downsized to the least-cost size that holds its contents, and the plan of least total cost is taken.

Planning needs only how many pieces there are of each length, at most as many numbers as the largest length, however large the
corpus: bins with equal contents are planned together as one pattern with a count. Pieces then find their place by their rank
among the pieces of equal length, which comes from counts per cell, so no task sorts all pieces of a length.

Defined cases: null and empty texts have no words and one token (the end mark), as every document ends with one; repeated rows and rows
without a doc_id are pieces of their own; an empty table packs nothing.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workset import Scratch

LENGTHS = (512, 1024, 2048, 4096, 8192)
# Pieces of one length are ranked in cells of about this many.
CELL_ROWS = 1_000


def cost(length: int) -> float:
    """Of one sequence: its tokens, and attention that grows with the square."""
    return length * (1 + length / 32768)


def n_tokens(text: Column) -> Column:
    """Words between white space, and one end mark."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))) + 1).cast("long")


class _Bins:
    """Open bins as patterns with counts, by the room they have left."""

    def __init__(self):
        self.rooms: list[int] = []
        self.by_room: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, count]

    def put(self, room: int, pattern: tuple, count: int) -> None:
        if not self.by_room[room]:
            bisect.insort(self.rooms, room)
        self.by_room[room].append([pattern, count])

    def take(self, least: int):
        """A group with the smallest room of at least ``least``, removed from the open bins."""
        k = bisect.bisect_left(self.rooms, least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        pattern, count = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.pop(k)
        return room, pattern, count


def best_fit(counts: dict[int, int], opened: int, lengths: tuple[int, ...], price=cost) -> list[tuple[int, tuple, int]]:
    """Patterns (capacity, ((length, times), ...), bins) of best fit decreasing with new bins of size ``opened`` where that is enough."""
    bins = _Bins()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            group = bins.take(length)
            if group is None:
                size = opened if opened >= length else min((c for c in lengths if c >= length), key=price)
                group = size, (), -(-left // (size // length))
            room, pattern, count = group
            fit = room // length
            # one bin after the other is filled: best fit returns to the bin it has just used
            full = min(count, left // fit)
            if full:
                bins.put(room - fit * length, (*pattern, (length, fit)), full)
                left -= full * fit
            if full < count and left:
                bins.put(room - left * length, (*pattern, (length, left)), 1)
                full, left = full + 1, 0
            if full < count and pattern:
                bins.put(room, pattern, count - full)
    merged: dict[tuple, int] = defaultdict(int)
    for groups in bins.by_room.values():
        for pattern, count in groups:
            merged[pattern] += count
    out = []
    for pattern, count in sorted(merged.items(), reverse=True):
        used = sum(length * times for length, times in pattern)
        out.append((min((c for c in lengths if c >= used), key=price), pattern, count))
    return out


def plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, price=cost) -> list[tuple[int, tuple, int]]:
    """The least-cost packing over all sizes that could be opened."""
    plans = [best_fit(counts, size, lengths, price) for size in lengths]
    return min(plans, key=lambda p: sum(price(capacity) * n for capacity, _, n in p))


def _slots(patterns: list[tuple[int, tuple, int]]) -> list[tuple]:
    """Per length and pattern: the ranks first <= r < last of the pieces that go there, and where their bins and places begin."""
    taken: dict[int, int] = defaultdict(int)
    rows, bins = [], 0
    for capacity, pattern, count in patterns:
        offset, total = 0, sum(length * times for length, times in pattern)
        for length, times in pattern:
            first = taken[length]
            taken[length] += times * count
            rows.append((length, first, taken[length], bins, times, offset, capacity, total))
            offset += length * times
        bins += count
    return rows


def pieces(docs: DataFrame, tokens: Column, largest: int) -> DataFrame:
    """doc_id, piece, start, length: documents cut at every ``largest`` tokens."""
    sized = docs.select("doc_id", tokens.alias("n"))
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))
    return sized.select("doc_id", "n", F.explode(cut).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).cast("int").alias("length"),
    )


def pack(docs: DataFrame, scratch: Scratch, lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, price=cost) -> DataFrame:
    """doc_id, piece, start, length (in tokens), bin_id (gapless from 0), capacity, bin_offset, bin_tokens for every piece."""
    lengths = tuple(sorted(lengths))
    cut = scratch.settle(pieces(docs, n_tokens(F.col("text")) if tokens is None else tokens, lengths[-1]))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most lengths[-1] rows
    if not counts:
        schema = "doc_id long, piece long, start long, length int, bin_id long, capacity int, bin_offset int, bin_tokens int"
        return docs.sparkSession.createDataFrame([], schema)
    schema = "_length int, first long, last long, bin0 long, times int, offset0 int, capacity int, bin_tokens int"
    # a few patterns for each of at most lengths[-1] lengths, whatever the corpus holds
    slots = docs.sparkSession.createDataFrame(_slots(plan(counts, lengths, price)), schema)

    many = {length: -(-n // CELL_ROWS) for length, n in counts.items() if n > CELL_ROWS}
    cells = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("length")), F.lit(1)) if many else F.lit(1)
    placed = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), cells).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = placed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    bases = per_cell.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(slots), here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        (F.col("bin0") + F.floor(nth / F.col("times"))).cast("long").alias("bin_id"),
        "capacity",
        (F.col("offset0") + (nth % F.col("times")) * F.col("length")).cast("int").alias("bin_offset"),
        "bin_tokens",
    )
