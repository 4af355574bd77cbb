"""Trie of conversation prefixes, encoded as balanced parentheses per shard.

Turns are known by digests, a prefix by sums of hashes of (position, digest), so positions and prefixes come from running sums
over blocks of bounded size, however long a conversation is. Equal conversations become one path with a number
of members. Prefixes that several paths share form the trie proper; what a path has alone behind them is a chain, whose
values follow from the path and its running sums and which enters the trie as one leaf.

Paths are sorted in depth-first order and cut by range into shards. A shard writes its part of the trie as balanced
parentheses with range min-max blocks (see ``parentheses``): ``close`` delimits a node's subtree, the rank of leaf pairs tells which
paths lie in it, and cumulative arrays over paths and nodes give members, leaves and saved bytes as differences. Nodes on
the first or last path of a part (its spines) may stand in several parts; each part knows the path before it, counts a
node only where it is first seen, and so the parts of a spine are merged by adding them up.

Defined cases: rows without a conv_id belong to no conversation and take no part; null role or text: empty; null turns come
first; equal turn numbers are ordered by a digest of role and text, repeated rows are turns of their own; a conversation without
turns after rebuilding is a member of the root; an empty table has no nodes, not even a root. Texts do not move. Bounded
by a task: the turns that two different conversations share from their start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workset import Scratch, salted_join
from .parentheses import Parentheses

# Positions in a running sum's block; rows of one key beyond which joins spread it; nodes of a part; ids in a lot of ids.
BLOCK, HOT_ROWS, NODES, LOT = 4096, 5_000, 200_000, 4096
LANES = 4
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "ka", "kb"]


def turns_of(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, at (position from 0), a, b (digest of role and text), size (bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn"), told.alias("told"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")
    )
    own = own.select("conv_id", "turn", F.xxhash64("told", F.lit(1)).alias("a"), F.xxhash64("told", F.lit(2)).alias("b"), "size", "row")
    # ranges cut a long conversation into blocks; the row's position parts even repeated rows
    order = ["turn", "a", "b", "row"]
    dealt = own.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id())
    placed = running(scratch.settle(dealt), "conv_id", "block", order, {"at": F.lit(1)}, scratch)
    return placed.select("conv_id", (F.col("at") - 1).alias("at"), "a", "b", "size")


def running(rows: DataFrame, key: str, block: str, order: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``rows`` with sums over all rows of the key up to this one; ``block`` is a number that grows with the order within a key.

    A window never holds more than one block of a key, and blocks are added up in a second one. ``rows`` are read twice.
    """
    rows = rows.withColumns({f"_v_{c}": v for c, v in sums.items()})
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, block).agg(*[F.sum(f"_v_{c}").alias(f"_b_{c}") for c in sums])
    blocks = blocks.select(key, block, *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    rows = rows.withColumns({c: F.sum(f"_v_{c}").over(inside) for c in sums})
    whole = rows.join(blocks, [key, block]).withColumns({c: (F.col(c) + F.col(f"_b_{c}")).cast("long") for c in sums})
    return scratch.settle(whole.drop(*[f"_{x}_{c}" for c in sums for x in "vb"]))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The conversations with the beginning of the first of their five: (conv_id, length), and (conv_id, at, a, b, size).

    Conversation c takes the first h turns of c - c % 5, h = crc32(c) % 9, and then its own after its first h.
    """
    lengths = scratch.settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    begin = turns.filter("at < 8").groupBy(F.col("conv_id").alias("lender")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "size"))).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    heads = lengths.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("lender")).join(begin, "lender", "left")
    heads = heads.withColumn("lent", F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.array().cast(begin.schema["lent"].dataType)))
    heads = scratch.settle(heads.select("conv_id", "own", "h", F.size("lent").alias("taken"), "lent"))
    head = heads.select("conv_id", F.inline("lent"))
    hot = heads.select("conv_id", F.col("own").alias("n"))
    tail = salted_join(turns, heads.select("conv_id", "h", "taken"), ["conv_id"], "inner", F.col("at"), F.col("at") >= F.col("h"), hot_rows=HOT_ROWS, hot=hot)
    tail = tail.select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "a", "b", "size")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.select("conv_id", length.alias("length")), scratch.settle(head.unionByName(tail))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, ka, kb (key of the first ``depth`` turns), size (of the last), upto (bytes of all of them)."""
    lane = lambda k: F.xxhash64("a", "b", "at", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = turns.withColumn("block", F.floor(F.col("at") / BLOCK))
    lanes = {f"l{k}": lane(k) for k in range(LANES)}
    sums = running(rows, "conv_id", "block", ["at"], lanes | {"upto": F.col("size")}, scratch)
    key = lambda seed: F.xxhash64(*lanes, F.col("at"), F.lit(seed))
    return sums.select("conv_id", (F.col("at") + 1).alias("depth"), key(1).alias("ka"), key(2).alias("kb"), "size", "upto")


def ends(members: DataFrame) -> DataFrame:
    """ka, kb, ends (hex): digest of the comma-joined ids per key, in ascending order.

    Ids are joined to lots where range partitions have put them in order; one pass over the lots of a key makes its digest.
    """

    def lots(batches):
        for batch in filter(len, batches):
            ka, kb, ids = (batch.column(c).to_numpy() for c in ("ka", "kb", "conv_id"))
            cut = np.flatnonzero((ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])) + 1
            cut = np.union1d(np.r_[0, cut], np.arange(0, len(ids), LOT)).astype(int)
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cut, [*cut[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ka[cut]), pa.array(kb[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], names=["ka", "kb", "first", "ids"])

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids")), strict=True):
                if (ka, kb) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (ka, kb), hashlib.sha256(ids.encode())
            yield batch_of(out)
        if key:
            yield batch_of([(*key, state.hexdigest())])

    def batch_of(rows):
        schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    order = ["ka", "kb", "conv_id"]
    joined = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lots, "ka long, kb long, first long, ids string")
    together = joined.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first")
    return together.mapInArrow(digests, "ka long, kb long, ends string")


def paths(conversations: DataFrame, every: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id (the smallest), members, length, ka, kb, total (bytes), ends: one row per different conversation."""
    last = F.max(F.struct("depth", "ka", "kb", "upto"))
    at_end = every.groupBy("conv_id").agg(last.alias("last"))
    known = conversations.join(at_end, "conv_id", "left").select(
        "conv_id", "length", *[F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in ("ka", "kb")], F.coalesce("last.upto", F.lit(0)).alias("total")
    )
    known = scratch.settle(known)
    same = known.groupBy("length", "ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members"), F.max("total").alias("total"))
    same = scratch.settle(same)
    several = same.filter("members > 1").select("ka", "kb", F.col("members").alias("n"))
    copies = salted_join(known.select("ka", "kb", "conv_id"), several.drop("n"), ["ka", "kb"], "inner", F.col("conv_id"), hot_rows=HOT_ROWS, hot=several)
    told = same.join(scratch.settle(ends(copies)), ["ka", "kb"], "left")
    return scratch.settle(told.withColumn("ends", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256))))


class Part:
    """A run of paths in depth-first order as balanced parentheses; every path ends in a leaf pair of its own."""

    def __init__(self, before: list[tuple]):
        """``before``: the nodes of the path that stands before the first one."""
        self.before, self.open = before, []
        self.bits, self.nodes, self.new, self.over = [1], [(0, 0, 0, 0)], [False], [-1]
        self.path, self.above = [], []

    def add(self, path: dict) -> None:
        nodes = path["nodes"]
        known = self.open if self.path else self.before
        same = _common(known, nodes)
        kept = same if self.path else 0
        self.bits += [0] * (len(self.open) - kept)
        del self.open[kept:]
        stack = self.stack[: kept + 1] if self.path else [0]
        for k in range(kept, len(nodes)):
            self.bits.append(1)
            self.over.append(stack[-1])
            stack.append(len(self.nodes))
            self.nodes.append(nodes[k])
            self.new.append(k >= same)
            self.open.append(nodes[k])
        self.stack = stack
        if not self.path:
            self.first = stack
        self.bits += [1, 0]
        self.path.append(path)
        self.above.append(stack[-1])

    def close(self) -> tuple[pa.RecordBatch, list[tuple]]:
        """What the part says of its nodes and of the chains behind them, and its last path."""
        tree = Parentheses(self.bits + [0] * (len(self.open) + 1))
        get = lambda c: np.array([p[c] for p in self.path], np.int64)
        conv, members, length, total = (get(c) for c in ("conv_id", "members", "length", "total"))
        shared = np.array([len(p["nodes"]) for p in self.path], np.int64)
        depth, ka, kb, size = (np.array(c, np.int64) for c in zip(*self.nodes, strict=True))
        new, over, above = np.array(self.new), np.array(self.over), np.array(self.above)
        # positions of nodes: opening parentheses that are not the first of a leaf pair
        leaf = np.zeros(len(tree.bits), bool)
        leaf[:-1] = (tree.bits[:-1] == 1) & (tree.bits[1:] == 0)
        place = np.flatnonzero((tree.bits == 1) & ~leaf)
        end = tree.close(place)
        low, high = tree.leaf_rank(place), tree.leaf_rank(end)
        upto = lambda values: np.r_[0, np.cumsum(values)]
        between = lambda values: (s := upto(values))[high] - s[low]
        chain = length > shared
        n = between(members)
        # bytes on the way to each node, for what a path has behind the shared ones
        deep = size.copy()
        for k in range(1, len(deep)):
            deep[k] += deep[over[k]]
        spare = between((members - 1) * (total - deep[above]) * chain)
        first, last = tree.rank(place) - low, tree.rank(end) - high
        weight = upto(n * size - np.where(new, size, 0))
        saved = weight[last] - weight[first] + spare
        children = np.bincount(over[1:][new[1:]], minlength=len(depth)) + np.bincount(above[chain], minlength=len(depth))
        least = np.minimum.reduceat(np.r_[conv, np.iinfo(np.int64).max], np.stack([low, high], 1).ravel())[::2]
        spine = np.zeros(len(depth), bool)
        spine[self.first] = spine[self.stack] = True
        told = [None] * len(depth)
        for k in np.flatnonzero(~chain):
            told[above[k]] = self.path[k]["ends"]
        rows = np.r_[np.arange(len(depth)), np.full(chain.sum(), -1)]
        up = np.r_[over, above[chain]]
        pick = lambda values, other: np.r_[values, other]
        none = np.zeros(chain.sum(), np.int64)
        columns = {
            "node": rows >= 0, "conv_id": pick(least, conv[chain]), "depth": pick(depth, shared[chain] + 1), "ka": pick(ka, none), "kb": pick(kb, none),
            "n_convs": pick(n, members[chain]), "n_children": pick(children, none), "n_leaves": pick(between(chain), none), "saved": pick(saved, none),
            "spine": pick(spine, none > 0), "over_conv": least[up], "over_ka": ka[up], "over_kb": kb[up], "over_spine": (up >= 0) & spine[up],
        }
        arrays = [pa.array(v.astype(np.int64) if v.dtype != bool else v) for v in columns.values()]
        batch = pa.RecordBatch.from_arrays([*arrays, pa.array([*told, *[None] * len(none)], pa.string())], names=[*columns, "ends"])
        return batch, list(self.open)


_PART = (
    "node boolean, conv_id long, depth long, ka long, kb long, n_convs long, n_children long, n_leaves long, saved long, spine boolean,"
    " over_conv long, over_ka long, over_kb long, over_spine boolean, ends string"
)


def _common(a: list, b: list) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def _parts(batches):
    """Rows in order of shard and path; a shard's first row holds the path before it."""
    shard, part = None, None
    for batch in batches:
        for row in batch.to_pylist():
            nodes = [(n["depth"], n["ka"], n["kb"], n["size"]) for n in row["nodes"]]
            if row["shard"] != shard or part is None:
                if part is not None and part.path:
                    yield part.close()[0]
                shard, part = row["shard"], Part([])
            if row["conv_id"] is None:
                part.before = nodes
                continue
            part.add(row | {"nodes": nodes})
            if len(part.nodes) + len(part.path) > NODES:
                told, before = part.close()
                yield told
                part = Part(before)
    if part is not None and part.path:
        yield part.close()[0]


def build(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The result reads tables of ``scratch``.
    """
    talks, turns = rebuilt(turns_of(conversations, scratch), scratch)
    every = prefixes(turns, scratch)
    different = paths(talks, every, scratch)
    # only the smallest conversation of each path goes on
    lengths = different.select("conv_id", F.col("length").alias("n"))
    every = salted_join(every, different.select("conv_id", "length"), ["conv_id"], "inner", F.col("depth"), hot_rows=HOT_ROWS, hot=lengths)
    every = scratch.settle(every)
    shared = scratch.settle(every.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    every = salted_join(every, shared.select(*_NODE, F.lit(True).alias("shared")), _NODE, "left", F.col("conv_id"), hot_rows=HOT_ROWS, hot=shared)
    every = scratch.settle(every)
    nodes = every.filter("shared").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_NODE, "size"))).alias("nodes"))
    routes = different.join(nodes, "conv_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(nodes.schema["nodes"].dataType)))
    routes = routes.select("conv_id", "members", "length", "total", "ends", "nodes")
    routes = scratch.settle(routes.repartitionByRange("nodes", "conv_id").withColumn("shard", F.spark_partition_id()))
    # one row per shard
    bounds = routes.groupBy("shard").agg(F.max(F.struct("nodes", "conv_id")).alias("last"))
    bounds = bounds.select("shard", F.lag("last.nodes").over(Window.orderBy("shard")).alias("nodes")).filter("nodes is not null")
    rows = routes.unionByName(bounds, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("conv_id").isNotNull(), "nodes", "conv_id")
    parts = scratch.settle(rows.mapInArrow(_parts, _PART))

    spines = parts.filter("node and spine").groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        *[F.max(c).alias(c) for c in ("over_conv", "over_ka", "over_kb", "over_spine", "ends")],
    )
    spines = scratch.settle(spines)
    whole = parts.filter("not (node and spine)").drop("spine").unionByName(spines.withColumn("node", F.lit(True)))
    # a parent on a spine has its smallest member from all parts
    over = spines.select(F.col("depth").alias("_d"), F.col("ka").alias("_a"), F.col("kb").alias("_b"), F.col("conv_id").alias("_conv"))
    whole = whole.withColumns({"_d": F.col("depth") - 1, "_a": F.col("over_ka"), "_b": F.col("over_kb")})
    whole = salted_join(whole, over, ["_d", "_a", "_b"], "left", F.col("conv_id"), hot_rows=HOT_ROWS, right_rows=spines.count())
    whole = whole.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("_conv", "over_conv")))
    whole = scratch.settle(whole.drop("_d", "_a", "_b", "_conv"))

    # only a root that is alone has no path behind it
    trie = whole.filter("node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256")
    )
    chains = whole.filter("not node").select("conv_id", F.col("depth").alias("_from"), F.col("parent_conv_id").alias("_over"))
    chains = chains.join(different.select("conv_id", "members", "total", "ends"), "conv_id")
    alone = every.filter("shared is null")
    alone = salted_join(alone, chains, ["conv_id"], "inner", F.col("depth"), hot_rows=HOT_ROWS, hot=lengths)
    last = F.col("depth") == F.col("length")
    alone = alone.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("_from"), F.col("_over")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"),
    )
    return trie.unionByName(alone)
