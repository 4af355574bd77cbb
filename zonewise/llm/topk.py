"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: then the nearest vectors are
those with the largest inner products. Every vector is keyed by its nearest pivot and its distance to it; the distances
of a pivot are cut into rings (annuli). The directory of rings is bounded by pivots x rings whatever the corpus holds.

A query takes rings in the order of their least possible distance, in growing portions, and stops as soon as the next
ring's bound by the triangle inequality, max(0, inner - d, d - outer), lies beyond its k-th best. In a round the
queries of a ring, in blocks, meet the ring's vectors, in chunks, as matrices; only k rows per query and chunk go on.

Vectors are integer here (floor(scale * x)), scores are exact integers. The index is cut on a bounded sample (``SAMPLE`` rows in
expectation) and holds every row.

Defined cases: vectors that are null, empty, of another length than most of the sample's, or hold null or non-finite components
take no part; ties go to the smaller id; equal vectors under different ids are rows of their own, and so are different vectors
under one id; repeated rows of one id and vector count once; the k best of a query id with several vectors are taken over all
of them; a query never finds its own id; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workset import Scratch

K, SCALE = 20, 64
PIVOTS, RINGS, SAMPLE = 16, 16, 4096
CHUNK, QUERY_BLOCK = 4096, 512
# Rings a query takes in its first round; every later round takes this many times as many.
FIRST, GROWTH = 1, 4
_SLACK = 1e-6


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v (integer components) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fit = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size(x) > 0)
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fit)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, c: a + c * c)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of the sample, then a few means of their cells."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen]
    for _ in range(5):
        cell = (-2 * sample @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
        pivots = np.stack([sample[cell == p].mean(axis=0) if (cell == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1), 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def build(vectors: DataFrame, scratch: Scratch, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE):
    """The index of ``whole`` vectors: chunks per ring, the directory of rings, pivots, M^2; None without vectors."""
    rows = scratch.settle(vectors.dropDuplicates(["id", "v"]))
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))) if n > sample else rows
    drawn = drawn.select("v").toArrow().column("v").combine_chunks()
    if not n or not len(drawn):
        return None
    sizes = np.diff(drawn.offsets.to_numpy())
    dim = int(np.bincount(sizes).argmax())
    rows = rows.filter(F.size("v") == dim)
    most = float(rows.agg(F.max(_norm2(F.col("v")))).first()[0])
    lifted = drawn.filter(pa.array(sizes == dim))
    lifted = _lift(_matrix(lifted, dim), most)
    centers = _pivots(lifted, pivots)
    distance = _distances(lifted, centers)
    own = distance.argmin(axis=1)
    edges = np.stack([np.quantile(distance[own == p, p], np.linspace(0, 1, rings + 1)[1:-1]) if (own == p).any() else np.zeros(rings - 1) for p in range(len(centers))])

    def key(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_lift(_matrix(batch.column("v"), dim), most), centers)
            p = d.argmin(axis=1)
            near = d[np.arange(len(p)), p]
            ring = (near[:, None] >= edges[p]).sum(axis=1)
            cols = [batch.column("id"), batch.column("v"), pa.array(p * rings + ring, pa.int32()), pa.array(near)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "ring", "d"])

    keyed = scratch.settle(rows.mapInArrow(key, "id long, v array<long>, ring int, d double"))
    directory = keyed.groupBy("ring").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.count(F.lit(1)).alias("n")).toPandas()
    # a ring's rows, spread over chunks of about CHUNK rows by a hash of the id
    counts = F.create_map(*[F.lit(int(x)) for r in directory.itertuples() for x in (r.ring, -(-r.n // CHUNK))])
    placed = keyed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.element_at(counts, F.col("ring"))).cast("int"))
    chunks = scratch.settle(placed.groupBy("ring", "chunk").agg(F.collect_list(F.struct("id", "v")).alias("rows")))
    return chunks, directory, centers, rings, most, dim


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))]


def search(index, queries: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query (``whole`` rows)."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks, directory, centers, rings, most, dim = index
    names, inner, outer = directory["ring"].to_numpy(), directory["inner"].to_numpy(), directory["outer"].to_numpy()
    pivot = names // rings
    asked = queries.dropDuplicates(["id", "v"]).filter(F.size("v") == dim).select("id", "v")

    def plan(batches):
        """Per query the rings by their bound on the distance, in order."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.c_[_matrix(batch.column("v"), dim), np.zeros(batch.num_rows)]
            d = _distances(q, centers)[:, pivot]
            bound = np.maximum(0, np.maximum(inner - d, d - outer))
            order = np.argsort(bound, axis=1, kind="stable")
            reach = most + (q**2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("v"),
                    pa.array(reach),
                    pa.array(list(names[order].astype(np.int32)), pa.list_(pa.int32())),
                    pa.array(list(np.take_along_axis(bound, order, axis=1)), pa.list_(pa.float64())),
                ],
                names=["id", "v", "reach", "rings", "bounds"],
            )

    todo = scratch.settle(asked.mapInArrow(plan, "id long, v array<long>, reach double, rings array<int>, bounds array<double>"))
    best, at, step = None, 0, FIRST
    while at < len(names):
        upto = F.slice(F.arrays_zip("rings", "bounds"), at + 1, step)
        visits = todo.select("id", "v", "reach", F.explode(upto).alias("x"))
        if best is not None:
            # distance^2 = M^2 + |q|^2 - 2 score: beyond the k-th best nothing can enter
            kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_kth"))
            visits = visits.join(kth, F.col("id") == F.col("_q"), "left")
            limit = F.sqrt(F.greatest(F.lit(0.0), F.col("reach") - 2 * F.col("_kth"))) + _SLACK
            visits = visits.filter(F.col("_kth").isNull() | (F.col("x.bounds") <= limit))
        visits = scratch.settle(visits.select("id", "v", F.col("x.rings").alias("ring")))
        at, step = at + step, step * GROWTH
        if visits.isEmpty():
            if best is not None:
                break
            continue
        blocks = 1 + visits.groupBy("ring").count().agg(F.max("count")).first()[0] // QUERY_BLOCK
        asked_of = visits.groupBy("ring", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
        met = chunks.join(asked_of, "ring").select("rows", "asked").mapInArrow(_meet(dim, k), "query_id long, vec_id long, score long")
        new = met if best is None else met.unionAll(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = scratch.settle(new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        best = ranked
    if best is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _meet(dim: int, k: int):
    def run(batches):
        for batch in batches:
            for rows, asked in zip(batch.column("rows"), batch.column("asked"), strict=True):
                ids, v = (rows.values.field(f) for f in ("id", "v"))
                ids = ids.to_numpy()
                order = np.argsort(ids)
                ids, v = ids[order], _matrix(v, dim)[order]
                q_ids = asked.values.field("id").to_numpy()
                scores = _matrix(asked.values.field("v"), dim) @ v.T
                scores[q_ids[:, None] == ids] = -np.inf
                n = min(k, len(ids))
                # the n best with ties to the smaller id: all above the n-th score, then the first ones equal to it
                nth = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
                row, col = np.nonzero((scores >= nth[:, None]) & (scores > -np.inf))
                order = np.lexsort((col, -scores[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < n], col[place < n]
                cols = [pa.array(q_ids[row]), pa.array(ids[col]), pa.array(scores[row, col].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run
