"""Polygon against polygon where shapes have very many vertices: edges meet edges in shared cells, no two shapes meet in a row.

The edges of both layers go to the cells of one grid. Cells that hold edges of one layer only are dropped, crowded cells are
divided as long as most of their edges are shorter than the cells of the next level, and edges are compared within a cell. What no
crossing tells, whether one shape lies inside the other, a point per part tells, by the join of points with polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .polygons import interior_point, match_points
from .validity import in_cells
from .workset import BROADCAST_ROWS, Scratch, salted_join

# Pairs of edges of a cell beyond which it is divided, by so many per side, and the number of levels at most.
CROWDED, _FAN, _LEVELS = 64 * 64, 4, 20
# Edges of a cell beyond which the cell is worked on by several tasks.
_HOT_CELL = 10_000

_E = ("x1", "y1", "x2", "y2")


def _edge(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in _E}


def _parts(shapes: DataFrame, key: str) -> DataFrame:
    """key, part, geometry: every part as a shape of its own."""
    one = shapes.select(key, F.posexplode("geometry.parts").alias("part", "_p"))
    return one.select(key, "part", F.struct(F.lit("Polygon").alias("type"), F.array("_p").alias("parts")).alias("geometry"))


def _edges(parts: DataFrame, key: str) -> DataFrame:
    """key, part, at, x1, y1, x2, y2."""
    listed = parts.select(key, "part", F.posexplode(G.edges(F.col("geometry"))).alias("at", "_e"))
    return listed.select(key, "part", "at", *[F.col(f"_e.{c}").alias(c) for c in _E])


def _extent(edges: DataFrame):
    low, high = (lambda c: F.min(F.least(f"{c}1", f"{c}2"))), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")))
    reach = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return edges.agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x"), high("y").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(reach).alias("reach")).first()


def shared_cells(a: DataFrame, b: DataFrame, scratch: Scratch, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of edges that run through a common cell, their ends as a_x1 .. and b_x1 ..; a pair may come more than once.

    Edges meet only where the columns ``same``, which both sides have, are equal. The other columns of ``a`` and ``b`` are
    carried along and have different names. Cells are no smaller than edges are long on average, so an edge runs through a
    few of them however many edges there are.
    """
    ends_a, ends_b = _extent(a), _extent(b)
    n = ends_a["n"] + ends_b["n"]
    known = [e for e in (ends_a, ends_b) if e["n"]]
    x0, y0 = (min((e[c] for e in known), default=0.0) for c in ("x0", "y0"))
    side = max((e[c] - o for e in known for c, o in (("x", x0), ("y", y0))), default=1.0) or 1.0
    size = max(side / math.ceil(math.sqrt(n)), sum(e["reach"] for e in known) / n) if n else side
    per_side = math.ceil(side / size)
    cells_of = {"gx0": F.lit(0), "gy0": F.lit(0), "gx1": F.lit(per_side), "gy1": F.lit(per_side)}
    grid = {"x0": F.lit(x0), "y0": F.lit(y0), "size": F.lit(size), **{k: v.cast("long") for k, v in cells_of.items()}}
    open_a, open_b, cell, found = a.withColumns(grid), b.withColumns(grid), ["cx", "cy", *same], []
    own_a, own_b = ([c for c in d.columns if c not in _E and c not in same] for d in (a, b))
    a_is_less = ends_a["n"] < ends_b["n"]

    def counted(placed: DataFrame, tag: str) -> DataFrame:
        short = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) < size / _FAN
        return placed.groupBy(*cell).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.count_if(short).alias(f"s_{tag}"))

    def ends_as(placed: DataFrame, own: list[str], prefix: str) -> DataFrame:
        return placed.select(*cell, *own, *[F.col(c).alias(prefix + c) for c in _E])

    def both_placed(few: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides in cells; the larger only in those that the smaller one reaches, if they fit a broadcast."""
        few, many = scratch.settle(in_cells(few)), in_cells(many)
        reached = scratch.settle(few.select(*cell).distinct())
        if reached.count() <= BROADCAST_ROWS:
            many = many.join(F.broadcast(reached), cell, "left_semi")
        return few, scratch.settle(many)

    for level in range(_LEVELS):
        if a_is_less:
            placed_a, placed_b = both_placed(open_a, open_b)
        else:
            placed_b, placed_a = both_placed(open_b, open_a)
        crowded = (F.col("n_a") * F.col("n_b") > CROWDED) & (2 * (F.col("s_a") + F.col("s_b")) > F.col("n_a") + F.col("n_b"))
        crowded = crowded & F.lit(level < _LEVELS - 1)
        both = scratch.settle(counted(placed_a, "a").join(counted(placed_b, "b"), cell).select(*cell, crowded.alias("_deep")))
        done, deep = both.filter("not _deep").select(*cell), both.filter("_deep").select(*cell)
        near = salted_join(
            ends_as(placed_a.join(done, cell, "left_semi"), own_a, "a_"), ends_as(placed_b, own_b, "b_"), cell, "inner",
            F.xxhash64(*[f"a_{c}" for c in _E]), hot_rows=_HOT_CELL,
        )
        found.append(near.drop("cx", "cy"))
        if deep.isEmpty():
            break
        size /= _FAN
        finer = {f"g{c}{k}": F.col(f"c{c}") * _FAN + k * (_FAN - 1) for c in "xy" for k in (0, 1)} | {"size": F.lit(size)}
        open_a, open_b = (p.join(deep, cell, "left_semi").withColumns(finer).drop("cx", "cy") for p in (placed_a, placed_b))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def intersecting(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """_lk, _rk of shapes (key, geometry) that share a point."""
    a, b = scratch.settle(_edges(_parts(left, "_lk"), "_lk")), scratch.settle(_edges(_parts(right, "_rk"), "_rk"))
    meet = G.meet(_edge("a_"), _edge("b_"))
    out = shared_cells(a.select("_lk", *_E), b.select("_rk", *_E), scratch).filter(meet).select("_lk", "_rk")
    # parts whose edges meet nothing of the other shape lie inside it, or it lies inside them, or they are apart
    for edges, key, shapes, other in ((a, "_lk", right, "_rk"), (b, "_rk", left, "_lk")):
        corner = edges.filter("at = 0").select(key, F.col("x1").alias("lon"), F.col("y1").alias("lat"))
        out = out.unionByName(match_points(corner, shapes, [other], "inner", True, key, None).select("_lk", "_rk"))
    return out.distinct()


def _pieces(near: DataFrame) -> DataFrame:
    """_ik, _ok, lon, lat: midpoints of the pieces into which edges of the outer shape are cut by edges of an inner one."""
    dx, dy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    ex, ey = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    den = dx * ey - dy * ex
    # parallel edges cut each other at their ends
    line = ((F.col("a_x1") - F.col("b_x1")) * ey - (F.col("a_y1") - F.col("b_y1")) * ex) / F.nullif(den, F.lit(0.0))
    along = [((F.col(f"a_x{i}") - F.col("b_x1")) * dx + (F.col(f"a_y{i}") - F.col("b_y1")) * dy) / (dx * dx + dy * dy) for i in (1, 2)]
    edge = ["_ik", "_ok", *[f"b_{c}" for c in _E]]
    at = F.when(den != 0, F.array(line)).otherwise(F.array(*along))
    cut = near.select(*edge, F.explode(at).alias("t")).filter("t > 0 and t < 1").distinct()
    listed = cut.groupBy(*edge).agg(F.array_sort(F.collect_list("t")).alias("_t"))
    stops = F.concat(F.array(F.lit(0.0)), F.col("_t"), F.array(F.lit(1.0)))
    middle = F.zip_with(F.slice(stops, F.lit(1), F.size("_t") + 1), F.slice(stops, F.lit(2), F.size("_t") + 1), lambda s, t: (s + t) / 2)
    mids = listed.select("_ik", "_ok", *[f"b_{c}" for c in _E], F.explode(middle).alias("m"))
    return mids.select("_ik", "_ok", (F.col("b_x1") + F.col("m") * dx).alias("lon"), (F.col("b_y1") + F.col("m") * dy).alias("lat"))


def _off_the_edges(hits: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Of points (_id, _ik, lon, lat) found inside a shape those that do not lie on its boundary but for rounding."""
    reach = F.lit(1e-9) * (1 + F.abs("lon") + F.abs("lat"))
    crosses = F.array(*[F.struct((F.col("lon") - reach).alias("x1"), (F.col("lat") - s * reach).alias("y1"), (F.col("lon") + reach).alias("x2"), (F.col("lat") + s * reach).alias("y2")) for s in (1, -1)])
    marks = hits.select("_id", "_ik", "lon", "lat", F.explode(crosses).alias("_c")).select("_id", "_ik", "lon", "lat", *[F.col(f"_c.{c}").alias(c) for c in _E])
    near = shared_cells(edges.select("_ik", *_E), marks, scratch, ("_ik",))
    x, y = F.col("lon"), F.col("lat")
    length2 = (F.col("a_x2") - F.col("a_x1")) ** 2 + (F.col("a_y2") - F.col("a_y1")) ** 2
    close = G.segment_distance2(x, y, *[F.col(f"a_{c}") for c in _E]) <= F.lit(1e-20) * (1 + length2 + x * x + y * y)
    return hits.join(near.filter(close).select("_id").distinct(), "_id", "left_anti")


def lying_within(inner: DataFrame, outer: DataFrame, scratch: Scratch) -> DataFrame:
    """_ik, _ok of shapes (key, geometry): no boundary of the outer one enters the inner one, and a point of every part is inside."""
    parts = scratch.settle(_parts(inner, "_ik"))
    a, b = scratch.settle(_edges(parts, "_ik")), scratch.settle(_edges(_parts(outer, "_ok"), "_ok"))
    points = parts.select("_ik", "part", interior_point(G.edges(F.col("geometry"))).alias("_p")).select("_ik", "part", F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat"))
    held = match_points(points.filter("lon is not null"), outer, ["_ok"], "inner", False, "_ik", None).groupBy("_ik", "_ok").agg(F.count_distinct("part").alias("_n"))
    whole = inner.select("_ik", F.size("geometry.parts").alias("_n"))
    likely = scratch.settle(held.join(whole, ["_ik", "_n"]).select("_ik", "_ok"))
    near = shared_cells(a.select("_ik", *_E), b.select("_ok", *_E), scratch).join(likely, ["_ik", "_ok"])
    uncut = b.select("_ok", ((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))
    hits = match_points(uncut, parts.select("_ik", "geometry"), ["_ik"], "inner", False, "_ok", None).select("_ik", "_ok", "lon", "lat")
    # a piece can only lie inside the shape whose edges cut it off
    pieces = scratch.settle(_pieces(near))
    cut = parts.join(pieces.select("_ik").distinct(), "_ik", "left_semi").select("_ik", "geometry")
    own = match_points(pieces, cut, ["_ik"], "inner", False, "_ok", None, same=("_ik",)).select("_ik", "_ok", "lon", "lat")
    hits = scratch.settle(hits.join(likely, ["_ik", "_ok"], "left_semi").unionByName(own).withColumn("_id", F.monotonically_increasing_id()))
    entered = _off_the_edges(hits, a, scratch).select("_ik", "_ok").distinct()
    return likely.join(entered, ["_ik", "_ok"], "left_anti")
