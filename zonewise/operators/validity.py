"""Validity of geometries with very many vertices, by joins instead of comparing all edge pairs of a row.

``geometry.is_valid`` looks at one geometry in one expression, which is quadratic in its vertices. Here the edges of long
geometries become rows. Every edge goes to the cells of a grid that it runs through, cells that stay crowded are divided
further, and only edges that share a cell are compared. Whether rings nest is told by rays: vertices meet the edges of their
own horizontal strip. Verdicts are aggregated per geometry and equal those of ``is_valid``.

What is linear in the vertices (finite numbers, rings around an area) stays an expression on the row; short geometries are
judged by ``is_valid`` as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .workset import Scratch

# Geometries of more vertices than this take the way of joins.
LONG = 500
# Edges of a cell beyond which it is divided, by so many per side; a grid is never finer than this part of a shape's extent.
CROWDED, _FAN, _FINEST = 64, 4, 1e-12
# Vertices per strip of rays, on average.
_PER_STRIP = 8

_E = ("x1", "y1", "x2", "y2")


def _edge(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in _E}


def _edges(shapes: DataFrame) -> DataFrame:
    """_g, part, ring, at, n (edges of the ring), x1, y1, x2, y2."""
    rings = shapes.select("_g", F.posexplode("geometry.parts").alias("part", "_p")).select("_g", "part", F.posexplode("_p").alias("ring", "_r"))
    listed = rings.select("_g", "part", "ring", G.ring_edges(F.col("_r")).alias("_e"))
    return listed.select("_g", "part", "ring", F.size("_e").alias("n"), F.posexplode("_e").alias("at", "e")).select(
        "_g", "part", "ring", "at", "n", *[F.col(f"e.{c}").alias(c) for c in _E]
    )


def in_cells(edges: DataFrame) -> DataFrame:
    """A row per edge and cell (cx, cy) of its grid (x0, y0, size) that it runs through, of the cells gx0..gx1 and gy0..gy1."""
    low, high = (lambda a: F.least(f"{a}1", f"{a}2")), (lambda a: F.greatest(f"{a}1", f"{a}2"))
    slot = lambda v, origin: F.floor((v - F.col(origin)) / F.col("size"))
    columns = F.sequence(F.greatest(slot(low("x"), "x0"), F.col("gx0")), F.least(slot(high("x"), "x0"), F.col("gx1")))
    wide = edges.filter((slot(low("x"), "x0") <= F.col("gx1")) & (slot(high("x"), "x0") >= F.col("gx0"))).withColumn("cx", F.explode(columns))
    # where the edge runs within its column; a hair of slack against rounding
    left, right = F.col("x0") + F.col("cx") * F.col("size"), F.col("x0") + (F.col("cx") + 1) * F.col("size")
    steep = (F.col("y2") - F.col("y1")) / F.when(F.col("x1") != F.col("x2"), F.col("x2") - F.col("x1"))
    at = lambda x: F.coalesce(F.col("y1") + (F.greatest(low("x"), F.least(high("x"), x)) - F.col("x1")) * steep, F.col("y1"))
    upright = F.col("x1") == F.col("x2")
    slack = F.col("size") * 1e-6 + (F.abs("y1") + F.abs("y2")) * 1e-14
    y_low = F.when(upright, low("y")).otherwise(F.greatest(low("y"), F.least(at(left), at(right)) - slack))
    y_high = F.when(upright, high("y")).otherwise(F.least(high("y"), F.greatest(at(left), at(right)) + slack))
    first, last = F.greatest(slot(y_low, "y0"), F.col("gy0")), F.least(slot(y_high, "y0"), F.col("gy1"))
    return wide.withColumns({"_first": first, "_last": last}).filter("_first <= _last").withColumn("cy", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _clashes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """_g of geometries in which two edges meet that must not."""
    box = edges.groupBy("_g").agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("x1", "x2")).alias("_x"), F.max(F.greatest("y1", "y2")).alias("_y"), F.count(F.lit(1)).alias("_n"),
    )
    side = F.greatest(F.col("_x") - F.col("x0"), F.col("_y") - F.col("y0"))
    per_side = F.ceil(F.sqrt("_n"))
    box = box.select("_g", "x0", "y0", (side / per_side).alias("size"), (side * _FINEST).alias("least"), F.lit(0).cast("long").alias("gx0"), F.lit(0).cast("long").alias("gy0"), per_side.alias("gx1"), per_side.alias("gy1"))
    open_edges, found = edges.join(box, "_g"), []
    cell = ["_g", "cx", "cy"]
    while True:
        placed = scratch.settle(in_cells(open_edges))
        crowd = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_in"))
        crowd = scratch.settle(crowd.filter((F.col("_in") > CROWDED)).select(*cell))
        last = placed.agg(F.coalesce(F.max(F.col("size") / F.greatest("least", F.lit(1e-300))), F.lit(0))).first()[0] <= _FAN
        if last or crowd.isEmpty():
            found.append(_met(placed))
            break
        found.append(_met(placed.join(crowd, cell, "left_anti")))
        deeper = placed.join(crowd, cell, "left_semi")
        finer = {
            "gx0": F.col("cx") * _FAN, "gx1": F.col("cx") * _FAN + _FAN - 1, "gy0": F.col("cy") * _FAN, "gy1": F.col("cy") * _FAN + _FAN - 1,
            "size": F.col("size") / _FAN,
        }
        open_edges = deeper.withColumns(finer).drop("cx", "cy")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _met(placed: DataFrame) -> DataFrame:
    """Edges of one cell, each with those after it."""
    key = ["_g", "cx", "cy"]
    a = placed.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("part", "ring", "at", "n", *_E)])
    b = placed.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("part", "ring", "at", *_E)])
    one, two = _edge("a_"), _edge("b_")
    same = (F.col("a_part") == F.col("b_part")) & (F.col("a_ring") == F.col("b_ring"))
    later = F.struct("a_part", "a_ring", "a_at") < F.struct("b_part", "b_ring", "b_at")
    neighbour = (F.col("b_at") == F.col("a_at") + 1) | ((F.col("a_at") == 0) & (F.col("b_at") == F.col("a_n") - 1))
    bad = F.when(same, F.when(neighbour, G.doubles_back(one, two)).otherwise(G.meet(one, two))).otherwise(G.cross(one, two))
    return a.join(b, key).filter(later & bad).select("_g")


def _misplaced(edges: DataFrame) -> DataFrame:
    """_g of geometries with a hole outside its shell or inside another hole, or a part inside another."""
    tall = edges.groupBy("_g").agg(F.min("y1").alias("_low"), F.max("y1").alias("_top"), F.ceil(F.count(F.lit(1)) / _PER_STRIP).alias("_strips"))
    many = edges.filter("part > 0 OR ring > 0").select("_g").distinct()
    edges = edges.join(many, "_g", "left_semi").join(tall, "_g")
    strip = lambda y: F.floor((y - F.col("_low")) / F.greatest(F.col("_top") - F.col("_low"), F.lit(1e-300)) * F.col("_strips"))
    vertices = edges.select("_g", F.col("part").alias("vp"), F.col("ring").alias("vr"), F.col("at").alias("v"), F.col("x1").alias("x"), F.col("y1").alias("y"), strip(F.col("y1")).alias("strip"))
    spans = F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))
    spread = edges.select("_g", "part", "ring", *_E, F.explode(spans).alias("strip"))
    inner = (F.col("vp") == F.col("part")) & (F.col("vr") > 0) & (F.col("vr") != F.col("ring"))
    outer = (F.col("vp") != F.col("part")) & (F.col("vr") == 0)
    edge, x, y = _edge(""), F.col("x"), F.col("y")
    # a part as a whole holds the shells of others, a single ring the holes beside it
    holder = F.when(F.col("vp") == F.col("part"), F.col("ring")).otherwise(-1)
    met = vertices.join(spread, ["_g", "strip"]).filter(inner | outer)
    met = met.select("_g", "vp", "vr", "v", "part", holder.alias("holder"), G.crosses_ray(edge, x, y).alias("c"), G.on_edge(edge, x, y).alias("o")).filter("c OR o")
    within = met.groupBy("_g", "vp", "vr", "v", "part", "holder").agg(((F.count_if("c") % 2 == 1) & ~F.max("o")).alias("i")).filter("i")
    within = within.select("_g", "vp", "vr", "part", "holder").distinct()
    holes = edges.filter("ring > 0").select("_g", F.col("part").alias("vp"), F.col("ring").alias("vr")).distinct()
    lost = holes.join(within.filter("holder = 0"), ["_g", "vp", "vr"], "left_anti").select("_g")
    return lost.unionByName(within.filter("holder <> 0").select("_g")).distinct()


def judged(df: DataFrame, scratch: Scratch, column: str = "_valid", long: int = LONG) -> DataFrame:
    """``df`` with the verdict of ``is_valid`` on its ``geometry``; the result reads tables of ``scratch``."""
    shape = F.col("geometry")
    vertices = F.coalesce(F.size(G.vertices(shape)), F.lit(0))
    rows = scratch.settle(df.withColumns({"_g": F.monotonically_increasing_id(), "_long": (vertices > long) & (shape["type"] != "Point")}))
    short = rows.filter("not _long").withColumn(column, G.is_valid(shape)).drop("_g", "_long")
    lengthy = rows.filter("_long")
    edges = scratch.settle(_edges(lengthy.filter(G.is_solid(shape)).select("_g", "geometry").repartition("_g")))
    bad = scratch.settle(_clashes(edges, scratch).unionByName(_misplaced(edges)).distinct().withColumn("_bad", F.lit(True)))
    told = lengthy.join(bad, "_g", "left").withColumn(column, G.is_solid(shape) & F.col("_bad").isNull())
    return short.unionByName(told.drop("_g", "_long", "_bad"))
