"""Polygon columns and the arithmetic on them.

A polygon layer carries ``geometry: struct<type, parts>`` where ``parts`` is MultiPolygon -> polygon -> ring -> vertex
and ring 0 of a polygon is its shell. Point layers carry two double columns instead, so that range filters reach the
Parquet statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .projection import project_vertices, unproject_vertices

BOUNDS = ("xmin", "ymin", "xmax", "ymax")
VERTEX_DDL = "struct<x:double,y:double>"
PARTS_DDL = f"array<array<array<{VERTEX_DDL}>>>"
GEOMETRY_DDL = f"struct<type:string,parts:{PARTS_DDL}>"
_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX)))),
    ]
)


def let(value: Column, fn) -> Column:
    """Bind a computed value to a lambda variable so that it is evaluated once."""
    return F.transform(F.array(value), fn)[0]


def polygon(ring: Column) -> Column:
    """Geometry with a single shell from an array of vertices."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("parts"))


def geometry_type(geom: Column) -> Column:
    return geom["type"]


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def bbox(geom: Column) -> dict[str, Column]:
    """Row bounds as four plain columns."""
    v = vertices(geom)
    return {
        "xmin": F.array_min(v["x"]),
        "ymin": F.array_min(v["y"]),
        "xmax": F.array_max(v["x"]),
        "ymax": F.array_max(v["y"]),
    }


def has_bounds(df: DataFrame) -> bool:
    """Does the layer bring the bounds of its rows along, as a column ``bbox`` of four numbers?"""
    return "bbox" in df.columns and getattr(df.schema["bbox"].dataType, "names", None) == list(BOUNDS)


def _map_rings(geom: Column, fn) -> Column:
    parts = F.transform(geom["parts"], lambda poly: F.transform(poly, fn))
    return F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), parts.alias("parts")))


def to_metric(geom: Column) -> Column:
    return _map_rings(geom, project_vertices)


def to_degrees(geom: Column) -> Column:
    return _map_rings(geom, unproject_vertices)


def _closed(ring: Column) -> Column:
    """Ring with its first vertex repeated at the end."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
        F.concat(ring, F.slice(ring, 1, 1))
    )


def _segments(ring: Column) -> Column:
    return F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def ring_edges(ring: Column) -> Column:
    """Segments of a ring, closed, without those of no length."""
    segments = let(_closed(ring), _segments)
    return F.filter(segments, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def edges(geom: Column) -> Column:
    """All boundary segments with non-zero length, whatever ring they belong to."""
    rings = F.flatten(geom["parts"])
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), ring_edges))


def _moments(ring: Column, ox: Column, oy: Column) -> Column:
    """Twice the signed area and the two first moments of a ring about (ox, oy)."""

    def step(acc, e):
        ax, ay, bx, by = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(ring_edges(ring), zero, step)


def _polygon_moments(geom: Column) -> Column:
    """Moments of the whole geometry: shells add, holes subtract, whatever their winding."""
    origin = vertices(geom)[0]

    def signed(ring, i):
        role = F.when(i == 0, 1.0).otherwise(-1.0)
        return let(
            _moments(ring, origin["x"], origin["y"]),
            lambda q: F.struct(*[(q[f] * F.signum(q["a"]) * role).alias(f) for f in ("a", "mx", "my")]),
        )

    rings = F.flatten(F.transform(geom["parts"], lambda poly: F.transform(poly, signed)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        rings, zero, lambda acc, q: F.struct(*[(acc[f] + q[f]).alias(f) for f in ("a", "mx", "my")])
    )


def planar_area(geom: Column) -> Column:
    """Area in squared coordinate units."""
    return _polygon_moments(geom)["a"] / 2.0


def area(geom: Column) -> Column:
    """Square metres of a geometry stored in degrees."""
    return let(to_metric(geom), planar_area)


def planar_centroid(geom: Column) -> Column:
    """Area-weighted centroid as ``struct<x,y>`` in the units of the input; a point is its own."""
    origin = vertices(geom)[0]
    weighted = let(
        _polygon_moments(geom),
        lambda m: F.struct(
            (origin["x"] + m["mx"] / (m["a"] * 3.0)).alias("x"),
            (origin["y"] + m["my"] / (m["a"] * 3.0)).alias("y"),
        ),
    )
    return F.when(geom["type"] == "Point", F.struct(origin["x"].alias("x"), origin["y"].alias("y"))).otherwise(weighted)


def metric_centroid(geom: Column) -> Column:
    """Centroid in metres of a geometry stored in degrees."""
    return let(to_metric(geom), planar_centroid)


def centroid(geom: Column) -> Column:
    """Centroid computed in metres, handed back in degrees as ``struct<x,y>``."""
    return unproject_vertices(F.array(metric_centroid(geom)))[0]


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _within_box(e: Column, x: Column, y: Column) -> Column:
    return (
        (x >= F.least(e["x1"], e["x2"]))
        & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"]))
        & (y <= F.greatest(e["y1"], e["y2"]))
    )


def on_edge(e: Column, x: Column, y: Column) -> Column:
    return _within_box(e, x, y) & (_side(e["x1"], e["y1"], e["x2"], e["y2"], x, y) == 0)


def crosses_ray(e: Column, x: Column, y: Column) -> Column:
    """Does a ray from (x, y) towards greater x cross the edge? Half open in y, so a vertex counts once."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (
        x < e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    )


def point_on_edges(edge_list: Column, x: Column, y: Column) -> Column:
    return F.exists(edge_list, lambda e: on_edge(e, x, y))


def point_in_edges(edge_list: Column, x: Column, y: Column) -> Column:
    """Strictly inside by the even-odd rule; holes and parts need no special case, boundary points are outside."""
    odd = F.size(F.filter(edge_list, lambda e: crosses_ray(e, x, y))) % 2 == 1
    return odd & ~point_on_edges(edge_list, x, y)


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    return point_in_edges(edges(geom), x, y)


def segment_distance2(x, y, x1, y1, x2, y2) -> Column:
    """Squared distance from a point to a segment; a degenerate segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((x - x1) * dx + (y - y1) * dy) / length2).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return ex * ex + ey * ey


def _straddle(a: Column, b: Column) -> tuple[Column, Column]:
    """For each segment the product of the sides on which the ends of the other lie."""
    da = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]) * _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    db = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]) * _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    return da, db


def meet(a: Column, b: Column) -> Column:
    """Do two segments share a point? Their boxes overlap and neither lies on one side of the other."""
    da, db = _straddle(a, b)
    return _overlap(a, b, "x") & _overlap(a, b, "y") & (da <= 0) & (db <= 0)


def _overlap(a: Column, b: Column, axis: str) -> Column:
    p, q = f"{axis}1", f"{axis}2"
    return (F.least(a[p], a[q]) <= F.greatest(b[p], b[q])) & (F.least(b[p], b[q]) <= F.greatest(a[p], a[q]))


def cross(a: Column, b: Column) -> Column:
    """Do two segments cross in their interiors?"""
    da, db = _straddle(a, b)
    return (da < 0) & (db < 0)


def doubles_back(a: Column, b: Column) -> Column:
    ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    return (ax * by - ay * bx == 0) & (ax * bx + ay * by < 0)


def edges_meet(first: Column, second: Column) -> Column:
    """Does any segment of one list touch any of the other?"""
    return F.exists(first, lambda a: F.exists(second, lambda b: meet(a, b)))


def _ring_is_simple(segs: Column) -> Column:
    """No two edges of the ring meet, except neighbours in their shared vertex."""

    def bad(a, i):
        later = F.slice(segs, i + 2, F.size(segs))

        def clash(b, k):
            j = i + 1 + k
            neighbour = (k == 0) | ((i == 0) & (j == F.size(segs) - 1))
            return F.when(neighbour, doubles_back(a, b)).otherwise(meet(a, b))

        return F.exists(F.transform(later, clash), lambda t: t)

    return ~F.exists(F.transform(segs, bad), lambda t: t)


def _vertex_inside(ring: Column, edge_list: Column) -> Column:
    return F.exists(ring, lambda v: point_in_edges(edge_list, v["x"], v["y"]))


def _well_nested(parts: Column) -> Column:
    """For rings that do not cross: one vertex strictly inside tells on which side of another ring a ring lies."""

    def holes_fit(p):
        holes = F.slice(p, 2, F.size(p))
        in_shell = let(ring_edges(p[0]), lambda shell: F.forall(holes, lambda h: _vertex_inside(h, shell)))
        in_hole = F.exists(
            F.transform(holes, lambda a, i: F.exists(F.transform(holes, lambda b, j: (i != j) & _vertex_inside(a, ring_edges(b))), lambda t: t)),
            lambda t: t,
        )
        return in_shell & ~in_hole

    def apart(lists):
        met = lambda p, i: F.exists(F.transform(lists, lambda e, j: (i != j) & _vertex_inside(p[0], e)), lambda t: t)
        return ~F.exists(F.transform(parts, met), lambda t: t)

    every_edge = F.transform(parts, lambda p: F.flatten(F.transform(p, ring_edges)))
    return F.forall(parts, holes_fit) & F.when(F.size(parts) == 1, True).otherwise(let(every_edge, apart))


def _finite(rings: Column) -> Column:
    number = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))  # NaN counts as larger than infinity
    return F.forall(F.flatten(rings), lambda p: number(p["x"]) & number(p["y"]))


def _solid(rings: Column) -> Column:
    def three(r):
        # a third vertex beside the first and one that differs from it; comparing all of them would be quadratic
        others = F.filter(r, lambda v: v != r[0])
        return let(others, lambda o: F.exists(o, lambda v: v != F.get(o, F.lit(0))))

    return F.forall(rings, lambda r: three(r) & (_moments(r, r[0]["x"], r[0]["y"])["a"] != 0.0))


def is_solid(geom: Column) -> Column:
    """The part of ``is_valid`` that is linear in the vertices: finite, every ring around a non-zero area."""
    rings = F.flatten(geom["parts"])
    told = F.when(F.size(F.flatten(rings)) > 0, F.when(_finite(rings), _solid(rings)))
    return F.coalesce(F.when(geom.isNotNull(), told), F.lit(False))


def is_valid(geom: Column) -> Column:
    """Points: finite. Others: finite, every ring closed around a non-zero area without meeting itself, no two rings
    crossing, every hole inside its shell and outside the other holes, no part inside another.

    Comparison of edge pairs is quadratic in the vertices of one geometry; ``operators.validity`` judges long ones by joins.
    """

    def apart(lists):
        later = lambda one, i: F.exists(
            F.slice(lists, i + 2, F.size(lists)), lambda two: F.exists(one, lambda a: F.exists(two, lambda b: cross(a, b)))
        )
        return ~F.exists(F.transform(lists, later), lambda t: t)

    def sound(rings):
        simple = let(F.transform(rings, ring_edges), lambda lists: F.forall(lists, _ring_is_simple) & apart(lists))
        nested = F.when(F.size(rings) == 1, True).otherwise(_well_nested(geom["parts"]))
        return F.when(F.size(F.flatten(rings)) > 0, F.when(_finite(rings), F.when(_solid(rings), F.when(simple, nested))))

    def point(rings):
        return (F.size(F.flatten(rings)) == 1) & _finite(rings)

    rings = F.flatten(geom["parts"])
    checked = F.when(geom["type"] == "Point", let(rings, point)).otherwise(let(rings, sound))
    return F.coalesce(F.when(geom.isNotNull(), checked), F.lit(False))
