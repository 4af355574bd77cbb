import numpy as np
from pyspark.sql import functions as F

from test_geometry import geom
from test_polygons import shapes, star
from zonewise.functions.crs import with_crs
from zonewise.operators import overlay, polygons
from zonewise.operators.polygons import spatial_join


def pairs(left, right, predicate):
    return sorted(map(tuple, spatial_join(left, right, "inner", predicate).select("id", "id_right").collect()))


def test_edge_by_edge_equals_whole_shapes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    stars = [geom([star(rng, *rng.uniform(0, 4, 2), r, 12)]) for r in rng.choice([0.2, 0.8, 2.5], 14)]
    # shared sides, shared corners, holes filled and crossed, a copy, a part beside another, one inside the other's hole
    built = [
        geom([square(0, 0, 4)]), geom([square(0, 0, 4), square(1, 1, 1)]), geom([square(1, 1, 1)]), geom([square(1.25, 1.25, 0.5)]), geom([square(4, 4, 1)]), geom([square(0, 0, 2)]),
        geom([square(1.5, 1.5, 1)]), geom([square(0.5, 0.5, 2)]), geom([square(0.1, 0.1, 0.3)], [square(3, 3, 0.5)]), geom([square(0.1, 0.1, 0.3)], [square(6, 6, 0.5)]), geom([[(0, 0), (0.7, 1.3), (0, 4)]]),
    ]
    left, right = shapes(spark, built + stars[:7]), shapes(spark, stars[7:] + built)
    want = {p: pairs(left, right, p) for p in ("intersects", "within", "contains")}
    monkeypatch.setattr(polygons, "LONG", 4)
    monkeypatch.setattr(overlay, "CROWDED", 16)
    for p, w in want.items():
        assert pairs(left, right, p) == w and w


def test_rings_of_many_vertices(spark):
    """Circles of 20,000 vertices: crossing, inside one another, in a hole, and one and the same."""
    circle = "transform(sequence(0, 19999), i -> named_struct('x', {x} + {r} * cos(i * pi() / 10000), 'y', {y} + {r} * sin(i * pi() / 10000)))"
    made = lambda *rings: "named_struct('type', 'Polygon', 'parts', array(array(" + ", ".join(circle.format(x=x, y=y, r=r) for x, y, r in rings) + ")))"
    layer = lambda *shapes: with_crs(spark.sql(" union all ".join(f"select {i}L as id, {s} as geometry" for i, s in enumerate(shapes))), "EPSG:4326")
    left = layer(made((34, 32, 1)), made((34, 32, 0.4)), made((34, 32, 0.1)))
    right = layer(made((35, 32, 1)), made((34, 32, 0.8), (34, 32, 0.6)), made((34, 32, 1.0)))
    assert pairs(left, right, "intersects") == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 2)]
    assert pairs(left, right, "within") == [(0, 2), (1, 2), (2, 2)]
    assert pairs(left, right, "contains") == [(0, 1), (0, 2)]


def test_cells_are_as_wide_as_edges(spark, tmp_path):
    """Edges of equal length run through a few cells each, however many there are, and only of those the other layer reaches."""
    edge = lambda *v: "struct(" + ", ".join(f"{e} as {c}" for e, c in zip(v, ("x1", "y1", "x2", "y2"), strict=True)) + ")"
    made = f"explode(array({edge('x', 'y', 'x + 0.1', 'y')}, {edge('x + 0.1', 'y', 'x + 0.1', 'y + 0.1')}, {edge('x', 'y', 'x', 'y + 0.1')})) as e"
    placed = spark.range(5000).selectExpr("id", "(id * 7919) % 10007 / 10007D as x", "(id * 104729) % 9973 / 9973D as y").selectExpr("id", made)
    many = placed.select(F.col("id").alias("_lk"), "e.*")
    few = spark.sql("select 0L as _rk, 0.5D as x1, 0.0D as y1, 0.5D as x2, 1.1D as y2")
    placed_rows = []

    class Counting(overlay.Scratch):
        def settle(self, df, by=None):
            settled = super().settle(df, by)
            placed_rows.append(settled.count())
            return settled

    with Counting(spark) as scratch:
        near = overlay.shared_cells(many, few, scratch).select("_lk", "a_x1", "a_x2").distinct().collect()
    crossing = many.filter("least(x1, x2) <= 0.5 and greatest(x1, x2) >= 0.5").select("_lk", "x1", "x2").distinct().collect()
    assert set(map(tuple, crossing)) <= set(map(tuple, near))
    assert max(placed_rows) < 3 * 5000
