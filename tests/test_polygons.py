import numpy as np
import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from test_proximity import layer
from zonewise.functions.crs import with_crs
from zonewise.operators import polygons, workset
from zonewise.operators.polygons import points_in_polygons, spatial_join


def shapes(spark, expressions, names=None):
    names = names or [f"z{i}" for i in range(len(expressions))]
    sql = " union all ".join(f"select {i}L as id, '{n}' as name, {e} as geometry" for i, (n, e) in enumerate(zip(names, expressions)))
    return with_crs(spark.sql(sql), "EPSG:4326")


def star(rng, cx, cy, r, n=9):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    d = rng.uniform(0.3, 1, n) * r
    return list(zip(cx + d * np.cos(a), cy + d * np.sin(a)))


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "crowded"])
def test_points_in_polygons_equals_brute_force(spark, way, monkeypatch):
    if way == "shuffled":
        monkeypatch.setattr(workset, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(workset.salted_join, "__defaults__", (None, None, 20, None))
    if way == "crowded":
        monkeypatch.setattr(polygons, "CELL_POLYGONS", 4)
    rng = np.random.default_rng(5)
    rings = [star(rng, rng.uniform(34.7, 34.9), rng.uniform(31.9, 32.1), rng.choice([0.002, 0.02, 0.1])) for _ in range(30)]
    # a third of the polygons and of the points sit in one small place
    rings += [star(rng, 34.8, 32.0, 0.004) for _ in range(15)]
    places = np.vstack([rng.uniform((34.65, 31.85), (34.95, 32.15), (200, 2)), np.array([34.8, 32.0]) + rng.normal(0, 0.002, (100, 2))])
    points = layer(spark, places)
    got = points_in_polygons(points, shapes(spark, [geom([r]) for r in rings]), key="id")
    got = sorted((r.id, r.neighborhood_polygon or "") for r in got.collect())
    want = []
    for i, (x, y) in enumerate(places):
        hits = [(i, f"z{k}") for k, r in enumerate(rings) if inside(r, x, y)]
        want += hits or [(i, "")]
    assert got == sorted(want)


def test_boundary_overlap_hole_and_no_match(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    layers = shapes(spark, [geom([square, [(1, 1), (2, 1), (2, 2), (1, 2)]]), geom([[(3, 3), (6, 3), (6, 6), (3, 6)]])], ["a", "b"])
    points = layer(spark, [(0, 2), (3.5, 3.5), (1.5, 1.5), (9, 9), (0.5, 0.5)])
    got = sorted((r.id, r.neighborhood_polygon) for r in points_in_polygons(points, layers, key="id").collect() if r.id != 2 or True)
    assert got == [(0, None), (1, "a"), (1, "b"), (2, None), (3, None), (4, "a")]
    closed = spatial_join(points, layers, "inner", "intersects").select("id", "id_right").collect()
    assert sorted(map(tuple, closed)) == [(0, 0), (1, 0), (1, 1), (4, 0)]
    right = spatial_join(points, layers, "right", "within").select("id", "name").collect()
    assert sorted((r.name, r.id) for r in right) == [("a", 1), ("a", 4), ("b", 1)]
    assert spatial_join(points, layers, "inner", "contains").count() == 0
    assert spatial_join(layers, points, "left", "contains").count() == 3


@pytest.mark.parametrize("size,divided", [(0.5, True), (0.0005, False)])
def test_crowded_cells_are_divided_only_if_it_pays(spark, monkeypatch, size, divided):
    monkeypatch.setattr(polygons, "CELL_POLYGONS", 4)
    rng = np.random.default_rng(6)
    tiny = [star(rng, *rng.uniform((34.7, 31.9), (34.9, 32.1)), 0.002) for _ in range(40)]
    stacked = [[(34.8, 32.0), (34.81, 32.0), (34.81, 32.01), (34.8, 32.01)]] * 20
    grid = polygons.PolygonCells(shapes(spark, [geom([r]) for r in (tiny if divided else stacked)]), ["name"], size=size)
    assert bool(grid.crowded) == divided


def test_interior_cells_need_no_edges(spark):
    grid = polygons.PolygonCells(shapes(spark, [geom([[(0, 0), (8, 0), (8, 8), (0, 8)]])]), ["name"], size=1.0)
    rows = grid.cells.select("cx", "cy", "_inside", F.size("_edges").alias("n")).collect()
    assert {(r.cx, r.cy) for r in rows if r._inside} == {(x, y) for x in range(1, 8) for y in range(1, 8)}
    assert all(r.n == 0 for r in rows if r._inside)


@pytest.mark.parametrize(
    "a,b,intersects,within",
    [
        ([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (4, 0), (4, 4), (0, 4)], True, True),
        ([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)], True, True),
        ([(3, 3), (5, 3), (5, 5), (3, 5)], [(0, 0), (4, 0), (4, 4), (0, 4)], True, False),
        ([(4, 0), (5, 0), (5, 1), (4, 1)], [(0, 0), (4, 0), (4, 4), (0, 4)], True, False),
        ([(6, 6), (7, 6), (7, 7)], [(0, 0), (4, 0), (4, 4), (0, 4)], False, False),
        ([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2)], True, False),
        ([(1, 1), (3, 1), (3, 3), (1, 3)], [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], True, False),
    ],
)
def test_polygon_predicates(spark, a, b, intersects, within):
    left, right = shapes(spark, [geom([a])]), shapes(spark, [geom([b])])
    assert spatial_join(left, right, "inner", "intersects").count() == intersects
    assert spatial_join(left, right, "inner", "within").count() == within
    assert spatial_join(right, left, "inner", "contains").count() == within


def test_polygon_filling_a_hole_is_not_within(spark):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    ring = shapes(spark, [geom([[(0, 0), (4, 0), (4, 4), (0, 4)], hole])])
    assert spatial_join(shapes(spark, [geom([hole])]), ring, "inner", "within").count() == 0


def test_salted_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(workset, "BROADCAST_ROWS", 0)
    left = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    out = workset.salted_join(left, right, ["k"], "left", F.col("id"), hot_rows=30)
    assert out.count() == 1000 and out.filter("v != k * 10").count() == 0
    assert out.columns == ["id", "k", "v"]


def test_one_huge_polygon_beside_small_ones(spark):
    """The cells of the huge one are cut by several tasks, and rows that match nothing are spread in the join back."""
    rng = np.random.default_rng(8)
    small = [star(rng, *rng.uniform((34.7, 31.9), (34.9, 32.1)), 0.002) for _ in range(30)]
    huge = [(34.6, 31.8), (35.0, 31.8), (35.0, 32.2), (34.6, 32.2)]
    layers = shapes(spark, [geom([r]) for r in [*small, huge]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little data is put together again
    try:
        grid = polygons.PolygonCells(layers, ["name"], size=0.002)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_file = [r["count"] for r in grid.cells.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 1 and max(per_file) < 0.6 * sum(per_file)
    points = layer(spark, [(34.8, 32.0), (36.0, 33.0), (36.1, 33.0)])
    got = spatial_join(points, layers, "left", "within").groupBy("id").count().orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2]


def test_work_of_crowded_cells_is_dealt_by_tests(spark, monkeypatch):
    """A task of the join gets so many tests at most on average, whatever the size of what it reads."""
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(polygons, "TASK_TESTS", 500)
    monkeypatch.setattr(polygons, "HOT_TESTS", 200)
    stack = shapes(spark, [geom([[(34 + i / 1000, 32), (35, 32), (35, 33), (34, 33)]]) for i in range(40)])
    points = with_crs(spark.range(300).selectExpr("id", "34.2D + id / 1000 as lon", "32.5D as lat").union(spark.sql("select 300L, 10D, 10D")), "EPSG:4326")
    joined = points_in_polygons(points, stack, key="id")
    assert joined.rdd.getNumPartitions() >= 300 * 40 / 500
    assert joined.filter("neighborhood_polygon is null").count() == 1 and joined.count() == 300 * 40 + 1
