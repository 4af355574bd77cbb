import numpy as np
import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from test_polygons import inside, shapes, star
from zonewise.functions.crs import with_crs
from zonewise.operators import crowds, polygons, stats
from zonewise.operators.polygons import points_in_polygons


def pairs_of(found):
    order, (row, first, end), (alone, place) = found
    held = order[np.concatenate([crowds.ranges(first, end - first), place])]
    pairs = list(zip(np.concatenate([np.repeat(row, end - first), alone]).tolist(), held.tolist()))
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def strictly_inside(ring, x, y):
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
        if min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) and (bx - ax) * (y - ay) == (by - ay) * (x - ax):
            return False
    return inside([tuple(p) for p in ring], x, y)


@pytest.mark.parametrize("block", [5, 50_000])
@pytest.mark.parametrize("lattice", [True, False])
def test_strips_equal_one_test_per_pair(monkeypatch, block, lattice):
    """On a lattice points lie on edges and vertices, and many edges run along the axes; rings may cross themselves."""
    monkeypatch.setattr(crowds, "BLOCK", block)
    rng = np.random.default_rng(3)
    for n in (1, 7, 150):
        points, rings = rng.uniform(0, 1, (n, 2)), [rng.uniform(-0.5, 1.5, (rng.integers(3, 10), 2)) for _ in range(12)]
        rings.append(np.array([(0, 0), (0.5, 0), (0.5, 0.25), (0.25, 0.5), (0, 0.5)]))
        if lattice:
            points, rings = np.round(points * 8) / 8, [np.round(r * 8) / 8 for r in rings]
        edges = [np.hstack([r, np.roll(r, -1, 0)]) for r in rings]
        edges = [e[(e[:, :2] != e[:, 2:]).any(1)] for e in edges]
        offsets = np.append(0, np.cumsum([len(e) for e in edges]))
        box = [np.array([f(r[:, c]) for r in rings]) for f, c in ((np.min, 0), (np.min, 1), (np.max, 0), (np.max, 1))]
        columns = [np.vstack(edges)[:, c].copy() for c in range(4)]
        found = crowds.found(points[:, 0].copy(), points[:, 1].copy(), np.zeros(len(rings), bool), box, offsets, columns)
        assert pairs_of(found) == {(k, i) for k, r in enumerate(rings) for i, p in enumerate(points) if strictly_inside(r, *p)}


def test_run_of_points_is_not_tested_one_by_one():
    """A square of many points: all but those beside its edges come as runs."""
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 1, (2, 20_000))
    edges = [np.array(c) for c in ([0.1, 0.9, 0.9, 0.1], [0.1, 0.1, 0.9, 0.9], [0.9, 0.9, 0.1, 0.1], [0.1, 0.9, 0.9, 0.1])]
    box = [np.array([v]) for v in (0.1, 0.1, 0.9, 0.9)]
    _, (_, first, end), (alone, _) = crowds.found(x, y, np.zeros(1, bool), box, np.array([0, 4]), edges)
    assert (end - first).sum() + len(alone) == ((x > 0.1) & (x < 0.9) & (y > 0.1) & (y < 0.9)).sum()
    assert len(alone) < 0.03 * len(x)


@pytest.mark.parametrize("parts", [False, True])
def test_crowded_cells_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(polygons, "CROWDED_TESTS", 50)
    if parts:
        for name, value in (("LISTED_TESTS", 200), ("GROUP_POINTS", 15), ("GROUP_SHAPES", 4)):
            monkeypatch.setattr(polygons, name, value)
    rng = np.random.default_rng(7)
    rings = [star(rng, *rng.uniform((34.7, 31.9), (34.9, 32.1)), rng.choice([0.01, 0.05])) for _ in range(25)]
    rings += [[(34.75, 31.95), (34.85, 31.95), (34.85, 32.05), (34.75, 32.05)]] * 3
    names = [None if k == 20 else f"z{k % 12}" for k in range(len(rings))]  # some share a name, one has none
    layer = shapes(spark, [geom([r]) for r in rings], [n or "none" for n in names]).withColumn("name", F.expr("nullif(name, 'none')"))
    places = [*map(tuple, rng.uniform((34.65, 31.85), (34.95, 32.15), (200, 2)).tolist()), *[(34.8, 32.0)] * 30, (34.75, 32.0), (float("nan"), 32.0), (None, 32.0)]
    keys = [None if i % 9 == 0 else i // 2 for i in range(len(places))]  # keys come twice or not at all
    points = with_crs(spark.createDataFrame([(k, f"t{i}", *p) for i, (k, p) in enumerate(zip(keys, places))], "id long, tag string, lon double, lat double"), "EPSG:4326")
    want = []
    for i, (k, (x, y)) in enumerate(zip(keys, places)):
        hits = [names[j] for j, r in enumerate(rings) if x == x and x is not None and strictly_inside(r, x, y)]
        want += [(k, f"t{i}", h) for h in hits or [None]]
    joined = points_in_polygons(points, layer, key="id")
    assert "FlatMapCoGroupsInArrow" in joined._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.tag, r.neighborhood_polygon) for r in joined.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    report = (len(want), sum(z is None for _, _, z in want), len({z for _, _, z in want if z is not None}))
    assert tuple(stats.join_report(joined).first()) == report
    assert tuple(stats.join_report(joined.select("id", "neighborhood_polygon")).first()) == report  # counted from its rows


def test_report_of_a_crowd_lists_no_pairs(spark, monkeypatch):
    """The rows of the report are counted where they are found; the join itself is never run."""
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(polygons, "CROWDED_TESTS", 50)
    monkeypatch.setattr(crowds, "listing", lambda *a: lambda points, shapes: 1 / 0)
    stack = shapes(spark, [geom([[(34 + i / 1000, 32), (35, 32), (35, 33), (34, 33)]]) for i in range(40)])
    points = with_crs(spark.range(300).selectExpr("id", "34.2D + id / 1000 as lon", "32.5D as lat").union(spark.sql("select 300L, 10D, 10D")), "EPSG:4326")
    assert tuple(stats.join_report(points_in_polygons(points, stack, key="id")).first()) == (300 * 40 + 1, 1, 40)


def test_report_of_no_rows(spark):
    none = spark.sql("select cast(null as string) as neighborhood_polygon limit 0")
    assert tuple(stats.join_report(none).first()) == (0, 0, 0)
