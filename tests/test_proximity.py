import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from zonewise.functions.crs import with_crs
from zonewise.functions.projection import project
from zonewise.operators import proximity, workset
from zonewise.operators.proximity import Targets, count_within, nearest_distance


def layer(spark, lonlat, key="id"):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(lonlat)]
    return with_crs(spark.createDataFrame(rows, f"{key} long, lon double, lat double"), "EPSG:4326")


def metres(df):
    x, y = project(F.col("lon"), F.col("lat"))
    return np.array([tuple(r) for r in df.select(x.alias("x"), y.alias("y")).collect()])


def brute(spark, s, t):
    a, b = metres(s), metres(t)
    return np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])


def clustered(rng, n):
    """Two thirds uniform, one third within a few metres of one spot, plus far outliers and exact copies."""
    a = np.column_stack([rng.uniform(34.7, 34.95, 2 * n // 3), rng.uniform(31.9, 32.2, 2 * n // 3)])
    b = np.array([34.8, 32.0]) + rng.normal(0, 2e-5, (n // 3, 2))
    far = np.array([[34.0, 31.0], [35.9, 33.2]])
    return np.vstack([a, b, far, np.repeat(b[:1], n // 5, axis=0)])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shuffle", [False, True])
def test_nearest_equals_brute_force(spark, seed, shuffle, monkeypatch):
    if shuffle:  # the way of layers too large to broadcast, with every busy node counted as hot
        monkeypatch.setattr(workset, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(workset.salted_join, "__defaults__", (None, None, 20, None))
    rng = np.random.default_rng(seed)
    s = layer(spark, clustered(rng, 300))
    t = layer(spark, clustered(rng, 600))
    got = {r.id: r.d for r in nearest_distance(s, t, "d", "id").collect()}
    want = np.round(brute(spark, s, t).min(axis=1), 1)
    assert len(got) == s.count()
    assert np.abs(np.array([got[i] for i in range(len(want))]) - want).max() < 0.051


@pytest.mark.parametrize("shuffle", [False, True])
def test_counts_equal_brute_force(spark, shuffle, monkeypatch):
    if shuffle:
        monkeypatch.setattr(workset, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(workset.salted_join, "__defaults__", (None, None, 20, None))
    rng = np.random.default_rng(3)
    s = layer(spark, clustered(rng, 300))
    t = layer(spark, clustered(rng, 900))
    d = brute(spark, s, t)
    radii = {"near": 3.0, "mid": 500.0, "wide": 1000.0}
    got = count_within(s, t, radii, "id").orderBy("id").toPandas()
    for name, r in radii.items():
        assert (got[name].to_numpy() == (d < r).sum(axis=1)).all(), name
    assert (got.near <= got.mid).all() and (got.mid <= got.wide).all()
    inscribed = count_within(s, t, {"c": 500.0}, "id", circle="polygon64").orderBy("id").toPandas().c.to_numpy()
    a, b = metres(s), metres(t)
    angle = np.arctan2(b[None, :, 1] - a[:, None, 1], b[None, :, 0] - a[:, None, 0]) % (np.pi / 32) - np.pi / 64
    assert (inscribed == (d * np.cos(angle) < 500 * np.cos(np.pi / 64)).sum(axis=1)).all()


def test_dense_nodes_are_divided(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(proximity, "NODE_TARGETS", 4)
    s, t = layer(spark, clustered(rng, 120)), layer(spark, clustered(rng, 400))
    closed = proximity._reachable(proximity.Sources(s, "id").rows, Targets(t), {"c": 3.0}, "exact")
    assert len(closed) > 1
    d = brute(spark, s, t)
    assert (count_within(s, t, {"c": 3.0}, "id").orderBy("id").toPandas().c == (d < 3).sum(axis=1)).all()
    got = nearest_distance(s, t, "d", "id").orderBy("id").toPandas().d
    assert np.abs(got - d.min(axis=1)).max() < 0.051


@pytest.mark.parametrize("rows", [(4_000, 200_000, 1_000_000), (50, 30, 70)])
def test_tiles_count_as_brute_force_does(spark, monkeypatch, rows):
    """Many targets are matched by tiles, which move every target to nine tiles at most, however dense they lie."""
    monkeypatch.setattr(proximity, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(proximity, "_MEASURED", 100)
    for name, n in zip(("TILE_ROWS", "TILE_SOURCES", "TILE_TARGETS"), rows, strict=True):
        monkeypatch.setattr(proximity, name, n)
    monkeypatch.setattr(proximity, "_reachable", None)
    rng = np.random.default_rng(3)
    s, t = layer(spark, clustered(rng, 300)), layer(spark, clustered(rng, 900))
    t = with_crs(t.unionByName(t.filter("id % 3 = 0")), "EPSG:4326")  # copies count for themselves
    d, n = brute(spark, s, t), s.count()
    s = with_crs(s.unionByName(spark.createDataFrame([(n, None, None)], s.schema)), "EPSG:4326")
    radii = {"near": 3.0, "mid": 500.0, "wide": 1000.0}
    got = count_within(s, t, radii, "id").orderBy("id").toPandas()
    for name, r in radii.items():
        assert got[name].to_list() == [*(d < r).sum(axis=1), 0], name
    a, b = metres(s.filter("lon is not null")), metres(t)
    angle = np.arctan2(b[None, :, 1] - a[:, None, 1], b[None, :, 0] - a[:, None, 0]) % (np.pi / 32) - np.pi / 64
    inscribed = count_within(s, t, {"c": 500.0}, "id", circle="polygon64", empty_as_one=True).orderBy("id").toPandas().c
    assert inscribed.to_list() == [*np.maximum((d * np.cos(angle) < 500 * np.cos(np.pi / 64)).sum(axis=1), 1), 0]


def test_empty_targets_and_null_sources(spark):
    s = layer(spark, [(34.8, 32.0)])
    s = s.unionByName(spark.createDataFrame([(7, None, None)], s.schema))
    none = layer(spark, [(34.8, 32.0)]).limit(0)
    assert [r.d for r in nearest_distance(s, none, "d", "id").collect()] == [None, None]
    assert [r.c for r in count_within(s, none, {"c": 500.0}, "id", empty_as_one=True).collect()] == [0, 0]
    some = layer(spark, [(34.8, 32.001)])
    assert {r.id: r.d is None for r in nearest_distance(s, some, "d", "id").collect()} == {0: False, 7: True}
    assert {r.id: r.c for r in count_within(s, some, {"c": 500.0}, "id").collect()} == {0: 1, 7: 0}


def test_no_target_in_reach_counts_zero_or_one(spark):
    s, t = layer(spark, [(34.8, 32.0)]), layer(spark, [(35.0, 32.0)])
    assert count_within(s, t, {"c": 500.0}, "id").first().c == 0
    assert count_within(s, t, {"c": 500.0}, "id", empty_as_one=True).first().c == 1


def test_polygon_targets(spark):
    square = geom([[(34.80, 32.00), (34.81, 32.00), (34.81, 32.01), (34.80, 32.01)]])
    t = with_crs(spark.sql(f"select {square} as geometry"), "EPSG:4326")
    s = layer(spark, [(34.805, 32.005), (34.82, 32.005), (34.80, 32.0)])
    got = {r.id: r.d for r in nearest_distance(s, t, "d", "id").collect()}
    assert got[0] == 0 and got[2] == 0
    edge = layer(spark, [(34.81, 32.005)])
    assert got[1] == pytest.approx(brute(spark, s, edge)[1, 0], abs=0.2)


def test_guard(spark):
    bare = spark.createDataFrame([(1, 34.8, 32.0)], "id long, lon double, lat double")
    with pytest.raises(ValueError):
        nearest_distance(bare, bare, "d", "id")


@pytest.mark.parametrize("deep", [False, True])
def test_a_search_sums_up_each_layer_once(spark, deep, monkeypatch):
    """Levels come from one scan; beyond it only the rows of nodes that are still open are read, fewer each time."""
    scans, plain = [], proximity._Pyramid._of_rows

    def counted(self, level):
        scans.append((self.node[0], level - self.base, self.rows.count()))
        return plain(self, level)

    monkeypatch.setattr(proximity._Pyramid, "_of_rows", counted)
    rng = np.random.default_rng(11)
    s = layer(spark, np.column_stack([rng.uniform(34.7, 34.95, 500), rng.uniform(31.9, 32.2, 500)]))
    spots = np.column_stack([rng.uniform(34.7, 34.95, 4000), rng.uniform(31.9, 32.2, 4000)])
    if deep:  # a quarter of the targets within two metres, some of the sources beside them
        spots[:1000] = [34.8, 32.0] + rng.uniform(-1e-5, 1e-5, (1000, 2))
        s = layer(spark, np.vstack([[34.8, 32.0] + rng.uniform(-1e-5, 1e-5, (20, 2)), metres_free(s)]))
    t = layer(spark, spots)
    want = brute(spark, s, t).min(axis=1)
    got = {r.id: r.d for r in nearest_distance(s, t, "d", "id").collect()}
    assert np.abs(np.array([got[i] for i in range(len(want))]) - want).max() < 0.051
    for side, rows in (("qx", s.count()), ("tx", t.count())):
        read = [(level, n) for node, level, n in scans if node == side]
        assert read[0] == (0, rows)
        assert [level for level, _ in read] == list(range(len(read))) and (len(read) > 2) == deep
        beyond = [n for _, n in read[1:]]
        assert beyond == sorted(beyond, reverse=True) and all(n < rows / 2 for n in beyond)


def metres_free(df):
    return np.array([(r.lon, r.lat) for r in df.orderBy("id").collect()])
