import math

import pytest
from pyspark.sql import functions as F

from zonewise.functions import crs, geometry as G
from zonewise.functions.numeric import half_even, to_number
from zonewise.functions.projection import project, unproject


def ring(*points):
    return "array(" + ",".join(f"named_struct('x',{float(x)}D,'y',{float(y)}D)" for x, y in points) + ")"


def geom(*parts, kind=None):
    kind = kind or ("Polygon" if len(parts) == 1 else "MultiPolygon")
    body = ",".join("array(" + ",".join(ring(*r) for r in part) + ")" for part in parts)
    return f"named_struct('type','{kind}','parts',array({body}))"


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
FAR = [(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)]
BOW = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
SPIKE = [(0, 0), (4, 0), (4, 4), (4, 0), (0, 4)]


def one(spark, expr, col):
    return spark.sql(f"select {expr} as g").select(col(F.col("g"))).first()[0]


def test_projection_matches_known_point_and_round_trips(spark):
    df = spark.createDataFrame([(34.78, 32.065), (35.2045169444444, 31.7343936111111), (34.9, 33.0)], "lon double, lat double")
    x, y = project(F.col("lon"), F.col("lat"))
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = unproject(F.col("x"), F.col("y"))
    rows = df.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert rows[0].x == pytest.approx(179443.539389898, abs=1e-6)
    assert rows[0].y == pytest.approx(663645.782280876, abs=1e-6)
    assert (rows[1].x, rows[1].y) == pytest.approx((219529.584, 626907.39), abs=1e-6)
    for r in rows:
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-10)  # ten micrometres


def test_area_and_centroid_by_hand(spark):
    assert one(spark, geom([SQUARE]), G.planar_area) == 16
    assert one(spark, geom([SQUARE, HOLE]), G.planar_area) == 15
    assert one(spark, geom([SQUARE], [FAR]), G.planar_area) == 20
    c = one(spark, geom([SQUARE]), G.planar_centroid)
    assert (c.x, c.y) == (2, 2)
    c = one(spark, geom([SQUARE, HOLE]), G.planar_centroid)
    assert c.x == pytest.approx((16 * 2 - 1.5) / 15)
    c = one(spark, geom([SQUARE], [FAR]), G.planar_centroid)
    assert (c.x, c.y) == pytest.approx(((16 * 2 + 4 * 11) / 20, (16 * 2 + 4 * 1) / 20))
    assert one(spark, geom([SQUARE[::-1]]), G.planar_area) == 16


def test_area_in_square_metres(spark):
    d = 0.01
    r = [(34.8, 32.0), (34.8 + d, 32.0), (34.8 + d, 32.0 + d), (34.8, 32.0 + d)]
    got = one(spark, geom([r]), G.area)
    expected = (d * 111_320 * math.cos(math.radians(32.005))) * (d * 110_900)
    assert got == pytest.approx(expected, rel=5e-3)


@pytest.mark.parametrize(
    "expr,valid",
    [
        (geom([SQUARE]), True),
        (geom([SQUARE, HOLE]), True),
        (geom([SQUARE], [FAR]), True),
        (geom([BOW]), False),
        (geom([[(1, 2)]], kind="Point"), True),
        ("named_struct('type','Point','parts',array(array(array(named_struct('x',double('inf'),'y',0D)))))", False),
        (geom([SQUARE, FAR]), False),
        (geom([SQUARE], [HOLE]), False),
        (geom([SQUARE, HOLE], [[(1.2, 1.2), (1.8, 1.2), (1.5, 1.8)]]), True),
        (geom([SQUARE, [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)], HOLE]), False),
        (geom([SPIKE]), False),
        (geom([[(0, 0), (1, 1), (2, 2)]]), False),
        (geom([[(0, 0), (1, 1)]]), False),
        (geom([SQUARE, [(3, 1), (6, 1), (6, 2), (3, 2)]]), False),
        (geom([[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]), True),
        ("named_struct('type','Polygon','parts',array(array(array(named_struct('x',double('nan'),'y',0D)))))", False),
        (f"cast(null as {G.GEOMETRY_DDL})", False),
    ],
)
def test_validity(spark, expr, valid):
    assert one(spark, expr, G.is_valid) is valid


@pytest.mark.parametrize(
    "x,y,inside",
    [(2, 3, True), (1.5, 1.5, False), (0, 2, False), (1, 1.5, False), (4, 4, False), (5, 1, False), (3, 1, True), (2, 4, False)],
)
def test_contains_excludes_boundary_and_hole(spark, x, y, inside):
    got = one(spark, geom([SQUARE, HOLE]), lambda g: G.contains_point(g, F.lit(float(x)), F.lit(float(y))))
    assert got is inside


def test_half_even_and_cast(spark):
    row = spark.range(1).select(
        half_even(F.lit(2.5)), half_even(F.lit(0.25), 1), half_even(F.lit(3.5)), to_number(F.lit("abc")), to_number(F.lit("NaN"))
    ).first()
    assert list(row) == [2.0, 0.2, 4.0, None, None]


def test_crs_guard(spark):
    df = spark.createDataFrame([(179443.539389898, 663645.782280876)], "lon double, lat double")
    with pytest.raises(ValueError):
        crs.assert_wgs84(df)
    with pytest.raises(ValueError):
        crs.to_wgs84(df)
    metric = crs.with_crs(df, "EPSG:2039")
    with pytest.raises(ValueError):
        crs.assert_wgs84(metric)
    back = crs.to_wgs84(metric)
    crs.assert_wgs84(back)
    assert tuple(back.first()) == pytest.approx((34.78, 32.065), abs=1e-9)
