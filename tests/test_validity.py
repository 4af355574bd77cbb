import math
import random
import time

import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from zonewise.functions import geometry as G
from zonewise.operators import clean, validity
from zonewise.operators.workset import Scratch


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def star(draw, n, x=0.0, y=0.0, r=1.0):
    return [(x + r * (0.5 + draw.random() / 2) * math.cos(2 * math.pi * k / n), y + r * (0.5 + draw.random() / 2) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def twisted(ring, i, j):
    ring = list(ring)
    ring[i], ring[j] = ring[j], ring[i]
    return ring


def shapes(draw):
    whole = [lambda: draw.uniform(-3, 3), lambda: draw.randint(-2, 2) * 1.0][draw.randint(0, 1)]
    ring = lambda: [(whole(), whole()) for _ in range(draw.randint(3, 7))]
    plain = lambda: draw.choice([ring(), star(draw, draw.randint(4, 40), whole(), whole(), draw.choice([0.5, 1, 3])), box(whole(), whole(), draw.choice([0.5, 1.0, 2.0]))])
    return [[plain() for _ in range(draw.choice([1, 1, 2, 3]))] for _ in range(draw.choice([1, 1, 2, 3]))]


FIXED = [
    [[box(0, 0, 4), box(1, 1, 1)]], [[box(0, 0, 4), box(5, 5, 1)]], [[box(0, 0, 4), box(1, 1, 2), box(1.5, 1.5, 0.5)]],
    [[box(0, 0, 1)], [box(1, 0, 1)]], [[box(0, 0, 4)], [box(1, 1, 1)]], [[box(0, 0, 4), box(1, 1, 2)], [box(1.5, 1.5, 1)]],
    [[box(0, 0, 4), box(0, 1, 1)]], [[[(0, 0), (2, 2), (2, 0), (0, 2)]]], [[[(0, 0), (2, 0), (1, 0), (1, 2)]]], [[[(0, 0), (1, 1), (2, 2)]]],
    [[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]]], [[[(0, 0), (float("nan"), 0), (1, 1)]]],
]


@pytest.mark.parametrize("crowded", [64, 8])
def test_joins_judge_as_the_expression_does(spark, monkeypatch, crowded):
    monkeypatch.setattr(validity, "CROWDED", crowded)
    monkeypatch.setattr(validity, "_FINEST", 1e-12 if crowded > 32 else 1e-3)
    draw = random.Random(crowded)
    every = [*FIXED, *[shapes(draw) for _ in range(60)]]
    rows = [(k, ("Polygon" if len(p) == 1 else "MultiPolygon", [[[(float(x), float(y)) for x, y in r] for r in part] for part in p])) for k, p in enumerate(every)]
    df = spark.createDataFrame(rows, f"id int, geometry {G.GEOMETRY_DDL}").repartition(4)
    df = df.unionByName(spark.sql(f"SELECT -1 AS id, CAST(NULL AS {G.GEOMETRY_DDL}) AS geometry"))
    with Scratch(spark) as scratch:
        got = {r.id: r._valid for r in validity.judged(df, scratch, long=0).collect()}
    want = {r.id: r.v for r in df.select("id", G.is_valid(F.col("geometry")).alias("v")).collect()}
    assert got == want and 8 < sum(want.values()) < len(want) - 8


def test_a_ring_of_200000_vertices(spark, tmp_path):
    n = 200_000
    base = spark.range(n).selectExpr("id", f"2 * pi() * id / {n} AS t", f"1 + 0.2D * sin(14 * pi() * id / {n}) + (hash(id) % 1000) * 1e-8D AS r")
    vertex = "struct(r * cos(t) AS x, r * sin(t) AS y)"
    ring = base.selectExpr(f"transform(sort_array(collect_list(struct(id, {vertex} AS v))), s -> s.v) AS ring")
    # one with two distant neighbours exchanged, one as it is
    both = ring.selectExpr("'good' AS name", "ring").unionByName(
        ring.selectExpr("'bad' AS name", "transform(ring, (v, i) -> CASE WHEN i = 50 THEN ring[60] WHEN i = 60 THEN ring[50] ELSE v END) AS ring")
    )
    df = both.select("name", G.polygon(F.col("ring")).alias("geometry"))
    start = time.time()
    with Scratch(spark) as scratch:
        got = {r.name: r._valid for r in validity.judged(df, scratch).select("name", "_valid").collect()}
    assert got == {"good": True, "bad": False}
    assert time.time() - start < 240


def test_cleaning_by_joins(spark):
    df = spark.sql(f"SELECT 1 AS id, {geom([box(0, 0, 1)])} AS geometry")
    assert clean.drop_invalid(df, long_shapes=True).columns == ["id", "geometry"] and clean.drop_invalid(df, long_shapes=True).count() == 1
