import json

import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from zonewise.functions.crs import with_crs
from zonewise.operators import clean, report, scoring, stats, validate
from zonewise.operators.scoring import SuitabilityScorer, Weights
from zonewise.sources import layers, open_data

TX = "txn_id long, neighborhood string, transaction_price string, rooms double, area_m2 string, lon double, lat double"


def points(spark, rows, schema):
    return with_crs(spark.createDataFrame(rows, schema), "EPSG:4326")


def test_clean_transactions_boundaries(spark):
    rows = [
        (1, "A", "300000", 3.0, "50", 34.8, 32.0),
        (2, "A", "300000", 3.0, "50", 34.70, 32.0),  # on the edge of the box
        (3, "A", "200000", 3.0, "50", 34.8, 32.0),  # price on the bound
        (4, "A", "n/a", 3.0, "50", 34.8, 32.0),
        (5, "B", "300000", 3.0, "50", 34.8, 32.0),  # unknown zone
        (6, None, "300000", 3.0, "50", 34.8, 32.0),
        (7, "A", "300000", 3.0, "0", 34.8, 32.0),
        (8, "A", "300000", 3.0, None, 34.8, 32.0),
        (9, "A", "300000", 3.0, "50", float("nan"), 32.0),
    ]
    out = clean.transactions(points(spark, rows, TX), ["A"]).collect()
    assert [r.txn_id for r in out] == [1]
    assert out[0].price_per_m2 == 6000 and out[0].log_price == pytest.approx(12.611541)


def test_polygon_may_touch_the_box_and_names_collide(spark):
    r = [(34.70, 31.95), (34.75, 31.95), (34.75, 32.0)]
    touching = with_crs(spark.sql(f"select 'p' as name, {geom([r])} as geometry"), "EPSG:4326")
    assert clean.clip_to_bbox(touching).count() == 1
    assert clean.parks(touching).columns == ["name", "lon", "lat"]
    with pytest.raises(ValueError):
        clean.standardise_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int"))
    assert clean.standardise_columns(spark.createDataFrame([(1,)], "` Stop Name ` int")).columns == ["stop_name"]
    with pytest.raises(ValueError):
        clean.zones(touching.drop("name"), ["p"])


def test_percentiles_by_range_equal_builtin(spark, monkeypatch):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, None).otherwise("y").alias("g"),
        (F.col("id") * 7919 % 1013).cast("double").alias("v"),
    )
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    small = stats.percentiles(df, ["g"], "v", wanted).orderBy("g").collect()
    monkeypatch.setattr(stats, "MAP_VALUES", 10)
    assert stats.percentiles(df, ["g"], "v", wanted).orderBy("g").collect() == small


def test_stats_drop_small_zones_and_need_their_column(spark):
    rows = [("A", 100.0, 10.0, 3.0, 50.0)] * 3 + [("B", 100.0, 10.0, 3.0, 50.0)] * 2 + [(None, 1.0, 1.0, 1.0, 1.0)] * 5
    df = spark.createDataFrame(rows, "neighborhood string, transaction_price double, price_per_m2 double, rooms double, area_m2 double")
    assert [r.name for r in stats.by_zone(df).collect()] == ["A"]
    with pytest.raises(ValueError):
        stats.by_zone(df, "zone")


ZONE = "name string, avg_price double, dist_to_nearest_transit_m double, dist_to_nearest_park_m double, transit_stops_500m long, parks_1km long"


def test_scores_of_constant_and_missing_features(spark):
    df = spark.createDataFrame([("a", 5.0, 10.0, 10.0, 2, 1), ("b", 5.0, None, 20.0, 1, 1), ("c", None, 30.0, 30.0, 0, 1)], ZONE)
    out = {r.name: r for r in scoring.run(df).collect()}
    assert {r.score_affordability for r in out.values()} == {1.0}
    assert out["a"].rank == 1 and out["c"].score_transit == 0
    none = df.withColumn("dist_to_nearest_park_m", F.lit(None).cast("double"))
    assert {(r.neighborhood_score, r.rank) for r in scoring.run(none).collect()} == {(None, None)}
    with pytest.raises(ValueError):
        scoring.run(df.drop("parks_1km"))
    with pytest.raises(RuntimeError):
        SuitabilityScorer().transform(df)
    model = SuitabilityScorer().fit(df)
    far = spark.createDataFrame([("z", 5.0, 10.0, 10.0, 9, 1)], ZONE)
    assert model.transform(far).first().score_transit > 1  # unseen data is not clipped


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 80.0), ("b", 80.0), ("c", 70.0), ("d", None)], "name string, s double")
    assert {r.name: r.rank for r in scoring.rank_by(df, "s").collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_weights():
    assert Weights.from_percent(60, 20) == Weights(0.2, 0.6, 0.2)
    for bad in [(0.5, 0.5, 0.5), (0.4, 0.35, 0.2)]:
        with pytest.raises(ValueError):
            Weights(*bad)
    Weights(0.4, 0.35, 0.250005)
    with pytest.raises(ValueError):
        Weights.from_percent(60, 50)


def test_budget(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 9.0), ("c", None)], "name string, avg_price double")
    names = lambda b: sorted(r.name for r in scoring.filter_by_budget(df, b).collect())
    assert (names(5), names(100), names(1)) == (["a"], ["a", "b"], ["a", "b", "c"])


def test_validation(spark):
    rows = [(1, "A", "200000", 1.0, "1", 34.8, 32.0), (2, "X", "abc", 1.0, "-1", 50.0, 32.0)]
    df = points(spark, rows, TX)
    r = validate.report(df, validate.TRANSACTIONS, known=["A"])
    bad = {f.check: f.n_bad for f in r.findings.filter("n_bad > 0").collect()}
    assert bad == {"null_price": 1, "area": 1, "unknown_names": 1, "country_bounds": 1}
    assert not r.passed and len(r.errors) == 1 and len(r.warnings) == 3
    with pytest.raises(ValueError):
        r.raise_if_failed()
    empty = validate.report(df.limit(0), validate.TRANSACTIONS)
    assert [f.check for f in empty.findings.collect()] == ["empty"] and not empty.passed
    bare = validate.layer(df.drop("rooms"), validate.TRANSACTIONS, known=["A"]).filter("n_bad > 0").collect()
    assert "required_columns" in {f.check for f in bare} and "country_bounds" not in {f.check for f in bare}


def test_colours_and_labels(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (25.0,), (50.0,), (100.0,), (120.0,), (None,)], "s double")
    got = [r[0] for r in df.select(report.score_color(F.col("s"))).collect()]
    assert got == ["#dc0000", "#dc0000", "#dc6400", "#dcb400", "#00b400", "#00b400", None]
    row = spark.range(1).select(report.money(F.lit(1234567.0)), report.money(F.lit(None).cast("double")), report.short_name(F.lit("Tel Aviv-Yafo"))).first()
    assert list(row) == ["₪1,234,567", "N/A", "Tel Aviv"]


def test_feature_collection_and_resolution_order(spark, tmp_path):
    ring = [[34.8, 32.0], [34.9, 32.0], [34.9, 32.1], [34.8, 32.0]]
    features = [
        {"type": "Feature", "properties": {"name": "one", "population": 5}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"name": "none"}, "geometry": None},
    ]
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    zones = layers.load_layer(spark, [str(tmp_path / "absent.parquet"), str(path)], "neighborhoods")
    rows = {r.name: r for r in zones.collect()}
    assert (rows["one"].population, rows["two"].geometry.type, len(rows["two"].geometry.parts)) == (5, "MultiPolygon", 2)
    assert rows["none"].geometry is None
    out = str(tmp_path / "zones.parquet")
    layers.write_layer(zones, out)
    assert {r.name: r.geometry for r in layers.read_geoparquet(spark, out).collect()} == {n: r.geometry for n, r in rows.items()}
    assert layers.read_scores(spark, str(tmp_path / "nothing.parquet")) is None
    with pytest.raises(FileNotFoundError):
        layers.load_layer(spark, [str(tmp_path / "nothing.csv")], "parks")


def test_ways_and_missing_zones(spark, tmp_path):
    square = [{"lon": 34.8, "lat": 32.0}, {"lon": 34.81, "lat": 32.0}, {"lon": 34.81, "lat": 32.01}, {"lon": 34.8, "lat": 32.01}]
    bow = [square[0], square[2], square[1], square[3]]
    elements = [
        {"type": "way", "tags": {"name": "Green"}, "geometry": square}, {"type": "way", "geometry": square[:3]},
        {"type": "way", "geometry": square[:2]}, {"type": "node", "geometry": square}, {"type": "way", "geometry": bow},
    ]
    path = tmp_path / "ways.json"
    path.write_text(json.dumps({"elements": elements}, indent=1))
    parks = open_data.normalise_ways(open_data.read_ways(spark, str(path))).collect()
    assert sorted(p.name for p in parks) == ["Green", "Park"]
    assert max(p.area_m2 for p in parks) == pytest.approx(1.047e6, rel=0.01)
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    b = spark.createDataFrame([("x", 2, "s"), ("y", 3, "t")], "name string, n int, extra string")
    assert sorted(map(tuple, open_data.fill_missing_zones(a, b).collect())) == [("x", 1, None), ("y", 3, "t")]


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "parks.csv"
    path.write_text("lon,extra,lat,area_m2,name\n34.8,q,32.0,12.5,A\n34.9,q,x,,B\n")
    rows = {r.name: r for r in layers.load_layer(spark, [str(path)], "parks", points=True).collect()}
    assert (rows["A"].lon, rows["A"].lat, rows["A"].area_m2) == (34.8, 32.0, 12.5)
    assert rows["B"].lat is None and rows["B"].area_m2 is None
    (tmp_path / "bad.csv").write_text("name,lon\nA,1\n")
    with pytest.raises(ValueError, match="lat"):
        layers.load_layer(spark, [str(tmp_path / "bad.csv")], "parks")


def test_crs_comes_from_the_file_or_is_refused(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    point = bytes([1]) + (1).to_bytes(4, "little") + b"".join(__import__("struct").pack("<d", v) for v in (179443.539389898, 663645.782280876))
    table = pa.table({"name": ["a"], "geometry": [point]})
    geo = {"primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 2039}}}}}
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "metric.parquet")
    pq.write_table(table, tmp_path / "silent.parquet")
    row = layers.read_geoparquet(spark, str(tmp_path / "metric.parquet"), points=True).first()
    assert (row.lon, row.lat) == pytest.approx((34.78, 32.065), abs=1e-9)
    with pytest.raises(ValueError, match="CRS"):
        layers.read_geoparquet(spark, str(tmp_path / "silent.parquet"), points=True)
    assert layers.read_geoparquet(spark, str(tmp_path / "silent.parquet"), points=True, crs="EPSG:2039").count() == 1


def test_validation_sees_every_fault(spark):
    g = lambda t, x: f"named_struct('type','{t}','parts',array(array(array(named_struct('x',{x}D,'y',32D),named_struct('x',{x}D+1,'y',32D),named_struct('x',{x}D,'y',33D)))))"
    df = spark.sql(f"select 'A' name, {g('Polygon', 34.8)} geometry union all select 'A', null union all select 'X', {g('Line', 34.8)} union all select 'B', {g('Polygon', 34.9)}")
    known = spark.createDataFrame([("A",), ("B",), ("C",), ("C",)], "name string")
    for names in (known, ["A", "B", "C"]):
        bad = {f.check: f.n_bad for f in validate.layer(df, validate.ZONES, known=names).filter("n_bad > 0").collect()}
        assert bad == {"crs": 1, "invalid_geometry": 1, "null_geometry": 1, "geometry_type": 2, "duplicate_names": 1, "unknown_names": 1, "missing_zones": 1}


def test_zones_without_score_come_last(spark):
    from zonewise.operators import report

    df = spark.createDataFrame([("a", None, None, None), ("b", 50.0, 1, 7.0)], "name string, neighborhood_score double, rank int, avg_price double")
    assert report.kpis(df).first().top_zone == "b"
    assert {r.name: r.neighborhood_score for r in report.ranking_table(df).collect()} == {"a": "N/A", "b": "50.0"}


def test_settled_tables_go_away(spark, tmp_path):
    from zonewise.operators import workset

    with workset.Scratch(spark) as scratch:
        table = scratch.settle(spark.range(5).withColumn("kind", F.col("id") % 2), by="kind")
        assert table.count() == 5
        scratch.drop_part(table, "kind=1")
        scratch.drop(scratch.settle(spark.range(3)))
        kept = scratch.keep(spark.range(4))
        path = scratch.path
    assert kept.count() == 4 and not layers.exists(spark, path)
