import glob
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zonewise.functions.crs import with_crs
from zonewise.operators import clean
from zonewise.plans import tables
from zonewise.sources import layers

FOLDER = "/root/testdata/sf0.01"


def files(path):
    return sorted(glob.glob(f"{path}/*.parquet"))


def test_files_stand_alone(spark, tmp_path):
    path = str(tmp_path / "zones.parquet")
    zones = tables.zones(spark, FOLDER)
    layers.write_layer(zones, path)
    assert not os.path.exists(f"{path}/_geo") and not [d for d in os.listdir(path) if d.startswith("_staging")]
    for name in files(path):
        told = json.loads(pq.read_metadata(name).metadata[b"geo"])
        column = told["columns"][told["primary_column"]]
        assert column["geometry_types"] == ["Polygon"] and "crs" not in column
        table = pq.read_table(name)
        assert table.schema.field("geometry").type == "binary"
        box = [table["bbox"].combine_chunks().field(k).to_pylist() for k in range(4)]
        assert column["bbox"] == [min(box[0]), min(box[1]), max(box[2]), max(box[3])]
    assert layers.file_crs(spark, path) == "EPSG:4326"
    back = layers.read_geoparquet(spark, path)
    assert back.columns == zones.columns
    key = lambda df: sorted((r.n_nationkey, r.name, r.geometry.type, len(r.geometry.parts[0][0])) for r in df.collect())
    assert [x[:3] for x in key(back)] == [x[:3] for x in key(zones)]
    # the system of a layer in metres is told, and kept by a single copied file
    layers.write_layer(with_crs(spark.sql("SELECT 1 AS id, 180000.0 AS lon, 660000.0 AS lat"), "EPSG:2039"), str(tmp_path / "m.parquet"))
    alone = files(tmp_path / "m.parquet")[0]
    assert layers.file_crs(spark, alone) == "EPSG:2039"


def test_bounds_are_filtered_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    every = tables.footprints(spark, FOLDER)
    layers.write_layer(every, path, row_group_rows=100)
    area = (34.75, 31.95, 34.80, 32.0)
    found = clean.clip_to_bbox(layers.load_layer(spark, [path], "parks", points=False), area)
    assert "bbox" not in found.columns
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for bound in ("LessThanOrEqual(bbox.xmin", "LessThanOrEqual(bbox.ymin", "GreaterThanOrEqual(bbox.xmax", "GreaterThanOrEqual(bbox.ymax"):
        assert bound in plan.split("PushedFilters")[1]
    want = {r.park_id for r in clean.clip_to_bbox(every, area).select("park_id").collect()}
    assert want and {r.park_id for r in found.select("park_id").collect()} == want
    # row groups that the four filters leave, by their statistics
    groups, met = 0, 0
    for name in files(path):
        told = pq.read_metadata(name)
        for g in range(told.num_row_groups):
            stats = {told.row_group(g).column(c).path_in_schema: told.row_group(g).column(c).statistics for c in range(told.num_columns)}
            x0, y0, x1, y1 = area
            groups += 1
            met += stats["bbox.xmin"].min <= x1 and stats["bbox.ymin"].min <= y1 and stats["bbox.xmax"].max >= x0 and stats["bbox.ymax"].max >= y0
    assert groups >= 15 and met <= groups / 3
    met_rows = layers.read_geoparquet(spark, path, bbox=area)
    box = {b: v for b, v in zip("abcd", area, strict=True)}
    assert met_rows.count() == every.select(F.array_min("geometry.parts").alias("p"), "geometry").count() - sum(
        1 for r in every.collect() if not _meets([v for p in r.geometry.parts for ring in p for v in ring], box)
    )


def _meets(vs, box):
    return min(v.x for v in vs) <= box["c"] and min(v.y for v in vs) <= box["d"] and max(v.x for v in vs) >= box["a"] and max(v.y for v in vs) >= box["b"]


def test_points_and_gaps(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    rows = spark.createDataFrame([(1, 34.8, 32.0), (2, None, None), (3, float("nan"), 32.0), (4, 34.6, 31.0)], "id int, lon double, lat double")
    layers.write_layer(with_crs(rows, "EPSG:4326"), path)
    got = layers.load_layer(spark, [path], "transactions")
    assert sorted((r.id, r.lon, r.lat) for r in got.select("id", "lon", "lat").fillna(0.0).collect()) == [(1, 34.8, 32.0), (2, 0, 0), (3, 0, 0), (4, 34.6, 31.0)]
    assert [r.id for r in clean.clip_to_bbox(got).collect()] == [1]
    with pytest.raises(ValueError, match="in the way"):
        layers.write_layer(with_crs(rows.withColumn("bbox", F.lit("mine")), "EPSG:4326"), str(tmp_path / "q.parquet"))


def test_failed_writes_leave_nothing_listed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "half.parquet")
    rows = with_crs(spark.range(0, 200, numPartitions=4).selectExpr("id", "34.5 + id / 1000 AS lon", "32.0D AS lat"), "EPSG:4326")
    from zonewise.sources import geoparquet

    plain = geoparquet._Writer.write

    def breaks(self, iterator):
        from pyspark import TaskContext

        done = plain(self, iterator)
        if TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(geoparquet._Writer, "write", breaks)
    monkeypatch.setattr(geoparquet, "in_curve_order", lambda df, crs: df.repartition(4))
    from pyspark import cloudpickle as pickling

    pickling.register_pickle_by_value(geoparquet)
    try:
        with pytest.raises(Exception, match="lost"):
            layers.write_layer(rows, path)
    finally:
        pickling.unregister_pickle_by_value(geoparquet)
    assert files(path) == [] and not glob.glob(f"{path}/_staging*/*")


def test_modes_and_empty_layers(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    rows = lambda a, b: with_crs(spark.range(a, b).selectExpr("id", "34.8D AS lon", "32.0D AS lat"), "EPSG:4326")
    ids = lambda: sorted(r.id for r in layers.read_geoparquet(spark, path, points=True).collect())
    layers.write_layer(rows(0, 0), path)
    assert ids() == [] and layers.file_crs(spark, path) == "EPSG:4326"
    layers.write_layer(rows(0, 3), path, mode="append")
    with pytest.raises(FileExistsError):
        layers.write_layer(rows(0, 1), path)
    layers.write_layer(rows(0, 1), path, mode="ignore")
    assert ids() == [0, 1, 2]
    # a layer may replace the one that it is read from
    layers.write_layer(layers.read_geoparquet(spark, path, points=True).filter("id > 0"), path, mode="overwrite")
    assert ids() == [1, 2]
