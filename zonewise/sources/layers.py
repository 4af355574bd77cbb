"""Reading and writing layers: GeoJSON, GeoParquet, CSV points, scored zones."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions.crs import crs_of, to_wgs84, with_crs
from ..functions.numeric import nan_to_null
from ..settings import STORAGE_CRS
from ..operators.workset import Scratch
from . import geoparquet, json_ranges, stores, wkb

# Attribute columns of the four layers.
SCHEMAS = {
    "transactions": "address string, neighborhood string, transaction_price double, rooms double, area_m2 double, price_per_m2 double",
    "neighborhoods": "name string, population bigint",
    "transit_stops": "stop_name string, stop_type string, routes string",
    "parks": "name string, area_m2 double",
}
POINT_LAYERS = ("transactions", "transit_stops")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at the path (or behind the pattern)? Asks the file system of the path, without listing what lies there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def _coordinates(kind: Column, text: Column) -> dict[str, Column]:
    vertex = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    ring = lambda r: F.transform(r, vertex)
    polygon = lambda p: F.transform(p, ring)
    point = F.from_json(text, "array<double>")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(vertex(point)))))
        .when(kind == "Polygon", F.array(polygon(one)))
        .when(kind == "MultiPolygon", F.transform(many, polygon))
    )
    return {
        "geometry": F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts"))),
        "lon": F.when(kind == "Point", point[0]),
        "lat": F.when(kind == "Point", point[1]),
    }


def read_geojson(
    spark: SparkSession,
    path,
    properties: str,
    points: bool = False,
    lines: bool = False,
    crs: str = STORAGE_CRS,
    range_bytes: int | None = None,
) -> DataFrame:
    """Features to rows. ``properties`` is the DDL of the attributes.

    ``lines`` reads one feature per line. Otherwise each file is one FeatureCollection, which is read by byte ranges, many
    tasks to a large file; only compressed files, and those on a file system that Arrow does not know, are one task's
    work each. Coordinates nest to a depth that depends on the type, hence are read as text.
    """
    shape = "struct<type:string,coordinates:string>"
    feature = f"struct<properties:struct<{_nested(properties)}>,geometry:{shape}>"
    if lines:
        raw = spark.read.schema(f"properties struct<{_nested(properties)}>, geometry {shape}").json(path)
        raw = raw.filter(F.col("geometry").isNotNull() | F.col("properties").isNotNull())
    elif all(json_ranges.readable(spark, p) for p in ([path] if isinstance(path, str) else path)):
        found = json_ranges.array_elements(spark, path, "features", range_bytes)
        raw = found.select(F.from_json("value", feature).alias("f")).select("f.*")
    else:
        raw = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path)
        raw = raw.select(F.explode("features").alias("f")).select("f.*")
    found = _coordinates(F.col("geometry.type"), F.col("geometry.coordinates"))
    shape = [found[c].alias(c) for c in (("lon", "lat") if points else ("geometry",))]
    return to_wgs84(_without_nan(raw.select("properties.*", *shape)), crs)


def _nested(ddl: str) -> str:
    return ",".join(":".join(part.split(None, 1)) for part in (p.strip() for p in ddl.split(",")))


def _without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: nan_to_null(F.col(f.name)) for f in df.schema if f.dataType.typeName() == "double"})


def read_geoparquet(
    spark: SparkSession, path, points: bool = False, column: str = "geometry", crs: str | None = None, covering: bool = False, bbox=None
) -> DataFrame:
    """Parquet with a WKB column; the other columns keep their pruning and filters at the scan.

    The coordinate system comes from the file; ``crs`` declares it for a file that says nothing, which is refused otherwise.
    Where the file names a covering, ``bbox`` (in the file's units) keeps the rows whose bounds meet the box, a range
    filter that skips row groups, and ``covering`` hands the bounds on as column ``bbox``, which ``clean.clip_to_bbox`` uses
    in the same way. Without a covering ``bbox`` is an error, since nothing could be skipped.
    """
    told = file_geo(spark, path if isinstance(path, str) else path[0])
    crs = crs or _declared_crs(told)
    if crs is None:
        raise ValueError(f"{path} declares no CRS; pass crs= to declare it")
    raw = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    cover = _covering(told)
    attributes = [c for c in raw.columns if c != column and not (cover and c == cover["xmin"][0])]
    if bbox is not None:
        if not cover:
            raise ValueError(f"{path} has no covering to select by")
        x0, y0, x1, y1 = (float(v) for v in bbox)
        at = {b: F.col(".".join(f"`{p}`" for p in cover[b])) for b in G.BOUNDS}
        raw = raw.filter((at["xmin"] <= x1) & (at["ymin"] <= y1) & (at["xmax"] >= x0) & (at["ymax"] >= y0))
    if covering and cover and crs == STORAGE_CRS and "bbox" not in attributes:
        # plain fields of the column, so that filters on them stay filters at the scan
        kept = cover["xmin"][0]
        raw = raw if kept == "bbox" else raw.withColumnRenamed(kept, "bbox")
        attributes = [*attributes, "bbox"]
    if points:
        df = raw.select(*attributes, wkb.to_point(F.col(column)).alias("_p")).select(*attributes, "_p.lon", "_p.lat")
    else:
        shape = wkb.to_geometry(F.col(column))
        df = raw.select(*attributes, shape.alias("geometry"))
        df = df.withColumn("geometry", F.when(F.col("geometry.type").isNotNull(), F.col("geometry")))
    return to_wgs84(_without_nan(df), crs)


def read_points_csv(
    spark: SparkSession, path, schema: str, lon: str = "lon", lat: str = "lat", crs: str = STORAGE_CRS
) -> DataFrame:
    """CSV with a header and two coordinate columns, in degrees or in the system named by ``crs``.

    Columns are found by the names in the header, in any order, and cast leniently; further columns are left out, a missing
    one is an error, and so is a file whose header differs from the first one's.
    """
    wanted = StructType.fromDDL(schema)
    header = spark.read.option("header", True).csv(path)
    missing = [f.name for f in wanted if f.name not in header.columns]
    if missing:
        raise ValueError(f"{path}: no columns {missing} in the header {header.columns}")
    df = spark.read.schema(header.schema).option("header", True).option("enforceSchema", False).csv(path)
    df = df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
    return to_wgs84(_without_nan(df.withColumnsRenamed({lon: "lon", lat: "lat"})), crs)


def file_geo(spark: SparkSession, path: str) -> dict | None:
    """The ``geo`` entry of a GeoParquet layer: in the footer of one of its files, or beside them as ``_geo``."""
    if exists(spark, f"{path}/_geo"):
        geo = "".join(r[0] for r in spark.read.text(f"{path}/_geo").collect())  # one line
    else:
        files = spark.read.parquet(path).inputFiles()
        if not files:
            return None
        jvm = spark._jvm
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            jvm.org.apache.hadoop.fs.Path(files[0]), spark._jsc.hadoopConfiguration()
        )
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            geo = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
        finally:
            reader.close()
    return json.loads(geo) if geo else None


def file_crs(spark: SparkSession, path: str) -> str | None:
    """The coordinate system a GeoParquet file declares."""
    return _declared_crs(file_geo(spark, path))


def _declared_crs(told: dict | None) -> str | None:
    if not told:
        return None
    crs = told["columns"][told["primary_column"]].get("crs", STORAGE_CRS)  # the format's default is longitude and latitude in degrees
    if isinstance(crs, dict):
        known = crs.get("id") or {}
        crs = f"{known.get('authority')}:{known.get('code')}"
    return STORAGE_CRS if crs == "OGC:CRS84" else crs


def _covering(told: dict | None) -> dict | None:
    """Paths of the four bounds, where they are fields of one struct column."""
    cover = told and told["columns"][told["primary_column"]].get("covering", {}).get("bbox")
    if not cover or len({tuple(cover[b][:1]) for b in G.BOUNDS}) != 1 or any(cover[b][1:] != [b] for b in G.BOUNDS):
        return None
    return cover


def load_layer(spark: SparkSession, paths: list[str], layer: str, points: bool | None = None, crs: str | None = None) -> DataFrame:
    """The first of the paths that exists, read by its suffix. Text formats are in degrees unless ``crs`` says otherwise."""
    points = layer in POINT_LAYERS if points is None else points
    for path in paths:
        if not exists(spark, path):
            continue
        if path.rstrip("/").endswith(".parquet"):
            return read_geoparquet(spark, path, points, crs=crs, covering=True)
        if path.rstrip("/").endswith(".csv"):
            return read_points_csv(spark, path, f"{SCHEMAS[layer]}, lon double, lat double", crs=crs or STORAGE_CRS)
        lines = path.rstrip("/").endswith((".geojsonl", ".ndjson"))
        return read_geojson(spark, path, SCHEMAS[layer], points, lines, crs or STORAGE_CRS)
    raise FileNotFoundError(f"{layer}: none of {paths} exists")


def write_layer(df: DataFrame, path: str, mode: str = "errorifexists", row_group_rows: int = geoparquet.ROW_GROUP_ROWS) -> None:
    """GeoParquet: geometry as WKB, bounds of every row, rows in the order of a space-filling curve.

    The ``geo`` entry lies in the footer of every file, and the layer appears as a whole or not at all. On a file system that
    Arrow does not know, Spark writes the files and the entry lies beside them as ``_geo``.
    """
    spark = df.sparkSession
    crs = crs_of(df)
    if crs is None:
        raise ValueError("layer has no CRS; declare it before writing")
    if mode not in ("errorifexists", "error", "overwrite", "append", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    if mode in ("errorifexists", "error", "ignore") and exists(spark, path):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    with Scratch(spark) as scratch:
        # settled, since ordering reads it twice, and the layer may be read from the path it replaces
        rows = scratch.settle(geoparquet.encoded(df))
        if stores.reachable(spark, path):
            geoparquet.write(rows, stores.full(spark, path), crs, mode == "overwrite", row_group_rows)
            return
        geoparquet.in_curve_order(rows, crs).write.mode("overwrite" if mode == "overwrite" else "append").parquet(path)
    geo = json.dumps(geoparquet.geo_entry(crs))
    spark.createDataFrame([(geo,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_geo")


def _geojson_shape(df: DataFrame) -> Column:
    if "geometry" not in df.columns:
        return F.struct(F.lit("Point").alias("type"), F.to_json(F.array("lon", "lat")).alias("coordinates"))
    pairs = lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"]))
    closed = lambda ring: F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    rings = F.transform(F.col("geometry.parts"), lambda p: F.transform(p, lambda r: pairs(closed(r))))
    text = (
        F.when(F.col("geometry.type") == "Point", F.to_json(F.array(*[F.col("geometry.parts")[0][0][0][c] for c in ("x", "y")])))
        .when(F.col("geometry.type") == "Polygon", F.to_json(rings[0]))
        .otherwise(F.to_json(rings))
    )
    return F.struct(F.col("geometry.type").alias("type"), text.alias("coordinates"))


def _collection(batches):
    """The features of a partition as one FeatureCollection, a feature to a line."""
    before = '{"type":"FeatureCollection","features":['
    for batch in batches:
        lines = batch.column(0).to_pylist()
        for k, line in enumerate(lines):
            lines[k] = before + line
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array([(before if before != "," else "") + "]}"])], names=["value"])


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists", collection: bool = False) -> None:
    """One feature per line, which any reader can split; ``collection`` makes each file one FeatureCollection."""
    properties = [c for c in df.columns if c not in ("geometry", "lon", "lat")]
    shape = _geojson_shape(df)
    # coordinates nest to different depths, so they are put in as text rather than through one schema
    geometry = F.concat(
        F.lit('{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}")
    )
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)),
        F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"),
    )
    out = df.select(line.alias("value"))
    (out.mapInArrow(_collection, "value string") if collection else out).write.mode(mode).text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Scored zones written earlier, or None."""
    return read_geoparquet(spark, path) if exists(spark, path) else None
