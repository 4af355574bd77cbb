"""Shaping of raw open-data payloads into layers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.crs import with_crs
from ..functions.numeric import half_even, to_number
from ..settings import STORAGE_CRS
from . import json_ranges

# Local and canonical names of the places with their centres (lon, lat).
PLACES = [
    ("תל אביב-יפו", "Tel Aviv-Yafo", 34.780, 32.065),
    ("רמת גן", "Ramat Gan", 34.835, 32.070),
    ("גבעתיים", "Givatayim", 34.812, 32.048),
    ("בני ברק", "Bnei Brak", 34.840, 32.083),
    ("חולון", "Holon", 34.795, 32.015),
    ("בת ים", "Bat Yam", 34.750, 31.985),
    ("פתח תקווה", "Petah Tikva", 34.885, 32.090),
    ("ראשון לציון", "Rishon LeZion", 34.800, 31.975),
    ("הרצליה", "Herzliya", 34.845, 32.165),
    ("רמת השרון", "Ramat HaSharon", 34.843, 32.125),
    ("קריית אונו", "Kiryat Ono", 34.855, 32.055),
    ("גבעת שמואל", "Givat Shmuel", 34.857, 32.075),
]
DEFAULT_CENTRE = (34.81, 32.06)
JITTER = (0.012, 0.010)
MIN_DEAL_PRICE = 100_000
MIN_DEAL_AREA = 10
_HASH_RANGE = 1 << 30


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, "local_name string, name string, centre_lon double, centre_lat double")


def geocode_by_place(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Canonical name and an approximate position from a local place name.

    Unknown places get no name and the default centre. With a ``key`` column positions are scattered around the centre,
    normally distributed and the same in every run.
    """
    lookup = F.broadcast(places(df.sparkSession))
    out = df.join(lookup, F.col(column) == F.col("local_name"), "left").withColumns(
        {
            "lon": F.coalesce("centre_lon", F.lit(DEFAULT_CENTRE[0])),
            "lat": F.coalesce("centre_lat", F.lit(DEFAULT_CENTRE[1])),
        }
    )
    if key:
        u = [(F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(_HASH_RANGE)) + 0.5) / float(_HASH_RANGE) for i in (0, 1)]
        radius, angle = F.sqrt(F.lit(-2.0) * F.log(u[0])), F.lit(2 * math.pi) * u[1]
        out = out.withColumns(
            {
                "lon": F.col("lon") + radius * F.cos(angle) * JITTER[0],
                "lat": F.col("lat") + radius * F.sin(angle) * JITTER[1],
            }
        )
    out = out.drop("local_name", "centre_lon", "centre_lat")
    return with_crs(out, STORAGE_CRS)


def normalise_deals(raw: DataFrame, key: str | None = None) -> DataFrame:
    """Raw deal records to transactions; records without a usable price and area are dropped."""
    for c in ("DEALAMOUNT", "AREA", "ASSETROOMNUM", "FULLADRESS"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    typed = raw.withColumns(
        {"_price": to_number(F.col("DEALAMOUNT")), "_area": to_number(F.col("AREA")), "_rooms": to_number(F.col("ASSETROOMNUM"))}
    ).filter((F.col("_price") > MIN_DEAL_PRICE) & (F.col("_area") > MIN_DEAL_AREA))
    placed = geocode_by_place(typed, "CITYNAME", key)
    return placed.select(
        *([key] if key else []),
        F.coalesce("FULLADRESS", F.lit("")).alias("address"),
        F.col("name").alias("neighborhood"),
        F.col("_price").cast("bigint").alias("transaction_price"),
        F.coalesce("_rooms", F.lit(0.0)).alias("rooms"),
        half_even(F.col("_area"), 1).alias("area_m2"),
        half_even(F.col("_price") / F.col("_area")).alias("price_per_m2"),
        "lon",
        "lat",
    )


WAY_DDL = "struct<type:string,id:bigint,tags:struct<name:string>,geometry:array<struct<lon:double,lat:double>>>"

WAYS_DDL = f"elements array<{WAY_DDL}>"


def read_ways(spark: SparkSession, path, range_bytes: int | None = None) -> DataFrame:
    """Way payloads, one JSON document per file; a large extract is read by byte ranges like a FeatureCollection."""
    if all(json_ranges.readable(spark, p) for p in ([path] if isinstance(path, str) else path)):
        found = json_ranges.array_elements(spark, path, "elements", range_bytes)
        return found.select(F.array(F.from_json("value", WAY_DDL)).alias("elements"))
    return spark.read.schema(WAYS_DDL).option("multiLine", True).json(path)


def normalise_ways(payload: DataFrame) -> DataFrame:
    """Ways with at least three vertices to valid park polygons with their area in whole square metres."""
    e = payload.select(F.explode("elements").alias("e")).filter(
        (F.col("e.type") == "way") & (F.size("e.geometry") >= 3)
    )
    ring = F.transform("e.geometry", lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y")))
    shaped = e.select(F.coalesce("e.tags.name", F.lit("Park")).alias("name"), G.polygon(ring).alias("geometry"))
    valid = shaped.filter(G.is_valid(F.col("geometry")))
    parks = valid.select("name", half_even(G.area(F.col("geometry"))).alias("area_m2"), "geometry")
    return with_crs(parks, STORAGE_CRS)


def fill_missing_zones(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """All primary zones and those of the backup whose name the primary lacks."""
    extra = backup.join(primary.select("name").distinct(), "name", "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)
