"""Feature columns of zones."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import geometry as G
from ..functions.crs import assert_wgs84
from .proximity import Sources, Targets, as_targets, count_table, nearest_table
from .stats import by_zone
from .workset import settle

SPATIAL = [
    "dist_to_nearest_transit_m",
    "dist_to_nearest_park_m",
    "transit_stops_500m",
    "transit_stops_1km",
    "parks_1km",
]


def zone_spatial(
    zones: DataFrame, stops: DataFrame | Targets, parks: DataFrame | Targets, key: str | None = None, **count_options
) -> DataFrame:
    """Distances to the nearest stop and park and counts around the centroid of each zone.

    ``key`` names a unique column; without one every row gets a number of its own for the time of the search, so zones
    that share a name, or have none, are measured each for itself. Stops are searched once for both radii. The four searches do not depend on one another and
    run as concurrent jobs. Options go to ``count_table``.
    """
    assert_wgs84(zones, "zones")
    numbered = key is None
    if numbered:
        key = "_zone"
        zones = settle(zones.withColumn(key, F.monotonically_increasing_id()))
    centres = zones.filter(F.col("geometry").isNotNull()).select(F.col(key).alias("skey"), G.metric_centroid(F.col("geometry")).alias("c"))
    centres = centres.select("skey", F.col("c.x").alias("sx"), F.col("c.y").alias("sy"))
    wide = {SPATIAL[2]: settings.TRANSIT_RADIUS_M, SPATIAL[3]: settings.WIDE_TRANSIT_RADIUS_M}
    with ThreadPoolExecutor(4) as pool:
        sides = [pool.submit(Sources, zones, key, centres), pool.submit(as_targets, stops), pool.submit(as_targets, parks)]
        source, stop_side, park_side = (s.result() for s in sides)
        found = [
            pool.submit(nearest_table, source, stop_side, SPATIAL[0]),
            pool.submit(nearest_table, source, park_side, SPATIAL[1]),
            pool.submit(count_table, source, stop_side, wide, **count_options),
            pool.submit(count_table, source, park_side, {SPATIAL[4]: settings.PARK_RADIUS_M}, **count_options),
        ]
        tables = [f.result() for f in found]
    # the narrow tables meet first, so that the geometry is joined once
    found = tables[0]
    for table in tables[1:]:
        found = found.join(table, key, "full")
    zones = zones.join(found, key, "left")
    return zones.drop(key) if numbered else zones


def attach_stats(zones: DataFrame, transactions: DataFrame, by: str = "neighborhood") -> DataFrame:
    """Zone statistics joined on the name; zones without them keep NULLs."""
    return zones.join(by_zone(transactions, by), "name", "left")
