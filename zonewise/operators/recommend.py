"""One suggested action per zone that scores below the median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import require_columns
from .stats import long_form, percentiles

# The texts of the actions.
FAR_TRANSIT = "Improve transit access — nearest stop >1 km away"
FAR_PARK = "Add green spaces — nearest park >2 km away"
HIGH_PRICE = "High prices limit affordability score"
FEW_STOPS = "Low transit density within 500 m"
OTHER = "Multiple dimensions below average"


def recommend(zones: DataFrame, score: str = "ml_score") -> DataFrame:
    """(city, ml_score, recommendation) for zones below the median score; the first rule that holds decides.

    A missing value fails its rule, a missing column removes it.
    """
    require_columns(zones, [score], "zones")
    has = set(zones.columns)
    judged = [c for c in (score, "avg_price", "transit_stops_500m") if c in has]
    marks = percentiles(long_form(zones, judged, []), ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    marks = {r["column"]: r for r in marks.collect()}  # one row per judged column
    mark = lambda c, p: F.lit(marks[c][p] if c in marks else None).cast("double")
    rules = [
        ("dist_to_nearest_transit_m", lambda: F.col("dist_to_nearest_transit_m") > 1000, FAR_TRANSIT),
        ("dist_to_nearest_park_m", lambda: F.col("dist_to_nearest_park_m") > 2000, FAR_PARK),
        ("avg_price", lambda: F.col("avg_price") > mark("avg_price", "p75"), HIGH_PRICE),
        ("transit_stops_500m", lambda: F.col("transit_stops_500m") < mark("transit_stops_500m", "p25"), FEW_STOPS),
    ]
    action = F.coalesce(*[F.when(test(), F.lit(text)) for c, test, text in rules if c in has], F.lit(OTHER))
    city = F.col("name") if "name" in has else F.lit("—")
    return (
        zones.filter(F.col(score) < mark(score, "p50"))
        .select(city.alias("city"), F.col(score).alias("ml_score"), action.alias("recommendation"))
        .orderBy("ml_score", "city")
    )
