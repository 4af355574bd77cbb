"""Tables shown to a reader: rankings, key figures, score components, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from .scoring import SUBSCORES


def score_color(score: Column, top: float = 100.0) -> Column:
    """Red over yellow to green as ``#rrggbb``; scores outside 0..top take the end colours."""
    share = score / F.lit(top)
    ratio = F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)  # least and greatest would pass over NULL
    # End colours of the gradient
    to_yellow = F.format_string("#%02x%02x%02x", F.lit(220), (ratio * 2 * 200).cast("int"), F.lit(0))
    to_green = F.format_string(
        "#%02x%02x%02x", ((1 - (ratio - 0.5) * 2) * 220).cast("int"), F.lit(180), F.lit(0)
    )
    return F.when(ratio < 0.5, to_yellow).when(ratio >= 0.5, to_green)


def score_band(score: Column) -> Column:
    return F.when(score < 40, "low").when(score < 65, "mid").when(score.isNotNull(), "high")


def short_name(name: Column) -> Column:
    """Label up to the first hyphen."""
    return F.split(name, "-")[0]


def money(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₪"), F.format_number(value, 0)), F.lit("N/A"))


def score_label(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1f", value)).otherwise("N/A")


def count_label(value: Column) -> Column:
    return F.coalesce(value.cast("bigint").cast("string"), F.lit("N/A"))


def ranking_table(zones: DataFrame) -> DataFrame:
    """Display columns in rank order; columns that are not there are left out."""
    shown = {
        "rank": F.col("rank"),
        "name": F.col("name"),
        "neighborhood_score": score_label(F.col("neighborhood_score")) if "neighborhood_score" in zones.columns else None,
        "ml_score": F.col("ml_score") if "ml_score" in zones.columns else None,
        "avg_price": money(F.col("avg_price")) if "avg_price" in zones.columns else None,
        "transit_stops_500m": count_label(F.col("transit_stops_500m")) if "transit_stops_500m" in zones.columns else None,
        "parks_1km": count_label(F.col("parks_1km")) if "parks_1km" in zones.columns else None,
    }
    return zones.orderBy("rank", "name").select(*[c.alias(n) for n, c in shown.items() if c is not None])


def map_table(zones: DataFrame) -> DataFrame:
    """Colour, band and label columns of a zone map."""
    return zones.select(
        "name",
        short_name(F.col("name")).alias("label"),
        score_color(F.col("neighborhood_score")).alias("color"),
        score_band(F.col("neighborhood_score")).alias("band"),
        money(F.col("avg_price")).alias("price_label"),
        count_label(F.col("transit_stops_500m")).alias("stops_label"),
        count_label(F.col("parks_1km")).alias("parks_label"),
    )


def top_k(df: DataFrame, k: int = 12) -> DataFrame:
    """The best k zones by rank."""
    return df.orderBy("rank", "name").limit(k)


def kpis(zones: DataFrame) -> DataFrame:
    """Number of zones, best zone and its score, lowest average price, mean score; the first name wins a tie, zones without a score never do."""
    score = F.col("neighborhood_score")
    # rows without a score have no order and are passed over
    first = F.min_by("name", F.when(score.isNotNull(), F.struct((-score).alias("s"), F.col("name").alias("n"))))
    return zones.agg(
        F.count(F.lit(1)).alias("n_zones"),
        first.alias("top_zone"),
        F.max("neighborhood_score").alias("top_score"),
        F.min("avg_price").alias("min_avg_price"),
        half_even(F.avg("neighborhood_score"), 1).alias("avg_score"),
    )


def score_breakdown(zones: DataFrame) -> DataFrame:
    """Sub-scores times 100 in long form, each with the offset at which it is stacked."""
    a, t, p = (F.col(c) * 100 for c in SUBSCORES)
    zero = F.lit(0.0)
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("component"), half_even(v, 1).alias("value"), half_even(o, 1).alias("offset"))
            for n, v, o in (("affordability", a, zero), ("transit", t, a), ("parks", p, a + t))
        ]
    )
    return zones.select("name", "rank", F.explode(parts).alias("c")).select("name", "rank", "c.*")


def score_delta(zones: DataFrame) -> DataFrame:
    """Predicted against rule-based score, best prediction first."""
    delta = half_even(F.col("ml_score") - F.col("neighborhood_score"), 1)
    return zones.select("name", "neighborhood_score", "ml_score", "ml_rank", delta.alias("delta")).orderBy(
        F.desc("ml_score"), "name"
    )
