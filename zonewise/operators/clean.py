"""Cleaning of the four layers. Every step is a narrow transformation, so a whole cleaning is one stage over the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import geometry as G
from ..functions.crs import assert_wgs84, crs_of, with_crs
from ..functions.numeric import half_even, to_number
from . import validity
from .stats import percentiles
from .workset import BROADCAST_ROWS, Scratch, settle


def standardise_columns(df: DataFrame) -> DataFrame:
    """Lower case, trimmed, blanks to underscores; two columns must not end up with one name."""
    names = [c.lower().strip().replace(" ", "_") for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after standardising: {twice}")
    return df.withColumnsRenamed({c: n for c, n in zip(df.columns, names) if c != n})


def clip_to_bbox(df: DataFrame, bbox=settings.BBOX, label: str = "layer") -> DataFrame:
    """Points strictly inside the box, polygons that do not leave it (touching its edge is fine).

    Bounds that a layer brings along as ``bbox`` (see ``layers.read_geoparquet``) are filtered first, which reaches the scan: only
    the rows that are left are decoded and looked at. The column ends here.
    """
    assert_wgs84(df, label)
    x0, y0, x1, y1 = (F.lit(float(v)) for v in bbox)
    if G.has_bounds(df):
        cover = {b: F.col(f"bbox.{b}") for b in G.BOUNDS}
        df = df.filter((cover["xmin"] <= x1) & (cover["ymin"] <= y1) & (cover["xmax"] >= x0) & (cover["ymax"] >= y0)).drop("bbox")
    if "geometry" in df.columns:
        b = G.bbox(F.col("geometry"))
        return df.filter((b["xmin"] >= x0) & (b["ymin"] >= y0) & (b["xmax"] <= x1) & (b["ymax"] <= y1))
    lon, lat = F.col("lon"), F.col("lat")
    return df.filter((lon > x0) & (lon < x1) & (lat > y0) & (lat < y1))


def drop_invalid(df: DataFrame, long_shapes: bool = False) -> DataFrame:
    """Drop null, empty and invalid geometries; for points, null or NaN coordinates.

    ``long_shapes`` judges geometries of very many vertices by joins instead of within their row (see ``validity``); it settles the layer.
    """
    if "geometry" in df.columns and long_shapes:
        with Scratch(df.sparkSession) as scratch:
            return scratch.keep(validity.judged(df, scratch).filter("_valid").drop("_valid"))
    if "geometry" in df.columns:
        return df.filter(G.is_valid(F.col("geometry")))
    return df.filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    )


def keep_known(df: DataFrame, column: str, known) -> DataFrame:
    """Rows whose name is listed, NULL never. ``known`` is a short list or a table with a ``name`` column."""
    if isinstance(known, DataFrame):
        names = known.select(F.col("name").alias(column)).distinct()
        return df.join(names, column, "left_semi")
    return df.filter(F.col(column).isin(list(known)))


def price_bounds(df: DataFrame, low: float = settings.PRICE_MIN, high: float = settings.PRICE_MAX) -> DataFrame:
    """Prices strictly between the bounds; text that is no number drops out."""
    price = to_number(F.col("transaction_price"))
    return df.withColumn("transaction_price", price).filter(
        (F.col("transaction_price") > low) & (F.col("transaction_price") < high)
    )


def price_features(df: DataFrame) -> DataFrame:
    """Keep positive areas and add price_per_m2 and log_price."""
    area = to_number(F.col("area_m2"))
    df = df.withColumn("area_m2", area).filter(F.col("area_m2") > 0)
    return df.withColumns(
        {
            "price_per_m2": half_even(F.col("transaction_price") / F.col("area_m2")),
            "log_price": F.log1p("transaction_price"),
        }
    )


def transactions(df: DataFrame, known=settings.MUNICIPALITIES, bbox=settings.BBOX) -> DataFrame:
    """Transactions with a position in the area, a known zone, a plausible price and a positive area."""
    assert_wgs84(df, "transactions")
    df = clip_to_bbox(drop_invalid(standardise_columns(df)), bbox, "transactions")
    if "neighborhood" in df.columns:
        df = keep_known(df, "neighborhood", known)
    if "transaction_price" in df.columns:
        df = price_bounds(df)
        if "area_m2" in df.columns:
            df = price_features(df)
    essential = [c for c in ("transaction_price", "neighborhood") if c in df.columns]
    return df.dropna(subset=essential) if essential else df


def zones(df: DataFrame, known=settings.MUNICIPALITIES) -> DataFrame:
    """Valid polygons with a known name. Not clipped and not deduplicated."""
    assert_wgs84(df, "zones")
    df = standardise_columns(df)
    if "name" not in df.columns:
        raise ValueError("zones need a 'name' column")
    return keep_known(drop_invalid(df), "name", known)


def stops(df: DataFrame, bbox=settings.BBOX) -> DataFrame:
    """Stops inside the area; the type is 'unknown' where the whole column is missing."""
    assert_wgs84(df, "transit_stops")
    df = clip_to_bbox(drop_invalid(standardise_columns(df)), bbox, "transit_stops")
    return df if "stop_type" in df.columns else df.withColumn("stop_type", F.lit("unknown"))


def parks(df: DataFrame, bbox=settings.BBOX) -> DataFrame:
    """Parks inside the area as points. Polygons are clipped as polygons and become their centroid."""
    assert_wgs84(df, "parks")
    crs = crs_of(df)
    df = clip_to_bbox(drop_invalid(standardise_columns(df)), bbox, "parks")
    if "geometry" in df.columns:
        # the struct is a column of its own, so that both coordinates come from one evaluation
        df = df.withColumn("_c", G.centroid(F.col("geometry"))).withColumns({"lon": F.col("_c.x"), "lat": F.col("_c.y")})
        df = with_crs(df.drop("geometry", "_c"), crs)
    return df


# opt-in steps ---------------------------------------------------------------------------------------------------------


def _sized(groups: DataFrame) -> DataFrame:
    """One row per group, broadcast if counted to be few: the rows of a large group then stay where they are."""
    groups = settle(groups)
    return F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups


def clip_group_percentiles(
    df: DataFrame, column: str = "transaction_price", by: str = "neighborhood", low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Keep values between two exact percentiles of their group, bounds included."""
    bounds = percentiles(df.filter(F.col(by).isNotNull()), [by], column, {"_low": low, "_high": high})
    return df.join(_sized(bounds), by).filter(F.col(column).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def impute_group_median(df: DataFrame, column: str = "rooms", by: str = "neighborhood") -> DataFrame:
    """Fill missing values with the exact median of the group."""
    medians = percentiles(df.filter(F.col(by).isNotNull()), [by], column, {"_mid": 0.5})
    return df.join(_sized(medians), by, "left").withColumn(column, F.coalesce(column, "_mid")).drop("_mid")


def dedupe(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop duplicate rows, or rows that repeat the given columns."""
    return df.dropDuplicates(keys) if keys else df.distinct()
