"""The coordinate system of a layer, kept in column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import METRIC_CRS, STORAGE_CRS
from . import geometry as G
from .projection import unproject

_CARRIERS = ("geometry", "lon", "lat")


def with_crs(df: DataFrame, crs: str) -> DataFrame:
    """Declare the coordinate system; coordinates are left as they are."""
    return df.withColumns(
        {c: F.col(c).alias(c, metadata={**df.schema[c].metadata, "crs": crs}) for c in _CARRIERS if c in df.columns}
    )


def crs_of(df: DataFrame) -> str | None:
    found = {df.schema[c].metadata.get("crs") for c in _CARRIERS if c in df.columns}
    return found.pop() if len(found) == 1 else None


def assert_wgs84(df: DataFrame, label: str = "layer") -> None:
    crs = crs_of(df)
    if crs is None:
        raise ValueError(f"{label} has no CRS, expected {STORAGE_CRS}")
    if crs != STORAGE_CRS:
        raise ValueError(f"{label} is in {crs}, expected {STORAGE_CRS}; call to_wgs84() first")


def to_wgs84(df: DataFrame, crs: str | None = None) -> DataFrame:
    """Bring a layer to degrees. ``crs`` declares the system of a layer that carries none."""
    crs = crs or crs_of(df)
    if crs is None:
        raise ValueError("layer has no CRS; pass crs= to declare it")
    if crs == STORAGE_CRS:
        return with_crs(df, crs)
    if crs != METRIC_CRS:
        raise ValueError(f"no conversion from {crs}")
    changed = {}
    if "geometry" in df.columns:
        changed["geometry"] = G.to_degrees(F.col("geometry"))
    if "lon" in df.columns:
        changed["lon"], changed["lat"] = unproject(F.col("lon"), F.col("lat"))
    return with_crs(df.withColumns(changed), STORAGE_CRS)


def require_columns(df: DataFrame, columns, label: str = "layer") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}; available {df.columns}")
