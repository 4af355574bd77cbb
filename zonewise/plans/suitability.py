"""The whole way from four raw layers to ranked zones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import settings
from ..operators import clean, features, scoring
from ..operators.workset import settle


def enriched_zones(
    zones: DataFrame, transactions: DataFrame, stops: DataFrame, parks: DataFrame, known=settings.MUNICIPALITIES
) -> DataFrame:
    """Cleaned zones with spatial features and transaction statistics, written once."""
    spatial = features.zone_spatial(clean.zones(zones, known), clean.stops(stops), clean.parks(parks))
    return settle(features.attach_stats(spatial, clean.transactions(transactions, known)))


def scored_zones(
    zones: DataFrame,
    transactions: DataFrame,
    stops: DataFrame,
    parks: DataFrame,
    known=settings.MUNICIPALITIES,
    weights: scoring.Weights | None = None,
) -> DataFrame:
    """Ranked zones."""
    return scoring.run(enriched_zones(zones, transactions, stops, parks, known), weights)
