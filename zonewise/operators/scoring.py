"""Suitability scores: three features scaled to 0..1, weighted, ranked.

Statistics over all zones are one-row tables joined by broadcast; medians and ranks come from counted distinct values. No step
sorts or holds all zones in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..functions.crs import require_columns
from ..functions.numeric import half_even
from .stats import percentiles
from .workset import BROADCAST_ROWS, settle

# Column names of the features and sub-scores.
REQUIRED = ["avg_price", "dist_to_nearest_transit_m", "dist_to_nearest_park_m", "transit_stops_500m", "parks_1km"]
SUBSCORES = ["score_affordability", "score_transit", "score_parks"]
_F = ["_price", "_transit", "_park"]
LIMITS = [f"{f}_{m}" for f in _F for m in ("min", "max")]


@dataclass(frozen=True)
class Weights:
    affordability: float = settings.WEIGHTS["affordability"]
    transit: float = settings.WEIGHTS["transit"]
    parks: float = settings.WEIGHTS["parks"]

    def __post_init__(self):
        total = self.affordability + self.transit + self.parks
        # a sum counts as one within an absolute 1e-6 plus a relative 1e-5
        if not math.isfinite(total) or abs(total - 1.0) > 1e-6 + 1e-5:
            raise ValueError(f"weights must sum to 1, got {total:.4f}")

    @classmethod
    def from_percent(cls, transit: int, parks: int) -> "Weights":
        """Affordability takes what the two percentages leave."""
        if transit + parks > 100:
            raise ValueError(f"transit ({transit}) and parks ({parks}) exceed 100 percent")
        t, p = transit / 100, parks / 100
        return cls(round(1.0 - t - p, 4), round(t, 4), round(p, 4))


def composite(distance: Column, count: Column) -> Column:
    """Closeness plus the raw count; the distance only breaks ties between equal counts."""
    return F.lit(1.0) / (F.lit(1.0) + distance) + count


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table beside every row."""
    return df.crossJoin(F.broadcast(row))


def _features(df: DataFrame) -> DataFrame:
    """The three scaled features; gaps take the median price, the largest distance, no count."""
    fill = df.agg(F.max("dist_to_nearest_transit_m").alias("_far_t"), F.max("dist_to_nearest_park_m").alias("_far_p"))
    fill = _with_row(fill, percentiles(df, [], "avg_price", {"_mid": 0.5}))
    zero = F.lit(0)
    return (
        _with_row(df, fill)
        .withColumns(
            {
                "_price": F.coalesce("avg_price", "_mid").cast("double"),
                "_transit": composite(
                    F.coalesce("dist_to_nearest_transit_m", "_far_t"), F.coalesce("transit_stops_500m", zero)
                ),
                "_park": composite(F.coalesce("dist_to_nearest_park_m", "_far_p"), F.coalesce("parks_1km", zero)),
            }
        )
        .drop("_mid", "_far_t", "_far_p")
    )


def rank_by(df: DataFrame, score: str, rank: str = "rank") -> DataFrame:
    """Competition rank, highest first; NULL scores get no rank.

    Equal scores are counted. If the counted scores are few, one window adds them up and the ranks are broadcast; else they are
    sorted by range over all tasks, only the sums per task (one row each) meet in one place, and the rank is joined on the score.
    """
    counts = settle(df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n")))
    if counts.count() <= BROADCAST_ROWS:
        better = F.sum("_n").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1))
        ranks = counts.select("_s", (F.coalesce(better, F.lit(0)) + 1).cast("int").alias(rank))
        return df.join(F.broadcast(ranks), F.col(score) == F.col("_s"), "left").drop("_s")
    ranged = settle(counts.repartitionByRange(F.desc("_s")).withColumn("_task", F.spark_partition_id()))
    above = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = ranged.groupBy("_task").agg(F.sum("_n").alias("_in"))
    tasks = tasks.withColumn("_before", F.coalesce(F.sum("_in").over(above), F.lit(0)))
    inside = Window.partitionBy("_task").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1
    ranks = ranged.join(F.broadcast(tasks.select("_task", "_before")), "_task").select("_s", place.cast("int").alias(rank))
    return df.join(ranks, F.col(score) == F.col("_s"), "left").drop("_s")


def _scale(value: str, low: str, high: str) -> Column:
    span = F.col(high) - F.col(low)
    return (F.col(value) - F.col(low)) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def _weighted(a, t, p) -> Column:
    s = [F.col(c) for c in SUBSCORES]
    return half_even((s[0] * a + s[1] * t + s[2] * p) * 100.0, 1)


class SuitabilityModel:
    """Scaling learned from one set of zones, applicable to another."""

    def __init__(self, limits: DataFrame, weights: Weights):
        self.limits, self.weights = limits, weights

    def subscores(self, zones: DataFrame) -> DataFrame:
        require_columns(zones, REQUIRED, "zones")
        df = _with_row(_features(zones), self.limits)
        scaled = [_scale(f, f"{f}_min", f"{f}_max") for f in _F]
        df = df.withColumns(
            {
                SUBSCORES[0]: half_even(F.lit(1.0) - scaled[0], 4),
                SUBSCORES[1]: half_even(scaled[1], 4),
                SUBSCORES[2]: half_even(scaled[2], 4),
            }
        )
        return df.drop(*_F, *LIMITS)

    def transform(self, zones: DataFrame) -> DataFrame:
        w = self.weights
        scored = self.subscores(zones).withColumn(
            "neighborhood_score", _weighted(F.lit(w.affordability), F.lit(w.transit), F.lit(w.parks))
        )
        return rank_by(scored, "neighborhood_score")


class SuitabilityScorer:
    """``fit`` learns the extremes of the three features, the model it returns scores zones."""

    def __init__(self, weights: Weights | None = None):
        self.weights = weights or Weights()
        self.model: SuitabilityModel | None = None

    def fit(self, zones: DataFrame) -> SuitabilityModel:
        require_columns(zones, REQUIRED, "zones")
        limits = _features(zones).agg(
            *[fn(f).alias(f"{f}_{m}") for f in _F for fn, m in ((F.min, "min"), (F.max, "max"))]
        )
        self.model = SuitabilityModel(limits, self.weights)
        return self.model

    def transform(self, zones: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("call fit() before transform()")
        return self.model.transform(zones)

    def fit_transform(self, zones: DataFrame) -> DataFrame:
        return self.fit(zones).transform(zones)


def run(zones: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Fit and score in one go."""
    return SuitabilityScorer(weights).fit_transform(zones)


def filter_by_budget(zones: DataFrame, budget: float, column: str = "avg_price") -> DataFrame:
    """Zones within the budget; all zones if none is. Ranks stay as they were."""
    any_within = zones.agg(F.coalesce(F.min(column) <= budget, F.lit(False)).alias("_any"))
    return _with_row(zones, any_within).filter((F.col(column) <= budget) | ~F.col("_any")).drop("_any")


def weight_table(spark, scenarios: dict[str, tuple[float, float, float]] = settings.SCENARIOS) -> DataFrame:
    """Scenario weights as a table; each has to be a valid weight vector."""
    rows = []
    for name, (a, t, p) in scenarios.items():
        w = Weights(a, t, p)
        rows.append((name, w.affordability, w.transit, w.parks))
    return spark.createDataFrame(rows, "scenario string, w_a double, w_t double, w_p double")


def score_scenarios(
    zones: DataFrame, scenarios: dict[str, tuple[float, float, float]] = settings.SCENARIOS, keep: tuple[str, ...] = ("name",)
) -> DataFrame:
    """One score per zone and scenario, from a single scaling pass; ``keep`` names the columns that tell zones apart."""
    table = weight_table(zones.sparkSession, scenarios)
    scaled = SuitabilityScorer().fit(zones).subscores(zones)
    return scaled.crossJoin(F.broadcast(table)).select(
        *keep, "scenario", _weighted(F.col("w_a"), F.col("w_t"), F.col("w_p")).alias("neighborhood_score")
    )


def compare_scenarios(
    zones: DataFrame, scenarios: dict[str, tuple[float, float, float]] = settings.SCENARIOS, keep: tuple[str, ...] = ("name",)
) -> DataFrame:
    """Zones by scenarios matrix of scores: a row per zone, whatever its name, and nothing is grouped."""
    scaled = SuitabilityScorer().fit(zones).subscores(zones)
    weights = {name: Weights(*w) for name, w in scenarios.items()}
    cell = lambda w: _weighted(F.lit(w.affordability), F.lit(w.transit), F.lit(w.parks))
    return scaled.select(*keep, *[cell(w).alias(name) for name, w in weights.items()])
