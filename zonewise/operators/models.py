"""Regression on zone features: leave-one-out comparison, fitted predictions, importances.

Baseline and ridge are cross-validated exactly from sums over all zones: leaving a zone out only subtracts its own
contribution, so no model is refitted. Tree ensembles use Spark ML and fold columns. One argument names the kind of
cross-validation for all models, and the result carries it.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.crs import assert_wgs84, require_columns
from ..functions.numeric import half_even
from .recommend import recommend
from .scoring import composite, rank_by
from .stats import long_form, percentiles
from .workset import settle

# Feature columns and target.
RAW_FEATURES = [
    "avg_price",
    "avg_price_per_m2",
    "avg_rooms",
    "avg_area_m2",
    "transaction_count",
    "dist_to_nearest_transit_m",
    "dist_to_nearest_park_m",
    "transit_stops_500m",
    "transit_stops_1km",
    "parks_1km",
]
TARGET = "neighborhood_score"
# Rows per partition of the tables that models are fitted on, many times each.
FIT_ROWS = 50_000
_COMPOSITES = {
    "transit_composite": ("dist_to_nearest_transit_m", "transit_stops_500m"),
    "park_composite": ("dist_to_nearest_park_m", "parks_1km"),
}
_NEGLIGIBLE = 1e-10


def features(zones: DataFrame, whole: bool = False) -> tuple[DataFrame, list[str]]:
    """Zones with complete double feature columns, and their names; ``whole`` keeps the row itself beside them as ``_row``.

    Gaps take the median over the given zones; a column without any value is no feature.
    """
    assert_wgs84(zones, "zones")
    columns = {c: F.col(c).cast("double") for c in RAW_FEATURES if c in zones.columns}
    for name, (distance, count) in _COMPOSITES.items():
        if distance in columns and count in columns:
            columns[name] = composite(columns[distance], columns[count])
    centre = G.metric_centroid(F.col("geometry"))
    columns["centroid_x"], columns["centroid_y"] = centre["x"], centre["y"]
    kept = [c for c in ("name", TARGET) if c in zones.columns]
    if whole:
        kept = ["_row"]
        zones = zones.select("*", F.struct(*zones.columns).alias("_row"))
    table = zones.select(*kept, *[v.alias(f"f_{c}") for c, v in columns.items()])
    middle = percentiles(long_form(table, [f"f_{c}" for c in columns], []), ["column"], "value", {"m": 0.5})
    medians = {r["column"][2:]: r["m"] for r in middle.collect()}  # one row per feature
    names = [c for c in columns if c in medians]
    return table.select(*kept, *[F.coalesce(f"f_{c}", F.lit(medians[c])).alias(c) for c in names]), names


def _labelled(zones: DataFrame) -> None:
    require_columns(zones, [TARGET], "zones")


def loo_baseline(zones: DataFrame, target: str = TARGET) -> DataFrame:
    """Each zone predicted by the mean of the others: (name, actual, predicted)."""
    total = zones.agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    return zones.crossJoin(F.broadcast(total)).select(
        "name",
        F.col(target).alias("actual"),
        ((F.col("_sum") - F.col(target)) / (F.col("_n") - 1)).alias("predicted"),
    )


def loo_ridge(table: DataFrame, names: list[str], target: str = TARGET, alpha: float = 1.0) -> DataFrame:
    """Each zone predicted by standardised ridge regression on the others: (name, actual, predicted).

    One pass sums x, xx', xy and y; a task then subtracts a row from the sums and solves the small system for it.
    """
    first = table.agg(
        F.avg(target).alias("y"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    d = len(names)
    # centred and scaled once over all rows, which keeps the later subtractions well conditioned
    centre = np.array([first[f"m{i}"] for i in range(d)])
    spread = np.array([first[f"s{i}"] or 1.0 for i in range(d)])
    y0 = first["y"]
    z = [(F.col(c) - F.lit(float(centre[i]))) / F.lit(float(spread[i])) for i, c in enumerate(names)]
    y = F.col(target) - F.lit(y0)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("y"),
        *[F.sum(z[i]).alias(f"x{i}") for i in range(d)],
        *[F.sum(z[i] * y).alias(f"xy{i}") for i in range(d)],
        *[F.sum(z[i] * z[j]).alias(f"xx{i}_{j}") for i, j in pairs],
    ).first()
    n, sy = sums["n"], sums["y"]
    sx = np.array([sums[f"x{i}"] for i in range(d)])
    sxy = np.array([sums[f"xy{i}"] for i in range(d)])
    sxx = np.zeros((d, d))
    for i, j in pairs:
        sxx[i, j] = sxx[j, i] = sums[f"xx{i}_{j}"]

    def solve(batches):
        for batch in batches:
            x = (batch[names].to_numpy(float) - centre) / spread
            t = batch[target].to_numpy(float) - y0
            m = n - 1
            mean = (sx - x) / m
            mean_y = (sy - t) / m
            cov = (sxx - x[:, :, None] * x[:, None, :]) / m - mean[:, :, None] * mean[:, None, :]
            cov_y = (sxy - x * t[:, None]) / m - mean * mean_y[:, None]
            var = np.einsum("bii->bi", cov)
            sd = np.where(var > _NEGLIGIBLE, np.sqrt(np.abs(var)), 1.0)
            gram = m * cov / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(d)
            beta = np.linalg.solve(gram, (m * cov_y / sd)[:, :, None])[:, :, 0]
            predicted = y0 + mean_y + (beta * (x - mean) / sd).sum(axis=1)
            yield pd.DataFrame({"name": batch["name"], "actual": batch[target], "predicted": predicted})

    return table.select("name", F.col(target).cast("double").alias(target), *names).mapInPandas(
        solve, "name string, actual double, predicted double"
    )


class Fitted:
    """Fitted Spark ML stages behind the scaling of their columns; called with a table it adds the prediction ``_p``."""

    def __init__(self, stages, scale: dict[str, float], shift: float = 0.0, importances: dict[str, float] | None = None):
        self.stages, self.scale, self.shift, self.importances = stages, scale, shift, importances

    def scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_z_{c}": F.col(c) / F.lit(v) for c, v in self.scale.items()})

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(self.scaled(df)).withColumn("_p", F.col("_p") + F.lit(self.shift))


class Ridge:
    """Ridge regression on columns scaled to unit population deviation, with the penalty of the plain sum of squares."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, data: DataFrame, names: list[str], target: str):
        row = data.agg(
            F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sy"),
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)],
        ).first()
        # a constant column is zero once standardised and only makes the system singular
        scale = {c: row[f"s{i}"] for i, c in enumerate(names) if row[f"s{i}"]}
        # the solver standardises the label, hence the factor of its deviation
        strength = self.alpha / row["n"] * (row["sy"] or 1.0)
        solver = LinearRegression(
            featuresCol="_x", labelCol=target, predictionCol="_p", solver="normal", standardization=False, regParam=strength
        )
        assembler = VectorAssembler(inputCols=[f"_z_{c}" for c in scale], outputCol="_x")
        zs = Fitted(None, scale).scaled
        fitted = Fitted(Pipeline(stages=[assembler, solver]).fit(zs(data)), scale)
        return fitted, None


class Trees:
    """A Spark ML regressor; boosting starts from the mean of the label."""

    def __init__(self, estimator: Estimator, centred: bool = False):
        self.estimator, self.centred = estimator, centred

    def fit(self, data: DataFrame, names: list[str], target: str):
        shift = data.agg(F.avg(target)).first()[0] if self.centred else 0.0
        stages = [
            VectorAssembler(inputCols=names, outputCol="_x"),
            self.estimator.copy({p: v for p, v in self._columns().items()}),
        ]
        model = Pipeline(stages=stages).fit(data.withColumn("_y", F.col(target).cast("double") - F.lit(shift)))
        importances = getattr(model.stages[-1], "featureImportances", None)
        if importances is not None:
            importances = dict(zip(names, (float(v) for v in importances.toArray())))
        return Fitted(model, {}, shift, importances), importances

    def _columns(self):
        e = self.estimator
        return {e.featuresCol: "_x", e.labelCol: "_y", e.predictionCol: "_p"}


def random_forest() -> Trees:
    return Trees(
        RandomForestRegressor(
            numTrees=100, maxDepth=3, featureSubsetStrategy="all", subsamplingRate=1.0, seed=42, cacheNodeIds=False
        )
    )


def gradient_boosting() -> Trees:
    return Trees(GBTRegressor(maxIter=50, maxDepth=2, stepSize=0.1, seed=42), centred=True)


# The regressions by name.
KINDS = {"random_forest": random_forest, "gradient_boosting": gradient_boosting, "ridge": Ridge}


class Mean:
    """Predicts the mean of the rows it was fitted on."""

    def fit(self, data: DataFrame, names: list[str], target: str):
        mean = data.agg(F.avg(target)).first()[0]
        return lambda df: df.withColumn("_p", F.lit(mean)), None


def _folds(table: DataFrame, cv: str | int) -> DataFrame:
    """A fold per row: its own for "loo", else one of ``cv`` by the row's hash."""
    if cv == "loo":
        return table.withColumn("_fold", F.monotonically_increasing_id())
    if not isinstance(cv, int) or cv < 2:
        raise ValueError('cv is "loo" or a number of folds')
    return table.withColumn("_fold", F.pmod(F.xxhash64(*table.columns), F.lit(cv)).cast("long"))


def cross_validate(model, table: DataFrame, names: list[str], cv: str | int = "loo", threads: int = 8) -> DataFrame:
    """Out-of-fold predictions: (name, actual, predicted). Folds are fitted from concurrent driver threads.

    Leaving one out fits as many models as there are rows; choose a number of folds for tables of many rows.
    """
    split = settle(_folds(table, cv))
    present = sorted(r[0] for r in split.select("_fold").distinct().collect())  # as many values as models to fit
    split = split.coalesce(-(-split.count() // FIT_ROWS))

    def one(fold):
        predict, _ = model.fit(split.filter(F.col("_fold") != fold), names, TARGET)
        out = predict(split.filter(F.col("_fold") == fold))
        return out.select("name", F.col(TARGET).cast("double").alias("actual"), F.col("_p").alias("predicted"))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, present))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metrics(predictions: DataFrame, model: str, cv: str | int = "loo") -> DataFrame:
    """One row: model, kind of cross-validation, mean and population deviation of the absolute error, and R² over all predictions together."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    residual = F.sum((F.col("actual") - F.col("predicted")) ** 2)
    total = F.var_pop("actual") * F.count("actual")
    return predictions.agg(
        F.lit(model).alias("model"),
        F.lit(str(cv)).alias("cv"),
        half_even(F.avg(error), 2).alias("mae"),
        half_even(F.stddev_pop(error), 2).alias("mae_std"),
        half_even(1 - residual / F.when(total > 0, total), 3).alias("r2_pooled"),
    )


def _by_sums(table: DataFrame, names: list[str], cv, exact, model) -> DataFrame:
    """Leave-one-out has a closed form for the mean and for ridge; folds are fitted."""
    return exact() if cv == "loo" else cross_validate(model, table, names, cv)


CANDIDATES = {
    "Baseline (mean)": lambda table, names, cv: _by_sums(table, names, cv, lambda: loo_baseline(table), Mean()),
    "Ridge Regression": lambda table, names, cv: _by_sums(table, names, cv, lambda: loo_ridge(table, names), Ridge()),
    "Random Forest": lambda table, names, cv: cross_validate(random_forest(), table, names, cv),
    "Gradient Boosting": lambda table, names, cv: cross_validate(gradient_boosting(), table, names, cv),
}

LINEAR = {name: CANDIDATES[name] for name in ("Baseline (mean)", "Ridge Regression")}


def compare_models(zones: DataFrame, cv: str | int = "loo", candidates=CANDIDATES) -> DataFrame:
    """Error of each model under the same cross-validation ("loo" or a number of folds), best first."""
    _labelled(zones)
    table, names = features(zones)
    table = settle(table)
    rows = [metrics(predict(table, names, cv), name, cv) for name, predict in candidates.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return settle(out).orderBy("mae", "model")


def improvement(comparison: DataFrame) -> DataFrame:
    """How much the best model improves on the baseline's error."""
    baseline = F.max(F.when(F.col("model") == "Baseline (mean)", F.col("mae")))
    return comparison.agg(
        baseline.alias("baseline_mae"),
        F.min("mae").alias("best_mae"),
        half_even(baseline - F.min("mae"), 2).alias("improvement"),
    )


class ScoreModel:
    """Predicts the suitability score. ``model`` may be any object whose ``fit`` is like that of ``Trees``,
    or a Spark ML regressor."""

    def __init__(self, model=None):
        self.model = Trees(model) if isinstance(model, Estimator) else (model or random_forest())
        self._predict = None
        self._names: list[str] = []
        self._importances: dict[str, float] | None = None

    @classmethod
    def of(cls, fitted: Fitted, names: list[str]) -> "ScoreModel":
        """A model that has been fitted before."""
        model = cls()
        model._predict, model._names, model._importances = fitted, list(names), fitted.importances
        return model

    @property
    def fitted(self):
        return self._predict

    @property
    def names(self) -> list[str]:
        return self._names

    def fit(self, zones: DataFrame) -> "ScoreModel":
        _labelled(zones)
        table, self._names = features(zones)
        table = settle(table)
        table = table.coalesce(max(1, -(-table.count() // FIT_ROWS)))
        self._predict, self._importances = self.model.fit(table, self._names, TARGET)
        return self

    def transform(self, zones: DataFrame) -> DataFrame:
        """Add ml_score (0..100, one place) and ml_rank."""
        if self._predict is None:
            raise RuntimeError("call fit() before transform()")
        table, names = features(zones, whole=True)
        lost = [c for c in self._names if c not in names]
        if lost:
            raise ValueError(f"features without any value: {lost}")
        score = half_even(F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(100.0)), 1)
        # predicted on the row itself: names may repeat or be missing
        return rank_by(self._predict(table).select("_row.*", score.alias("ml_score")), "ml_score", "ml_rank")

    def fit_transform(self, zones: DataFrame) -> DataFrame:
        return self.fit(zones).transform(zones)

    def importances(self, spark) -> DataFrame | None:
        """(feature, importance), largest first; None for models without importances."""
        if self._importances is None:
            return None
        rows = list(self._importances.items())
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def run(scored: DataFrame, cv: str | int = "loo", model=None, candidates=CANDIDATES) -> dict[str, DataFrame | None]:
    """Model comparison, predicted scores, recommendations and importances (None for a model without them) of scored zones."""
    model = ScoreModel(model)
    predicted = settle(model.fit_transform(scored))
    return {
        "comparison": compare_models(scored, cv, candidates),
        "scores": predicted.select("name", TARGET, "ml_score", "ml_rank"),
        "recommendations": recommend(predicted),
        "importances": model.importances(scored.sparkSession),
    }
