"""The scorer and the score model as stages of a Spark ML pipeline, which can be saved and loaded.

``SuitabilityStage`` learns the extremes of the three features and scores zones; ``PredictedScoreStage`` fits a regression of the
scores and predicts them. What they learn is small: six numbers, or the fitted Spark ML stages and the scale of their columns.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, scoring


class _HasWeights(Params):
    weights = Param(Params._dummy(), "weights", "affordability, transit, parks; they sum to 1", TypeConverters.toListFloat)

    def getWeights(self) -> scoring.Weights:  # noqa: N802 (the library's way of naming)
        return scoring.Weights(*self.getOrDefault(self.weights))


class SuitabilityStage(Estimator, _HasWeights, DefaultParamsWritable, DefaultParamsReadable):
    """Learns the extremes of the scaled features."""

    @keyword_only
    def __init__(self, *, weights: list[float] | None = None):
        super().__init__()
        usual = scoring.Weights()
        self._setDefault(weights=[usual.affordability, usual.transit, usual.parks])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "SuitabilityStageModel":
        row = scoring.SuitabilityScorer(self.getWeights()).fit(dataset).limits.first()
        # a feature without any value has no extremes
        limits = [math.nan if row[c] is None else float(row[c]) for c in scoring.LIMITS]
        return self._copyValues(SuitabilityStageModel()._set(limits=limits))


class SuitabilityStageModel(Model, _HasWeights, DefaultParamsWritable, DefaultParamsReadable):
    """Adds sub-scores, score and rank."""

    limits = Param(Params._dummy(), "limits", "smallest and largest value of each feature", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = [F.lit(None if math.isnan(v) else v).cast("double").alias(c) for c, v in zip(scoring.LIMITS, self.getOrDefault(self.limits), strict=True)]
        limits = dataset.sparkSession.range(1).select(*values)
        return scoring.SuitabilityModel(limits, self.getWeights()).transform(dataset)


class PredictedScoreStage(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """Fits one of the regressions (``models.KINDS``) of the suitability score."""

    kind = Param(Params._dummy(), "kind", "which regression", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind: str = "random_forest"):
        super().__init__()
        self._setDefault(kind="random_forest")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PredictedScoreStageModel":
        chosen = self.getOrDefault(self.kind)
        if chosen not in models.KINDS:
            raise ValueError(f"kind is one of {sorted(models.KINDS)}")
        return PredictedScoreStageModel(models.ScoreModel(models.KINDS[chosen]()).fit(dataset))


class PredictedScoreStageModel(Model, MLWritable, MLReadable):
    """Adds the predicted score and its rank."""

    def __init__(self, scores: models.ScoreModel):
        super().__init__()
        self.scores = scores

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.scores.transform(dataset)

    def write(self) -> MLWriter:
        return _ScoreWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScoreReader()


class _ScoreWriter(MLWriter):
    def __init__(self, instance: PredictedScoreStageModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        fitted = self.instance.scores.fitted
        told = {"names": self.instance.scores.names, "importances": fitted.importances, "scale": fitted.scale, "shift": fitted.shift}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=told)
        fitted.stages.write().save(f"{path}/stages")


class _ScoreReader(MLReader):
    def load(self, path: str) -> PredictedScoreStageModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        fitted = models.Fitted(PipelineModel.load(f"{path}/stages"), told["scale"], told["shift"], told["importances"])
        model = PredictedScoreStageModel(models.ScoreModel.of(fitted, told["names"]))
        model._resetUid(told["uid"])
        return model
