"""Spark ML transformers of the engine: a quality check and a missing-value normaliser."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .columns import normalise_missing
from .operators import missing


class QualityError(ValueError):
    """The table does not meet the completeness asked for."""


class NormaliseMissing(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """NaN to null, as a pipeline stage."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return normalise_missing(dataset)


class QualityCheck(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Passes a table on unchanged, or fails if its completeness score is below the least."""

    least = Param(Params._dummy(), "least", "least completeness score, 0 to 100", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, least: float = 80.0):
        super().__init__()
        self._setDefault(least=80.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = missing.score(normalise_missing(dataset)).first()["score"]
        if score < self.getOrDefault(self.least):
            raise QualityError(f"completeness score {score} is below {self.getOrDefault(self.least)}")
        return dataset
