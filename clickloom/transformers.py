"""pyspark.ml Transformers over the cleaning operators, for use in a Pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .operators import clean


class _Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


class SelectCommerciallyViableCustomers(_Step):
    """Clicks of visitors who bought something."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean.buyers_clicks(df)


class Sessionizer(_Step):
    """SessionId by gaps in a visitor's clicks."""

    gap = Param(Params._dummy(), "gap", "seconds from which a click opens a session", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gap: int = 1200) -> None:
        super().__init__()
        self._setDefault(gap=1200)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean.sessionize(df, self.getOrDefault(self.gap))


class MostRecentSessionItem(_Step):
    """The last click of each session and item."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean.latest_clicks(df)


class MinimumColumnSupport(_Step, HasInputCol):
    """Rows whose value occurs often enough."""

    min_support = Param(Params._dummy(), "min_support", "least occurrences of a value", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, min_support: int = 1) -> None:
        super().__init__()
        self._setDefault(min_support=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean.min_support(df, self.getInputCol(), self.getOrDefault(self.min_support))


class DeIdentifyColumn(_Step, HasInputCol, HasOutputCol):
    """A dense number for each value of a column, in their order."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.join(clean.dense_ids(df, self.getInputCol(), self.getOutputCol()), self.getInputCol())
