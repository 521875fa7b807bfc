"""Steps of the saved model that Spark ML lacks: each can be written and read back.

A saved pipeline holds everything from plain offers to the score: the group
statistics and bins, the typed inputs, the rates of the categories, the trees.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import encode, features

# Missing numbers are treated as smaller than every real one.
MISSING = -1.0e12


def plain(name: str) -> str:
    """The name under which a model input is kept; Spark ML dislikes special characters."""
    return "f_" + name.replace("%", "pct")


class AuctionFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Group statistics, bins and quantiles of plain offers; other columns are carried along.

    The statistics are those of the table at hand, so an auction should be given
    whole. Offers without a complete auction key drop out, as they do in training.
    """

    def _transform(self, df: DataFrame) -> DataFrame:
        carried = [c for c in df.columns if c not in S.MODEL_FEATURES]
        return features.model_features(features.multiplier_defaults(df), carried)


class ModelInputs(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Strings for categories and doubles for the rest, next to the columns that are there."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = {}
        for name in S.MODEL_FEATURES:
            column = F.col(f"`{name}`")
            if name in S.CATEGORICAL_FEATURES:
                columns[plain(name)] = column.cast("string")
            elif name == "travel_date":
                columns[plain(name)] = F.unix_date(column.cast("date")).cast("double")
            else:
                columns[plain(name)] = F.coalesce(column.cast("double"), F.lit(MISSING))
        return df.withColumns(columns)


class _RatesWriter(MLWriter):
    def __init__(self, stage: "TargetRates") -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.rates.write.parquet(f"{path}/rates")


class _RatesReader(MLReader):
    def load(self, path: str) -> "TargetRates":
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = TargetRates(self.sparkSession.read.parquet(f"{path}/rates"))
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        return stage


class TargetRates(Model, MLWritable, MLReadable):
    """Adds the rate of each category; ``rates`` is a table, of any length, that is joined."""

    inputCol = Param(Params._dummy(), "inputCol", "the category", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "its rate", TypeConverters.toString)

    @keyword_only
    def _given(self, *, inputCol: str, outputCol: str) -> "TargetRates":
        return self._set(**self._input_kwargs)

    def __init__(self, rates: DataFrame) -> None:
        super().__init__()
        self.rates = rates

    @staticmethod
    def of(rates: DataFrame, category: str, out: str) -> "TargetRates":
        return TargetRates(rates)._given(inputCol=category, outputCol=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        return encode.with_target_rates(df, self.rates, self.getOrDefault("inputCol"), self.getOrDefault("outputCol"))

    def write(self) -> MLWriter:
        return _RatesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RatesReader()
