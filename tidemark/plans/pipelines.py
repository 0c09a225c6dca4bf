"""Configurable pipelines: step configuration -> pyspark.ml Pipeline, with save and load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
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

from tidemark.operators.anomaly import spot_run
from tidemark.operators.forecast import fit_forecaster, predict_forecaster
from tidemark.schema import SERIES
from tidemark.session import scratch_path


class _ScalerParams(HasInputCol):
    withMean = Param(Params._dummy(), "withMean", "centre", TypeConverters.toBoolean)
    withStd = Param(Params._dummy(), "withStd", "scale", TypeConverters.toBoolean)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scaling of one column by the population deviation."""

    @keyword_only
    def __init__(self, *, inputCol=None, withMean=True, withStd=True):
        super().__init__()
        self._set(inputCol=inputCol, withMean=withMean, withStd=withStd)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        col = self.getInputCol()
        mean, std = df.agg(F.avg(col), F.stddev_pop(col)).first()
        model = PopulationScalerModel()
        model._set(
            inputCol=col, withMean=self.getOrDefault("withMean"),
            withStd=self.getOrDefault("withStd"), mean=float(mean or 0.0),
            std=float(std) if std else 1.0,
        )
        return model


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "fitted mean", TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "fitted deviation", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getInputCol()
        out = F.col(col).cast("double")
        if self.getOrDefault("withMean"):
            out = out - self.getOrDefault("mean")
        if self.getOrDefault("withStd"):
            out = out / self.getOrDefault("std")
        # scaled columns come first, the others pass through
        return df.select(out.alias(col), *[c for c in df.columns if c != col])


class _ThresholdParams(HasInputCol):
    threshold = Param(Params._dummy(), "threshold", "z-score limit", TypeConverters.toFloat)


class ZScoreThreshold(Estimator, _ThresholdParams, DefaultParamsReadable, DefaultParamsWritable):
    """z-score detector of one residual column."""

    @keyword_only
    def __init__(self, *, inputCol="residual", threshold=3.0):
        super().__init__()
        self._set(inputCol=inputCol, threshold=float(threshold))

    def _fit(self, df: DataFrame) -> ZScoreThresholdModel:
        col = self.getInputCol()
        mean, std = df.agg(F.avg(col), F.stddev_pop(col)).first()
        model = ZScoreThresholdModel()
        model._set(
            inputCol=col, threshold=self.getOrDefault("threshold"), mean=float(mean or 0.0),
            std=float(std or 0.0),
        )
        return model


class ZScoreThresholdModel(Model, _ThresholdParams, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "fitted mean", TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "fitted deviation", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.try_divide(
            F.col(self.getInputCol()) - self.getOrDefault("mean"), F.lit(self.getOrDefault("std"))
        )
        return df.withColumn("z", z).withColumn(
            "is_anomaly", F.coalesce(F.abs("z") > self.getOrDefault("threshold"), F.lit(False))
        )


class SpotDetector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Peaks-over-threshold detector of keyed series; calibrates on each series' first rows."""

    nInit = Param(Params._dummy(), "nInit", "calibration rows", TypeConverters.toInt)
    q = Param(Params._dummy(), "q", "risk", TypeConverters.toFloat)
    level = Param(Params._dummy(), "level", "initial quantile", TypeConverters.toFloat)
    withAlarm = Param(Params._dummy(), "withAlarm", "keep alarms out", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, nInit=168, q=1e-4, level=0.98, withAlarm=True):
        super().__init__()
        self._set(nInit=nInit, q=float(q), level=float(level), withAlarm=withAlarm)

    def _transform(self, df: DataFrame) -> DataFrame:
        return spot_run(df, *[self.getOrDefault(p) for p in ("nInit", "q", "level", "withAlarm")])


class SeriesForecaster(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Trend-and-seasonality forecaster of keyed series (ds, y); the model is a table."""

    changepointPriorScale = Param(Params._dummy(), "changepointPriorScale", "trend flexibility", TypeConverters.toFloat)
    changepointRange = Param(Params._dummy(), "changepointRange", "share with changepoints", TypeConverters.toFloat)
    seasonalityPriorScale = Param(Params._dummy(), "seasonalityPriorScale", "season strength", TypeConverters.toFloat)
    seasonalityMode = Param(Params._dummy(), "seasonalityMode", "additive or multiplicative", TypeConverters.toString)
    weekend = Param(Params._dummy(), "weekend", "separate weekend shape", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, changepointPriorScale=0.05, changepointRange=0.8, seasonalityPriorScale=10.0,
        seasonalityMode="additive", weekend=False,
    ):
        super().__init__()
        self._set(
            changepointPriorScale=float(changepointPriorScale),
            changepointRange=float(changepointRange),
            seasonalityPriorScale=float(seasonalityPriorScale),
            seasonalityMode=seasonalityMode, weekend=weekend,
        )

    def _fit(self, df: DataFrame) -> SeriesForecasterModel:
        grid = [
            {
                "p_id": "fixed",
                "changepoint_prior_scale": self.getOrDefault("changepointPriorScale"),
                "changepoint_range": self.getOrDefault("changepointRange"),
                "seasonality_prior_scale": self.getOrDefault("seasonalityPriorScale"),
                "seasonality_mode": self.getOrDefault("seasonalityMode"),
                "weekend": self.getOrDefault("weekend"),
            }
        ]
        path = scratch_path(df.sparkSession, "forecaster")
        fit_forecaster(df, grid).write.parquet(path)
        model = SeriesForecasterModel()
        model._set(modelPath=path)
        return model


class _ForecasterWriter(MLWriter):
    """Metadata and, beside it, a copy of the coefficient table."""

    def __init__(self, model: SeriesForecasterModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        source = self.model.getOrDefault("modelPath")
        if source.startswith(path.rstrip("/") + "/"):
            raise ValueError(f"{path} holds this model's own coefficients; save it elsewhere")
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.read.parquet(source).write.parquet(f"{path}/coefficients")


class _ForecasterReader(MLReader):
    def load(self, path: str) -> SeriesForecasterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = SeriesForecasterModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(modelPath=f"{path}/coefficients")


class SeriesForecasterModel(Model, MLReadable, MLWritable):
    """The coefficients are a table: in the shared folder after a fit, inside the saved model after a
    load, so that a saved pipeline needs nothing but its own folder."""

    modelPath = Param(Params._dummy(), "modelPath", "coefficient table", TypeConverters.toString)

    def write(self) -> MLWriter:
        return _ForecasterWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForecasterReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        models = df.sparkSession.read.parquet(self.getOrDefault("modelPath"))
        return predict_forecaster(df.select(*SERIES, "ds"), models)


# Step names and parameter names of existing step configurations.
_STEPS: dict[str, Callable] = {
    "StandardScaler": PopulationScaler,
    "ZscoreEstimator": ZScoreThreshold,
    "SPOT": SpotDetector,
    "Prophet": SeriesForecaster,
}
_RENAMED = {
    "column": "inputCol",
    "with_mean": "withMean",
    "with_std": "withStd",
    "n_init": "nInit",
    "with_alarm": "withAlarm",
    "changepoint_prior_scale": "changepointPriorScale",
    "changepoint_range": "changepointRange",
    "seasonality_prior_scale": "seasonalityPriorScale",
    "seasonality_mode": "seasonalityMode",
}
_IGNORED = {"copy"}  # has no meaning for immutable frames


def register_step(name: str, factory: Callable) -> None:
    """Make a user-defined stage available to ``build_pipeline``."""
    _STEPS[name] = factory


def typed(value):
    """Configuration values may arrive as text; give them their type."""
    if not isinstance(value, str):
        return value
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for cast in (int, float):
        try:
            return cast(value)
        except ValueError:
            continue
    return value


def build_pipeline(config: dict | list[dict]) -> Pipeline:
    """``{step, column?, params: [{key, value}] | {..}}`` (or a list of them) -> Pipeline."""
    if isinstance(config, dict):
        config = config.get("steps", [config])
    stages = []
    for step in config:
        name = step["step"]
        if name not in _STEPS:
            raise ValueError(f"unknown step {name!r}; known: {sorted(_STEPS)}")
        params = step.get("params", {})
        if isinstance(params, list):
            params = {p["key"]: p["value"] for p in params}
        params = {k: v for k, v in params.items() if k not in _IGNORED}
        if "column" in step:
            params["column"] = step["column"]
        stages.append(_STEPS[name](**{_RENAMED.get(k, k): typed(v) for k, v in params.items()}))
    return Pipeline(stages=stages)


def save_pipeline(pipeline: Pipeline | PipelineModel, path: str) -> None:
    pipeline.write().overwrite().save(path)


def load_pipeline(path: str, trained: bool) -> Pipeline | PipelineModel:
    return PipelineModel.load(path) if trained else Pipeline.load(path)


def apply_per_series(
    df: DataFrame, fn: Callable, schema: str, keys: list[str] = SERIES
) -> DataFrame:
    """Run a user's pandas function on every series; the declared schema must keep the keys."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
