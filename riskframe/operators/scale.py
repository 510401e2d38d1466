"""Column scalers with population deviation, exact quartiles and safe constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import chunks, col
from riskframe.operators.ranks import exact_quantiles

SCALERS = ("standard", "minmax", "robust", "none")


def fit_scaler(df: DataFrame, columns: Sequence[str], how: str) -> dict[str, tuple[float, float]]:
    """(centre, width) per column; a constant column has width 1, so it becomes 0."""
    if how not in SCALERS:
        raise ValueError(f"no scaling named {how!r}")
    columns = list(columns)
    fitted: dict[str, tuple[float, float]] = {}
    if how == "none":
        fitted = {c: (0.0, 1.0) for c in columns}
    elif how == "robust":
        for c, (q1, q2, q3) in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
            fitted[c] = (q2, q3 - q1) if q2 is not None else (0.0, 1.0)
    else:
        for part in chunks(columns, 100):
            first, second = (F.avg, F.stddev_pop) if how == "standard" else (F.min, F.max)
            row = df.agg(
                *[first(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(part)],
                *[second(col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(part)],
            ).first()
            for i, c in enumerate(part):
                a, b = row[f"a{i}"], row[f"b{i}"]
                if a is None:
                    fitted[c] = (0.0, 1.0)
                else:
                    fitted[c] = (a, b) if how == "standard" else (a, b - a)
    # Numerical noise of a constant column must not be blown up.
    return {c: (m, w if w > 1e-12 * max(1.0, abs(m)) else 1.0) for c, (m, w) in fitted.items()}


def apply_scaler(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (col(c) - F.lit(m)) / F.lit(w) for c, (m, w) in fitted.items()})


def scale(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str], how: str) -> list[DataFrame]:
    """Fit on ``train`` only, apply to it and to the others."""
    fitted = fit_scaler(train, columns, how)
    return [apply_scaler(df, fitted) for df in [train, *others]]


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of scaled features", TypeConverters.toString)
    how = Param(Params._dummy(), "how", "standard, minmax, robust or none", TypeConverters.toString)
    centres = Param(Params._dummy(), "centres", "fitted centres", TypeConverters.toListFloat)
    widths = Param(Params._dummy(), "widths", "fitted widths", TypeConverters.toListFloat)


class ColumnScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Scale numeric columns and assemble them into one vector."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", how="standard"):
        super().__init__()
        self._setDefault(outputCol="features", how="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ColumnScalerModel":
        columns = self.getOrDefault("inputCols")
        fitted = fit_scaler(dataset, columns, self.getOrDefault("how"))
        model = ColumnScalerModel()
        model._set(
            inputCols=columns,
            outputCol=self.getOrDefault("outputCol"),
            how=self.getOrDefault("how"),
            centres=[float(fitted[c][0]) for c in columns],
            widths=[float(fitted[c][1]) for c in columns],
        )
        return model


class ColumnScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getOrDefault("inputCols")
        centres, widths = self.getOrDefault("centres"), self.getOrDefault("widths")
        scaled = [
            (col(c).cast("double") - F.lit(m)) / F.lit(w) for c, m, w in zip(columns, centres, widths)
        ]
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*scaled)))
