"""Completeness filters, imputation, low-variation filter, outlier removal.

Each step is one aggregate job whose small result (column names, fill values,
limits) is applied as plain expressions.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskframe.functions.expr import (
    INF,
    bool_to_int,
    chunks,
    col,
    combine,
    finite,
    nan_to_null,
    numeric_columns,
    string_columns,
    to_double,
)
from riskframe.operators.ranks import CELL_LIMIT, exact_quantiles

AGG_WIDTH = 200


def completeness(df: DataFrame) -> dict[str, float]:
    """Share of non-missing rows per column, in percent."""
    result: dict[str, float] = {}
    for part in chunks(df.columns, AGG_WIDTH):
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(str(i)) for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            result[c] = 100.0 * row[str(i)] / row["n"] if row["n"] else 100.0
    return result


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_present, completeness) as a table, without a driver step."""
    columns = df.columns if columns is None else list(columns)
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(c) for c in columns])
    return counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("n_present"), "__n") for c in columns])
        ).alias("s")
    ).select(
        "s.column",
        "s.n_present",
        F.when(F.col("s.__n") > 0, 100.0 * F.col("s.n_present") / F.col("s.__n")).alias("completeness"),
    )


def drop_sparse_columns(df: DataFrame, target: str, threshold: float) -> DataFrame:
    sparse = [c for c, share in completeness(df).items() if share < threshold and c != target]
    return df.drop(*sparse)


def drop_sparse_rows(df: DataFrame, threshold: float) -> DataFrame:
    """Drop rows filled below half the threshold over all remaining columns."""
    filled = combine([col(c).isNotNull().cast("int") for c in df.columns], operator.add)
    return df.where(F.lit(100.0) * filled / F.lit(len(df.columns)) >= F.lit(threshold * 0.5))


def fill_values(df: DataFrame, columns: Sequence[str], how: str, cell_limit: int = CELL_LIMIT) -> dict[str, float]:
    if how == "median":
        medians = exact_quantiles(df, columns, [0.5], cell_limit)
        return {c: v[0] for c, v in medians.items() if v[0] is not None}
    if how == "mean":
        result = {}
        for part in chunks(list(columns), AGG_WIDTH):
            row = df.agg(*[nan_to_null(F.avg(col(c))).alias(str(i)) for i, c in enumerate(part)]).first()
            result.update({c: row[i] for i, c in enumerate(part) if row[i] is not None})
        return result
    if how == "zero":
        return {c: 0.0 for c in columns}
    raise ValueError(f"no such way to fill in values: {how!r}")


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Fill missing cells; an integer column becomes double when its fill is fractional."""
    types = {f.name: f.dataType for f in df.schema.fields}
    filled = {}
    for name, value in values.items():
        if isinstance(types[name], T.IntegralType) and float(value).is_integer():
            filled[name] = F.coalesce(col(name), F.lit(int(value)).cast(types[name]))
        else:
            filled[name] = F.coalesce(col(name).cast("double"), F.lit(float(value)))
    return df.withColumns(filled)


def impute(
    df: DataFrame, target: str, how: str = "median", fit_on: DataFrame | None = None, cell_limit: int = CELL_LIMIT
) -> DataFrame:
    """Fill numeric non-target columns.

    The values are taken from all rows, rows without a label included; pass
    the labelled rows as ``fit_on`` to keep the others out.
    """
    filled = completeness(df)
    columns = [c for c in numeric_columns(df, [target]) if filled[c] < 100.0]
    return fill(df, fill_values(fit_on if fit_on is not None else df, columns, how, cell_limit))


def variation(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Sample std / abs(mean) per column; undefined or infinite counts as 0."""
    result: dict[str, float] = {}
    for part in chunks(list(columns), AGG_WIDTH // 2):
        row = df.agg(
            *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(part)],
            *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(part)],
        ).first()
        for i, c in enumerate(part):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            usable = mean not in (None, 0.0) and std is not None and std == std and abs(mean) < INF
            result[c] = std / abs(mean) if usable else 0.0
    return result


def drop_low_variation(df: DataFrame, target: str, threshold: float | None) -> DataFrame:
    if threshold is None or threshold <= 0:
        return df
    cvs = variation(df, numeric_columns(df, [target]))
    return df.drop(*[c for c, cv in cvs.items() if cv <= threshold])


def clean_target(df: DataFrame, target: str) -> DataFrame:
    if target not in df.columns:
        return df
    return df.where(col(target).isNotNull()).withColumn(target, col(target).cast("int"))


def clean_and_impute(
    df: DataFrame,
    target: str = "TARGET",
    threshold: float = 85,
    how: str = "median",
    cv_threshold: float | None = 0.01,
) -> DataFrame:
    """Column filter, row filter, imputation, variation filter, target clean-up, in this order."""
    df = bool_to_int(df)
    df = drop_sparse_columns(df, target, threshold)
    df = drop_sparse_rows(df, threshold)
    df = impute(df, target, how)
    df = drop_low_variation(df, target, cv_threshold)
    return clean_target(df, target)


def remove_outliers(
    df: DataFrame, percent: float, target: str = "TARGET", cell_limit: int = CELL_LIMIT
) -> DataFrame:
    """Drop rows with a feature strictly outside its two-sided quantiles.

    Limits are taken over rows without a missing feature, and only such rows
    are ever dropped. Without any complete row the result is empty.
    """
    features = [c for c in df.columns if c != target]
    if not features:
        return df
    text = set(string_columns(df))
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    parsed = {c: to_double(col(c)) if c in text else col(c).cast("double") for c in features}
    complete = combine(
        [parsed[c].isNotNull() & ~F.isnan(col(c)) if c in floating else parsed[c].isNotNull() for c in features],
        operator.and_,
    )
    fitted = df.where(complete).select(*[parsed[c].alias(c) for c in features])
    limits = exact_quantiles(fitted, features, [percent / 100, (100 - percent) / 100], cell_limit)
    if all(v[0] is None for v in limits.values()):
        return df.where(F.lit(False))
    outside = combine([~parsed[c].between(*limits[c]) for c in features], operator.or_)
    return df.where(~(complete & outside))


def sanitize(df: DataFrame, keep: Sequence[str] = (), cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Numeric columns only; infinities and missing become this frame's median."""
    columns = numeric_columns(df, keep)
    df = df.select(*[col(k) for k in keep], *[finite(nan_to_null(col(c).cast("double"))).alias(c) for c in columns])
    return fill(df, fill_values(df, columns, "median", cell_limit))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.select(col(target), "n", (F.col("n") / F.sum("n").over(everything)).alias("share"))


def positive_share(df: DataFrame, target: str) -> float:
    value = df.agg(F.avg(col(target).cast("double"))).first()[0]
    return 0.0 if value is None else float(value)
