"""Population profiles and distributions behind the dashboard views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import chunks, col, label_text, numeric_columns
from riskframe.operators.ranks import exact_quantiles, few_labels, label_quantiles, ranked_cells

CATEGORY_LIMIT = 10


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, kind, minimum, maximum, median, is_constant): one row per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    medians = exact_quantiles(df, columns, [0.5])
    kinds = dict(df.dtypes)
    rows = []
    for part in chunks(columns, 100):
        row = df.agg(
            *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(part)],
            *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(part)],
        ).first()
        for i, c in enumerate(part):
            low, high = row[f"a{i}"], row[f"b{i}"]
            rows.append((c, kinds[c], low, high, medians[c][0], int(low == high)))
    return df.sparkSession.createDataFrame(
        rows, "feature string, kind string, minimum double, maximum double, median double, is_constant int"
    )


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """(feature, n_distinct, is_categorical, distinct_values); the values only below ``limit``."""
    columns = df.columns if columns is None else list(columns)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns])
    distinct = (
        df.select(F.explode(cells).alias("s"))
        .select("s.feature", "s.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    counted = distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    few = counted.where(F.col("n_distinct") < limit)
    values = (
        distinct.join(F.broadcast(few.select("feature")), "feature", "left_semi")
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list("value")).alias("distinct_values"))
    )
    return counted.join(F.broadcast(values), "feature", "left").select(
        "feature", "n_distinct", (F.col("n_distinct") < limit).cast("int").alias("is_categorical"), "distinct_values"
    )


def histogram(
    df: DataFrame, feature: str, target: str, bins: int = 20, only: int | None = None
) -> DataFrame:
    """(bin, bin_start, bin_end, target, n): equal-width counts, split by class."""
    shown = df.where(col(feature).isNotNull())
    if only is not None:
        shown = shown.where(col(target) == only)
    low, high = shown.agg(F.min(col(feature)).cast("double"), F.max(col(feature)).cast("double")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.floor((col(feature) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        shown.groupBy(place.alias("bin"), col(target).alias(target))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "bin_start": F.lit(low) + F.col("bin") * F.lit(width),
                "bin_end": F.lit(low) + (F.col("bin") + 1) * F.lit(width),
            }
        )
    )


def _bounded(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def box_stats(df: DataFrame, category: str, value: str, target: str) -> DataFrame:
    """Five-number summary and 1.5 IQR whiskers per category and class.

    The category has few values by definition, so groups are large; quantiles
    come from ranged running counts, not from one task per group.
    """
    group = ["category", "status"]
    shown = df.select(
        col(category).cast("string").alias("category"),
        label_text(col(target)).alias("status"),
        col(value).cast("double").alias("y"),
    ).where(F.col("y").isNotNull() & F.col("status").isNotNull() & F.col("category").isNotNull())
    boxes = label_quantiles(shown, group, "y", [0.0, 0.25, 0.5, 0.75, 1.0]).select(
        *group,
        "n",
        F.col("q0").alias("minimum"),
        F.col("q1").alias("lower_quartile"),
        F.col("q2").alias("median"),
        F.col("q3").alias("upper_quartile"),
        F.col("q4").alias("maximum"),
    )
    few = few_labels(shown, group)
    reach = 1.5 * (F.col("upper_quartile") - F.col("lower_quartile"))
    whiskers = (
        shown.join(_bounded(boxes.select(*group, "lower_quartile", "upper_quartile"), few), group)
        .groupBy(*group)
        .agg(
            F.min(F.when(F.col("y") >= F.col("lower_quartile") - reach, F.col("y"))).alias("lower_whisker"),
            F.max(F.when(F.col("y") <= F.col("upper_quartile") + reach, F.col("y"))).alias("upper_whisker"),
        )
    )
    return boxes.join(whiskers, group)


def scatter(df: DataFrame, key: str, x: str, y: str, target: str, only: int | None = None) -> DataFrame:
    """(key, x, y, status) of all rows, or of one class."""
    shown = df if only is None else df.where(col(target) == only)
    return shown.select(
        col(key), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), label_text(col(target)).alias("status")
    )


def position(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, value, share_at_or_below) for every row and column."""
    rows = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    totals = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, rows[i])])
    return ranked_cells(df, key, columns).select(
        col(key),
        "feature",
        "value",
        F.try_divide(F.col("n_below") + F.col("n"), F.element_at(totals, F.col("feature"))).alias("share_at_or_below"),
    )


def lookup(df: DataFrame, key: str, value=None, columns: Sequence[str] | None = None) -> DataFrame:
    """One client's record, or the column medians when no client is given."""
    columns = numeric_columns(df, [key]) if columns is None else list(columns)
    if value is not None:
        wanted: Column = col(key) == F.lit(value)
        return df.where(wanted).select(col(key), *[col(c).cast("double").alias(c) for c in columns])
    medians = exact_quantiles(df, columns, [0.5])
    row = tuple([None, *[medians[c][0] for c in columns]])
    schema = df.select(col(key)).schema
    for c in columns:
        schema = schema.add(c, "double")
    return df.sparkSession.createDataFrame([row], schema)
