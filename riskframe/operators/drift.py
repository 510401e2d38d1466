"""Two-sample drift statistics per column.

All statistics come from counts per (feature, value, side); the numeric ones
read them in value order through ranged running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.expr import col
from riskframe.functions.tails import chi_square_tail, kolmogorov_tail, normal_tails
from riskframe.operators.ranks import running_counts, to_long, with_buckets

SIDE = "side"
REFERENCE, CURRENT = "reference", "current"
# ---- Fixed values: how a column's test is chosen, and the limits ----
SMALL_ROWS, FEW_VALUES = 1_000, 5
LEVEL, DISTANCE_LIMIT = 0.05, 0.1
# ---------------------------------------------------------------------


def drift_inputs(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both sides in one frame with a side label."""
    return reference.withColumn(SIDE, F.lit(REFERENCE)).unionByName(
        current.withColumn(SIDE, F.lit(CURRENT)), allowMissingColumns=True
    )


def _is(side: str):
    return (F.col(SIDE) == side).cast("long")


def drift_numeric(sides: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """(feature, n_reference, n_current, ks, wasserstein, wasserstein_normed)."""
    counts = (
        to_long(sides, columns, [SIDE])
        .groupBy("feature", "value")
        .agg(F.sum(_is(REFERENCE)).alias("r"), F.sum(_is(CURRENT)).alias("c"))
    )
    counts, buckets = with_buckets(counts, buckets)
    placed = running_counts(counts, ["feature"], "value", ["r", "c"], buckets, next_value="next")
    # One row per feature.
    totals = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    placed = placed.join(F.broadcast(totals), "feature")
    gap = F.abs(
        F.try_divide(F.col("r_below") + F.col("r"), F.col("nr"))
        - F.try_divide(F.col("c_below") + F.col("c"), F.col("nc"))
    )
    stats = placed.groupBy("feature").agg(
        F.first("nr").alias("n_reference"),
        F.first("nc").alias("n_current"),
        F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next") - F.col("value"))).alias("wasserstein"),
    )
    spread = (
        to_long(sides.where(F.col(SIDE) == REFERENCE), columns)
        .groupBy("feature")
        .agg(F.stddev_pop("value").alias("spread"))
    )
    return stats.join(F.broadcast(spread), "feature", "left").select(
        "feature",
        "n_reference",
        "n_current",
        "ks",
        "wasserstein",
        F.try_divide(F.col("wasserstein"), F.col("spread")).alias("wasserstein_normed"),
    )


def drift_categorical(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_values, chi_square, js_distance, psi) of the value shares.

    PSI is summed over values present on both sides.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns])
    counts = (
        sides.select(SIDE, F.explode(cells).alias("s"))
        .where(F.col("s.value").isNotNull())
        .groupBy(F.col("s.feature").alias("feature"), F.col("s.value").alias("value"))
        .agg(F.sum(_is(REFERENCE)).alias("r"), F.sum(_is(CURRENT)).alias("c"))
    )
    totals = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    both = counts.join(F.broadcast(totals), "feature")
    p, q = F.try_divide("r", "nr"), F.try_divide("c", "nc")
    mean = (p + q) / 2
    row = F.col("r") + F.col("c")
    expected_r = row * F.col("nr") / (F.col("nr") + F.col("nc"))
    expected_c = row * F.col("nc") / (F.col("nr") + F.col("nc"))
    chi = F.try_divide((F.col("r") - expected_r) ** 2, expected_r) + F.try_divide(
        (F.col("c") - expected_c) ** 2, expected_c
    )
    js = F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)
    psi = F.when((p > 0) & (q > 0), (q - p) * F.log(q / p)).otherwise(0.0)
    return both.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sum(chi).alias("chi_square"),
        F.sqrt(F.greatest(F.sum(js) / 2, F.lit(0.0))).alias("js_distance"),
        F.sum(psi).alias("psi"),
    )


def drift_report(
    sides: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    numeric_limit: float = 0.1,
    categorical_limit: float = 0.1,
) -> DataFrame:
    """(feature, kind, statistic, score, drifted, drifted_share) over all columns."""
    parts = []
    if numeric:
        parts.append(
            drift_numeric(sides, numeric).select(
                "feature",
                F.lit("numeric").alias("kind"),
                F.lit("wasserstein_normed").alias("statistic"),
                F.col("wasserstein_normed").alias("score"),
                F.coalesce((F.col("wasserstein_normed") >= numeric_limit).cast("int"), F.lit(0)).alias("drifted"),
            )
        )
    if categorical:
        parts.append(
            drift_categorical(sides, categorical).select(
                "feature",
                F.lit("categorical").alias("kind"),
                F.lit("js_distance").alias("statistic"),
                F.col("js_distance").alias("score"),
                (F.col("js_distance") >= categorical_limit).cast("int").alias("drifted"),
            )
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    # One row per column.
    return report.withColumn("drifted_share", F.avg("drifted").over(Window.partitionBy()))


def _value_counts(sides: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values per column, counted up to one more than matters; one row of numbers."""
    row = sides.agg(*[F.approx_count_distinct(col(c), 0.01).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    unsure = [c for i, c in enumerate(columns) if row[f"n{i}"] <= 4 * FEW_VALUES]
    exact = sides.agg(*[F.count_distinct(col(c)).alias(c) for c in unsure]).first() if unsure else {}
    return {c: exact[c] if c in unsure else row[f"n{i}"] for i, c in enumerate(columns)}


def drift_tests(
    sides: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    small_rows: int = SMALL_ROWS,
    few_values: int = FEW_VALUES,
    level: float = LEVEL,
    limit: float = DISTANCE_LIMIT,
) -> DataFrame:
    """One row per column with the test that suits it.

    (feature, kind, test, statistic, p_value, score, drifted). A numeric column with
    at most ``few_values`` values is treated as a categorical one. Up to ``small_rows``
    reference rows a column drifts when the p-value of its test is below ``level``:
    Kolmogorov-Smirnov for numbers, the difference of two shares (z) for two categories,
    chi-square for more. Above, the p-value is still given, and the column drifts when its
    distance ``score`` (normed Wasserstein or Jensen-Shannon) reaches ``limit``. A column
    without rows on one side has no p-value and does not drift.
    """
    values = _value_counts(sides, numeric) if numeric else {}
    continuous = [c for c in numeric if values[c] > few_values]
    counted = [c for c in numeric if values[c] <= few_values] + list(categorical)
    parts = []
    if continuous:
        found = drift_numeric(sides, continuous)
        parts.append(
            found.select(
                "feature",
                F.lit("numeric").alias("kind"),
                F.lit("kolmogorov_smirnov").alias("small_test"),
                F.col("ks").alias("statistic"),
                kolmogorov_tail(F.col("ks"), F.col("n_reference"), F.col("n_current")).alias("p_value"),
                F.lit("wasserstein_normed").alias("large_test"),
                F.col("wasserstein_normed").alias("score"),
                "n_reference",
            )
        )
    if counted:
        found = drift_categorical(sides, counted)
        sizes = sides.agg(*[F.sum(F.when(col(c).isNotNull(), _is(s))).alias(f"{s}{i}") for i, c in enumerate(counted) for s in (REFERENCE, CURRENT)])
        listed = [F.struct(F.lit(c).alias("feature"), F.col(f"{REFERENCE}{i}").alias("n_reference"), F.col(f"{CURRENT}{i}").alias("n_current")) for i, c in enumerate(counted)]
        # One row per column.
        found = found.join(F.broadcast(sizes.select(F.inline(F.array(*listed)))), "feature")
        both = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
        # The squared z of two shares is the chi-square statistic of the 2 x 2 table.
        z = F.sqrt("chi_square")
        binary = F.col("n_values") <= 2
        p = F.when(F.col("n_values") == 1, 1.0).when(binary, normal_tails(z)).otherwise(chi_square_tail(F.col("chi_square"), F.col("n_values") - 1))
        parts.append(
            found.select(
                "feature",
                F.lit("categorical").alias("kind"),
                F.when(binary, "share_difference").otherwise("chi_square").alias("small_test"),
                F.when(binary, z).otherwise(F.col("chi_square")).alias("statistic"),
                F.when(both, p).alias("p_value"),
                F.lit("js_distance").alias("large_test"),
                F.when(both, F.col("js_distance")).alias("score"),
                "n_reference",
            )
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    few = F.col("n_reference") <= small_rows
    drifted = F.when(few, F.col("p_value") < level).otherwise(F.col("score") >= limit)
    return table.select(
        "feature",
        "kind",
        F.when(few, F.col("small_test")).otherwise(F.col("large_test")).alias("test"),
        "statistic",
        "p_value",
        "score",
        F.coalesce(drifted, F.lit(False)).cast("int").alias("drifted"),
    )
