"""Stored column profiles that grow batch by batch.

A state has one row per column: counts, extremes, mean, squared deviations, a
quantile sketch (KLL) and a distinct-count sketch (HyperLogLog). The state of a new
batch is merged with the stored one, so what was profiled once is never scanned
again. Counts and extremes of merged states equal those of one pass, mean and
deviation up to rounding. Ranks from a quantile sketch are off by at most
``rank_error`` of the rows (with 99 % confidence), distinct counts by about
1.04 / 2^(DISTINCT_BITS / 2), 1.6 %; merging does not add to either.

Missing values (null and NaN) are counted and otherwise skipped; a column without
values has null statistics; an empty table gives states of zero rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import col

#: Size of the quantile sketches, and the base-2 logarithm of the registers of the distinct-count sketches.
SKETCH_SIZE, DISTINCT_BITS = 2_000, 12
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of the rows by which a sketch's rank can be off, 99 % of the time (published for KLL)."""
    return 2.296 / size**0.9021


def profile_state(df: DataFrame, columns: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """One row per column: feature, rows, known, minimum, maximum, mean, squares, quantiles, distinct.

    One pass that combines before its shuffle; ``squares`` are the summed squared deviations.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("value")) for c in columns])
    v = F.when(~F.isnan("s.value"), F.col("s.value"))
    long = df.select(F.explode(cells).alias("s")).select("s.feature", v.alias("value"))
    found = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("known"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("squares"),
        F.kll_sketch_agg_double("value", size).alias("quantiles"),
        F.hll_sketch_agg(F.when(F.col("value").isNotNull(), F.xxhash64(F.col("value") + 0.0)), DISTINCT_BITS).alias("distinct"),
    )
    # Columns of an empty table have a state, too.
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(found, "feature", "left").na.fill(0, ["rows", "known"])


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all batches together."""
    whole = reduce(DataFrame.unionByName, states)
    mean = F.try_divide(F.sum(F.col("mean") * F.col("known")), F.sum("known"))
    moments = F.collect_list(F.when(F.col("known") > 0, F.struct("known", "mean", "squares")))  # one per batch
    merged = whole.groupBy("feature").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        mean.alias("mean"),
        moments.alias("moments"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    # Squared deviations around the common mean: those of each batch and those of its mean.
    squares = F.aggregate(
        "moments", F.lit(0.0), lambda acc, m: acc + m["squares"] + m["known"] * (m["mean"] - F.col("mean")) * (m["mean"] - F.col("mean"))
    )
    out = merged.withColumn("squares", F.when(F.col("known") > 0, squares))
    return out.select("feature", "rows", "known", "minimum", "maximum", "mean", "squares", "quantiles", "distinct")


def describe_state(state: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """feature, rows, known, minimum, maximum, mean, deviation, n_distinct (about), and q_0.05 and so on."""
    some = F.col("known") > 0
    at = [
        F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(f"q_{q}") for q in quantiles
    ]
    return state.select(
        "feature", "rows", "known", "minimum", "maximum", "mean",
        F.sqrt(F.try_divide("squares", "known")).alias("deviation"),
        F.coalesce(F.when(some, F.hll_sketch_estimate("distinct")), F.lit(0)).alias("n_distinct"),
        *at,
    )


def state_drift(reference: DataFrame, current: DataFrame, points: int = 400) -> DataFrame:
    """feature, ks, ks_error, wasserstein, wasserstein_normed between two states, without their rows.

    Both distributions are read at ``points`` quantiles. The distance ``ks`` is off by at
    most ``ks_error``: a rank error and a step of the grid for each side.
    """
    grid = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    some = (F.col("r.known") > 0) & (F.col("c.known") > 0)
    both = reference.alias("r").join(current.alias("c"), F.col("r.feature") == F.col("c.feature"))
    read = both.where(some).select(
        F.col("r.feature").alias("feature"),
        F.kll_sketch_get_quantile_double("r.quantiles", grid).alias("rv"),
        F.kll_sketch_get_quantile_double("c.quantiles", grid).alias("cv"),
        F.sqrt(F.try_divide(F.col("r.squares"), F.col("r.known"))).alias("spread"),
    )
    # One row per column, with a fixed number of values.
    gaps = F.transform(
        F.array_distinct(F.concat("rv", "cv")),
        lambda v: F.abs(F.size(F.filter("rv", lambda x: x <= v)) - F.size(F.filter("cv", lambda x: x <= v))),
    )
    moved = F.aggregate(F.zip_with("rv", "cv", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / points
    found = read.select(
        "feature", (F.array_max(gaps) / points).alias("ks"),
        F.lit(2 * (rank_error() + 1 / points)).alias("ks_error"), moved.alias("wasserstein"), "spread",
    )
    named = reference.select("feature").join(found, "feature", "left")
    return named.select("feature", "ks", "ks_error", "wasserstein", F.try_divide("wasserstein", "spread").alias("wasserstein_normed"))
