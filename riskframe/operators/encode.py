"""Category encoders: first-appearance codes and one-hot columns.

Fitting one-hot columns returns a small schema decision (the categories); applying
it is a projection. There, a column with more than ``MAX_CATEGORIES`` distinct
values is refused, since it cannot become that many output columns. Codes have
no such limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.expr import col, string_columns
from riskframe.session import materialize

MAX_CATEGORIES = 5_000


def categories(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct non-missing values of every string column, in one job."""
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns])
    rows = (
        df.select(F.explode(cells).alias("s"))
        .select("s.c", "s.v")
        .where(F.col("v").isNotNull())
        .distinct()
        .limit(limit * len(columns) + 1)
        .collect()
    )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        found[row["c"]].append(row["v"])
    for name, values in found.items():
        if len(values) > limit:
            raise ValueError(f"column {name!r} has more than {limit} categories")
    return {c: sorted(v) for c, v in found.items()}


def dummy_columns(cats: Mapping[str, Sequence[str]], null_category: bool) -> dict[str, Column]:
    """Output name -> 0/1 expression."""
    result: dict[str, Column] = {}
    for name, values in cats.items():
        for v in values:
            result[f"{name}_{v}"] = F.when(col(name) == F.lit(v), 1).otherwise(0)
        if null_category:
            result[f"{name}_nan"] = col(name).isNull().cast("int")
    return result


def one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    null_category: bool = False,
    cats: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace string columns by one 0/1 column per value (missing = all 0).

    Kept columns come first, then the new ones per source column in value
    order. With ``null_category`` a ``<column>_nan`` column is always added.
    """
    cats = categories(df, columns) if cats is None else cats
    rest = [col(c) for c in df.columns if c not in cats]
    return df.select(*rest, *[e.alias(n) for n, e in dummy_columns(cats, null_category).items()])


def factorize(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Replace each column by its code: 0.. by first appearance in ``order_by``, missing -1.

    The categories are dealt into stored ranges by first appearance and numbered
    inside each range, so neither one task nor a broadcast grows with their number.
    """
    for name in columns:
        firsts = (
            df.where(col(name).isNotNull())
            .groupBy(col(name).alias("__value"))
            .agg(F.min(F.struct(*[col(o) for o in order_by])).alias("__first"))
        )
        ranged = materialize(
            firsts.repartitionByRange("__first").withColumn("__part", F.spark_partition_id()), "categories"
        )
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        # One row per range.
        offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select(
            "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset")
        )
        inside = F.row_number().over(Window.partitionBy("__part").orderBy("__first")) - 1
        codes = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").select(
            "__value", (F.col("__inside") + F.col("__offset")).cast("int").alias("__code")
        )
        # Stored, so that adaptive execution chooses the join from the real size and can split a frequent value.
        codes = materialize(codes, "codes")
        position = df.columns
        df = (
            df.join(codes, col(name) == F.col("__value"), "left")
            .withColumn(name, F.coalesce(F.col("__code"), F.lit(-1)))
            .select(*[col(c) for c in position])
        )
    return df
