"""Feature contributions of fitted models, and their summaries.

Tree ensembles have path-dependent Shapley values (see ``attribution``), logistic
regressions the closed form.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.expr import col
from riskframe.operators.attribution import base_values, path_trees, tree_shapley
from riskframe.operators.boosting import BoostedModel
from riskframe.operators.models import feature_list

#: Entries (row and feature) that one task sorts, about.
TASK_ENTRIES = 500_000


def contributions(model: PipelineModel | BoostedModel, df: DataFrame, key: str) -> DataFrame:
    """(key, class, feature, value, contribution, base) for every row, class and feature.

    ``value`` is the scaled value the classifier sees. Probabilities are
    explained for a forest, log-odds for boosting and logistic regression.
    """
    features = feature_list(model)
    if isinstance(model, BoostedModel):
        fitted = model
        scaled = df.select(col(key), F.array(*[col(f).cast("double") for f in features]).alias("x"))
    else:
        scaler, fitted = model.stages[0], model.stages[-1]
        scaled = scaler.transform(df).select(col(key), vector_to_array(F.col("__features")).alias("x"))
    if isinstance(fitted, LogisticRegressionModel):
        # Scaled train features have mean 0, so the closed form is coefficient times value.
        coef = [float(v) for v in fitted.coefficients]
        parts = F.zip_with("x", F.array(*[F.lit(v) for v in coef]), lambda v, c: v * c)
        per_class = scaled.select(
            col(key),
            "x",
            F.explode(F.array(F.struct(F.lit(0).alias("class"), F.lit(-1.0).alias("sign")),
                              F.struct(F.lit(1).alias("class"), F.lit(1.0).alias("sign")))).alias("k"),
            parts.alias("parts"),
        ).select(
            col(key),
            F.col("k.class").alias("class"),
            "x",
            F.transform("parts", lambda v: v * F.col("k.sign")).alias("phi"),
            (F.col("k.sign") * F.lit(float(fitted.intercept))).alias("base"),
        )
    else:
        spark = df.sparkSession
        trees, constant = path_trees(fitted, spark)
        base = base_values(trees, constant)
        shared = spark.sparkContext.broadcast(trees)  # the size of the model
        width = len(features)
        key_type = scaled.schema[key].dataType.simpleString()

        def explain(batches):
            for pdf in batches:
                x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), width)
                phi = tree_shapley(x, shared.value)
                for c in range(phi.shape[1]):
                    yield pd.DataFrame(
                        {"k": pdf[key].to_numpy(), "class": c, "x": list(x), "phi": list(phi[:, c, :]), "base": base[c]}
                    )

        per_class = scaled.mapInPandas(
            explain, f"k {key_type}, class int, x array<double>, phi array<double>, base double"
        ).withColumnRenamed("k", key)
    names = F.array(*[F.lit(f) for f in features])
    return per_class.select(
        col(key), "class", "base", F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("contribution"))).alias("s")
    ).select(col(key), "class", F.col("s.feature").alias("feature"), F.col("s.value").alias("value"), F.col("s.contribution").alias("contribution"), "base")


# --------------------------------------------------------------------------
# Summaries of a long contribution table


def top_features(long: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Features with the largest mean of absolute contributions summed over classes."""
    # Mean over rows of a per-row sum = total / rows; a row has each class once per feature.
    first_class = long.agg(F.min("class")).first()[0]
    rows = F.sum((F.col("class") == F.lit(first_class)).cast("long"))
    return (
        long.groupBy("feature")
        .agg((F.sum(F.abs("contribution")) / rows).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
        .limit(n)
    )


def global_importance(long: DataFrame, positive: int = 1) -> DataFrame:
    """Mean absolute contribution to the positive class (class 0 when it is the only one)."""
    last = long.agg(F.max("class")).first()[0]
    chosen = positive if last is not None and last >= positive else 0
    return (
        long.where(F.col("class") == chosen)
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )


def waterfall(long: DataFrame, key: str, n: int = 7, positive: int = 1, entries: int | None = None) -> DataFrame:
    """(key, position, feature, contribution, base, final) for every row.

    The ``n`` largest by absolute value, the others in one sum, ordered by
    signed value. A row has as many entries as the model has features. The rows are dealt out
    once, in as many parts as their entries need; ``entries`` saves counting them.
    """
    one = long.where(F.col("class") == positive)
    # All sorts and sums below go by the key, so they stay in these parts and a task's memory does not grow with the rows.
    entries = one.count() if entries is None else entries
    one = one.repartition(max(long.sparkSession.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES)), col(key))
    by_size = Window.partitionBy(col(key)).orderBy(F.abs("contribution").desc(), "feature")
    sized = one.withColumn("__place", F.row_number().over(by_size))
    kept = F.col("__place") <= n
    grouped = sized.groupBy(col(key), F.when(kept, F.col("feature")).alias("__f")).agg(
        F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("__c"), F.first("base").alias("base")
    )
    per_row = Window.partitionBy(col(key))
    labelled = grouped.select(
        col(key),
        F.coalesce(F.col("__f"), F.concat(F.col("__c").cast("string"), F.lit(" Other Features"))).alias("feature"),
        "contribution",
        "base",
        (F.col("base") + F.sum("contribution").over(per_row)).alias("final"),
    )
    by_value = per_row.orderBy(F.col("contribution").desc(), "feature")
    return labelled.withColumn("position", F.row_number().over(by_value))


def dependence(long: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, class, feature, value, contribution) of the chosen features."""
    return long.where(F.col("feature").isin(list(features))).select(
        col(key), "class", "feature", "value", "contribution"
    )
