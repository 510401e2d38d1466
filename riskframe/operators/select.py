"""Feature importance, decorrelation, derived columns and the feature pipeline."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Correlation
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import bool_to_int, col
from riskframe.operators import cells
from riskframe.operators.ranks import average_ranks, ranked_cells, running_counts, to_long, with_buckets
from riskframe.session import materialize

LOG_EPSILON = 1e-6
# Columns that are ranked by a join each; more of them as one row per cell, brought back together by key.
FEW_COLUMNS = 12
# Distinct values of a column whose ranks are broadcast.
FEW_VALUES = 300_000
FOREST_TREES = 50
FOREST_DEPTH = 30  # the deepest that the forest allows


# --------------------------------------------------------------------------
# Rank correlation


def spearman_target(df: DataFrame, target: str, features: Sequence[str], buckets: int | None = None) -> DataFrame:
    """(feature, spearman): absolute rank correlation with the target.

    Missing cells are skipped per feature; an undefined correlation is 0.
    Everything is computed on counts per (feature, value, target), so no rank
    is joined back to the rows.
    """
    y = "__y"
    cells = to_long(df.where(col(target).isNotNull()), features, [target]).withColumn(y, col(target).cast("double"))
    joint = cells.groupBy("feature", "value", y).agg(F.count(F.lit(1)).alias("n"))
    joint, buckets = with_buckets(joint, buckets)
    y_counts = joint.groupBy("feature", y).agg(F.sum("n").alias("yn"))
    y_rank = running_counts(y_counts, ["feature"], y, ["yn"], buckets).select(
        "feature", y, (F.col("yn_below") + (F.col("yn") + 1) / 2).alias("ry")
    )
    by_value = joint.join(y_rank, ["feature", y]).groupBy("feature", "value").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("ry")).alias("s_ry"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("s_ry2"),
    )
    ranked = running_counts(by_value, ["feature"], "value", ["n"], buckets).withColumn(
        "rx", F.col("n_below") + (F.col("n") + 1) / 2
    )
    s = ranked.groupBy("feature").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("rx")).alias("sx"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("rx") * F.col("s_ry")).alias("sxy"),
        F.sum("s_ry").alias("sy"),
        F.sum("s_ry2").alias("syy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    tiny = 1e-9 * F.col("n")
    value = F.when((vx > tiny) & (vy > tiny), F.abs(cov / F.sqrt(vx * vy))).otherwise(0.0)
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(F.broadcast(s.select("feature", value.alias("spearman"))), "feature", "left").na.fill(
        0.0, ["spearman"]
    )


def rank_frame(df: DataFrame, key: str, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row per key with the average rank of every column."""
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    return (
        ranked_cells(df, key, columns, buckets)
        .groupBy(col(key))
        .agg(*[F.max(F.when(F.col("feature") == c, rank)).alias(c) for c in columns])
    )


def rank_columns(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """The rows with the average rank of every column in its place; missing cells stay missing.

    A join per column and no row key: for few columns. The ranks of a column with at most ``FEW_VALUES`` values are
    broadcast, so its join moves no rows.
    """
    places = average_ranks(to_long(df, columns), ["feature"], "value", buckets).select("feature", "value", "rank")
    places = materialize(places, "places")
    sizes = {r["feature"]: r["n"] for r in places.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        own = places.where(F.col("feature") == c).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
        own = F.broadcast(own) if sizes.get(c, 0) <= FEW_VALUES else own
        out = out.join(own, f"v{i}", "left").drop(f"v{i}")
    return out.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])


def _few_columns_matrix(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[tuple[str, str], float]:
    """Rank correlations of few columns in one pass over their ranks."""
    ranks = rank_columns(df, columns, buckets)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = ranks.where(F.coalesce(*[col(c) for c in columns]).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(col(columns[i]), col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    for i, c in enumerate(columns):
        if row[f"n{i}"] < row["n"]:
            raise ValueError(f"column {c!r} has missing cells")
    variance = [row[f"v{i}"] or 0.0 for i in range(len(columns))]
    result = {(c, c): float(v > 0) for c, v in zip(columns, variance)}
    for i, j in pairs:
        both = math.sqrt(variance[i] * variance[j])
        value = abs(row[f"c{i}_{j}"]) / both if both else 0.0
        result[columns[i], columns[j]] = result[columns[j], columns[i]] = value
    return result


def spearman_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    """Absolute rank correlation of every pair of columns without missing cells; 0 with a constant column.

    The result is a columns x columns matrix (a schema decision) on the driver.
    """
    columns = list(columns)
    if 0 < len(columns) <= FEW_COLUMNS:
        return _few_columns_matrix(df, columns)
    ranks = rank_frame(df, key, columns)
    names = [f"r{i}" for i in range(len(columns))]
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(
        ranks.select(*[col(c).alias(n) for c, n in zip(columns, names)])
    )
    matrix = Correlation.corr(vectors.select("v"), "v", "pearson").first()[0].toArray()
    return {
        (a, b): 0.0 if math.isnan(matrix[i][j]) else abs(float(matrix[i][j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    }


# --------------------------------------------------------------------------
# Importance


def forest_importance(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    seed: int = 42,
) -> dict[str, float]:
    """Mean decrease in impurity of a random forest (see ``cells``)."""
    return cells.importance(df, target, features, trees, depth, seed)


def importance_table(
    df: DataFrame, target: str, features: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = 42
) -> DataFrame:
    """(feature, metric1_spearman, metric2_mdi, metric3_product), best product first."""
    mdi = forest_importance(df, target, features, trees, depth, seed)
    mdi_df = df.sparkSession.createDataFrame(list(mdi.items()), "feature string, metric2_mdi double")
    return (
        spearman_target(df, target, features)
        .withColumnRenamed("spearman", "metric1_spearman")
        .join(F.broadcast(mdi_df), "feature")
        .withColumn("metric3_product", F.col("metric1_spearman") * F.col("metric2_mdi"))
        .orderBy(F.col("metric3_product").desc(), "feature")
    )


def top_n_union(importance: DataFrame, n: int, first: str = "metric1_spearman", second: str = "metric2_mdi") -> DataFrame:
    """Names among the ``n`` largest of either metric, sorted, each once."""
    a = importance.orderBy(F.col(first).desc(), "feature").limit(n).select("feature")
    b = importance.orderBy(F.col(second).desc(), "feature").limit(n).select("feature")
    return a.union(b).distinct().orderBy("feature")


def correlated_drop(
    columns: Sequence[str],
    correlation: Mapping[tuple[str, str], float],
    product: Mapping[str, float],
    limit: float,
) -> list[str]:
    """Columns to drop by the greedy, order-dependent rule.

    For each column not yet dropped, the group is the column itself and all
    earlier columns correlated above the limit, dropped ones included. The
    member with the largest product stays (the first in descending product
    order on ties) and the rest is dropped. A winner that was dropped earlier
    stays dropped.
    """
    ranking = {f: i for i, f in enumerate(sorted(product, key=lambda f: -product[f]))}
    dropped: list[str] = []
    for j, name in enumerate(columns):
        if name in dropped:
            continue
        partners = [p for p in columns[:j] if correlation[(p, name)] > limit]
        group = [g for g in [name, *partners] if g in ranking]
        if not partners or not group:
            continue
        winner = min(group, key=lambda g: ranking[g])
        dropped += [g for g in [name, *partners] if g != winner and g not in dropped]
    return dropped


# --------------------------------------------------------------------------
# Derived columns and projection


def derived_columns(features: Sequence[str]):
    """Name -> expression of the root, square and log of each feature."""
    result = {}
    for f in features:
        x = col(f).cast("double")
        result[f"{f}_pow0_5"] = F.sqrt(F.abs(x))
        result[f"{f}_pow2"] = x * x
        result[f"{f}_log"] = F.log(F.abs(x) + F.lit(LOG_EPSILON))
    return result


def power_log_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns(derived_columns([f for f in features if f in df.columns]))


def project_required(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """The required columns in order, then the target; a missing one is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks these features: {missing}")
    return df.select(*[col(f) for f in features], *([col(target)] if target else []))


# --------------------------------------------------------------------------
# Pipeline


class _PipelineParams(Params):
    keyCol = Param(Params._dummy(), "keyCol", "entity key", TypeConverters.toString)
    targetCol = Param(Params._dummy(), "targetCol", "0/1 label", TypeConverters.toString)
    nSelect = Param(Params._dummy(), "nSelect", "features taken per metric", TypeConverters.toInt)
    corVal = Param(Params._dummy(), "corVal", "correlation limit", TypeConverters.toFloat)
    excludeCols = Param(Params._dummy(), "excludeCols", "columns never used as features", TypeConverters.toListString)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the importance forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the importance forest", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    createList = Param(Params._dummy(), "createList", "features with derived columns", TypeConverters.toListString)
    finalFeatures = Param(Params._dummy(), "finalFeatures", "fitted feature list", TypeConverters.toListString)


class FeaturePipeline(Estimator, _PipelineParams, DefaultParamsReadable, DefaultParamsWritable):
    """Importance, selection, decorrelation, derived columns, decorrelation."""

    @keyword_only
    def __init__(
        self,
        *,
        keyCol="SK_ID_CURR",
        targetCol="TARGET",
        nSelect=50,
        corVal=0.7,
        excludeCols=None,
        numTrees=FOREST_TREES,
        maxDepth=FOREST_DEPTH,
        seed=42,
    ):
        super().__init__()
        self._setDefault(
            keyCol="SK_ID_CURR",
            targetCol="TARGET",
            nSelect=50,
            corVal=0.7,
            excludeCols=[],
            numTrees=FOREST_TREES,
            maxDepth=FOREST_DEPTH,
            seed=42,
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _importance(self, df: DataFrame, features: Sequence[str]) -> list[dict]:
        """The importance table on the driver: one row per feature."""
        rows = importance_table(
            df,
            self.getOrDefault("targetCol"),
            features,
            self.getOrDefault("numTrees"),
            self.getOrDefault("maxDepth"),
            self.getOrDefault("seed"),
        ).collect()
        return [r.asDict() for r in rows]

    def _decorrelate(self, df: DataFrame, features: list[str], importance: list[dict]) -> list[str]:
        if len(features) < 2 or not importance:
            return features
        matrix = spearman_matrix(df, self.getOrDefault("keyCol"), features)
        product = {r["feature"]: r["metric3_product"] for r in importance}
        dropped = set(correlated_drop(features, matrix, product, self.getOrDefault("corVal")))
        return [f for f in features if f not in dropped]

    def _fit(self, dataset: DataFrame) -> "FeaturePipelineModel":
        key, target = self.getOrDefault("keyCol"), self.getOrDefault("targetCol")
        if target not in dataset.columns:
            raise ValueError(f"there is no column {target!r} to select features for")
        if dataset.isEmpty():
            raise ValueError("features can't be selected without rows")
        df = bool_to_int(dataset)
        skip = {key, target, *self.getOrDefault("excludeCols")}
        base = [c for c in df.columns if c not in skip]
        importance = self._importance(df, base)
        n = self.getOrDefault("nSelect")
        table = df.sparkSession.createDataFrame(importance) if importance else None
        select_list, create_list = (
            [r["feature"] for r in top_n_union(table, k).collect()] if table else [] for k in (n, max(2, int(math.sqrt(n))))
        )
        selected = self._decorrelate(df, select_list, importance)

        created_all = list(derived_columns(create_list))
        widened = power_log_features(df, create_list)
        created = self._decorrelate(widened, created_all, self._importance(widened, created_all))

        combined = selected + created
        final = self._decorrelate(widened, combined, self._importance(widened, combined))
        if not final:
            raise RuntimeError("no feature is left after decorrelation")
        model = FeaturePipelineModel()
        model._set(keyCol=key, targetCol=target, createList=create_list, finalFeatures=final)
        return model


class FeaturePipelineModel(Model, _PipelineParams, DefaultParamsReadable, DefaultParamsWritable):
    @property
    def features(self) -> list[str]:
        return list(self.getOrDefault("finalFeatures"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        target = self.getOrDefault("targetCol")
        widened = power_log_features(bool_to_int(dataset), self.getOrDefault("createList"))
        key = self.getOrDefault("keyCol")
        keep = [k for k in [key] if k in widened.columns and k not in self.features]
        projected = [*keep, *self.features]
        return project_required(widened, projected, target if target in widened.columns else None)
