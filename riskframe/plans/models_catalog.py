"""Scalers, classifiers, scores, grids and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.expr import col
from riskframe.operators import metrics as m
from riskframe.operators import boosting, models, runs, sample, scale, search
from riskframe.plans import roles
from riskframe.plans import sqltext as s
from riskframe.plans.registry import near, near_sql, register, tidy
from riskframe.plans.stats_catalog import MODEL_FEATURES, loans, model_frame

SCALED = ["amount", "age", "grade", "flat"]


def split(spark, sf_dir):
    return sample.stratified_split(model_frame(spark, sf_dir), "loan_id", "y")


def _scale_query(key: str, how: str, formula: str):
    @register(
        key,
        f"SELECT loan_id, {', '.join(near_sql(formula.format(c=c)) + f' AS {c}' for c in SCALED)} FROM scaled",
        ["loans"],
        {
            **s.CLASS_RANKS,
            "train": "SELECT * FROM placed WHERE r > floor(0.2::DOUBLE * class_n + 0.5)",
            "fit": "SELECT "
            + ", ".join(
                f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd, min({c}) AS {c}_min, max({c}) AS {c}_max, "
                f"median(CAST({c} AS DOUBLE)) AS {c}_med, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, "
                f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_q3"
                for c in SCALED
            )
            + " FROM train",
            "scaled": "SELECT * FROM loans, fit",
        },
    )
    def query(spark, sf_dir):
        """Fitted on the train rows, applied to train and test."""
        df = loans(spark, sf_dir).select("loan_id", "y", *SCALED)
        train, test = sample.stratified_split(df, "loan_id", "y")
        first, second = scale.scale(train, [test], SCALED, how)
        both = first.unionByName(second)
        return both.select("loan_id", *[near(col(c)).alias(c) for c in SCALED])

    return query


def _guarded(centre: str, width: str) -> str:
    return f"({{c}} - {centre}) / CASE WHEN {width} = 0 THEN 1 ELSE {width} END"


_scale_query("scale_standard", "standard", _guarded("{c}_mean", "{c}_sd"))
_scale_query("scale_minmax", "minmax", _guarded("{c}_min", "({c}_max - {c}_min)"))
_scale_query("scale_robust", "robust", _guarded("{c}_med", "({c}_q3 - {c}_q1)"))
_scale_query("scale_none", "none", "{c}")


# --------------------------------------------------------------------------


def _train_query(key: str, algorithm: str, **params):
    @register(key)
    def query(spark, sf_dir):
        """Test-set probabilities of a model fitted on the train part."""
        train, test = split(spark, sf_dir)
        model = models.train(train, MODEL_FEATURES, "y", algorithm, **params)
        return models.with_probability(model, test).select("loan_id", "y", models.SCORE)

    return query


_train_query("train_logreg", "logreg")
_train_query("train_random_forest", "random_forest")
_train_query("train_gbt", "gradient_boosting")
_train_query("train_second_order", "second_order_boosting")
_train_query("train_ordered", "ordered_boosting")


CODES = f"""
SELECT loan_id, priority, {near_sql("(coalesce(sum(y) OVER earlier, 0) + prior * 2) / (count(y) OVER earlier + 2)")} AS code
FROM loans, (SELECT avg(y) AS prior FROM loans) p
WINDOW earlier AS (PARTITION BY priority ORDER BY md5(loan_id || ':42'), loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register("ordered_target_codes", CODES, ["loans"])
def ordered_target_codes(spark, sf_dir):
    """The mean target of the earlier rows of the same priority, drawn towards that of all rows."""
    df = loans(spark, sf_dir).select("loan_id", "priority", "y")
    prior = df.agg(F.avg("y")).first()[0]
    return tidy(boosting.ordered_codes(df, "loan_id", "priority", "y", prior, strength=2.0).drop("y"))


# --------------------------------------------------------------------------


@register("roc_auc", f"SELECT n_pos, n_neg, {near_sql('auc')} AS auc FROM auc_by", ["loans"], s.auc_sql("loans"))
def roc_auc(spark, sf_dir):
    return tidy(m.auc_table(loans(spark, sf_dir), "score", "y"))


OUTCOMES = """
SELECT count(*) FILTER (WHERE y = 0 AND score < 0.4::DOUBLE) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.4::DOUBLE) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.4::DOUBLE) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.4::DOUBLE) AS tp
FROM loans"""


@register("confusion_matrix", "SELECT * FROM c", ["loans"], {"c": OUTCOMES})
def confusion_matrix(spark, sf_dir):
    return m.confusion(loans(spark, sf_dir), "score", "y", 0.4)


@register(
    "accuracy_recall",
    f"SELECT tn, fp, fn, tp, {near_sql('(tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE)')} AS accuracy, "
    f"{near_sql('tp / CAST(tp + fn AS DOUBLE)')} AS recall FROM c",
    ["loans"],
    {"c": OUTCOMES},
)
def accuracy_recall(spark, sf_dir):
    return tidy(m.accuracy_recall(m.confusion(loans(spark, sf_dir), "score", "y", 0.4)))


@register(
    "cost_score",
    "SELECT tn, fp, fn, tp, CAST(2 * tp + tn - fp - 10 * fn AS DOUBLE) AS cost, "
    + near_sql("(2 * tp + tn - fp - 10 * fn) * (1.0::DOUBLE / (tn + fp + fn + tp)) * (1.0::DOUBLE / pos)")
    + " AS normalized_cost FROM c, (SELECT avg(y) AS pos FROM loans) p",
    ["loans"],
    {"c": OUTCOMES},
)
def cost_score(spark, sf_dir):
    df = loans(spark, sf_dir)
    share = df.agg(F.avg("y")).first()[0]
    return tidy(m.cost_score(m.confusion(df, "score", "y", 0.4), share))


@register(
    "threshold_sweep",
    f"SELECT threshold, tn, fp, fn, tp, cost, {near_sql('normalized_cost')} AS normalized_cost FROM swept "
    "ORDER BY cost DESC, threshold LIMIT 1",
    ["loans"],
    s.SWEEP,
)
def threshold_sweep(spark, sf_dir):
    df = loans(spark, sf_dir)
    share = df.agg(F.avg("y")).first()[0]
    return tidy(m.threshold_sweep(df, "score", "y", share), exact=["threshold"])


# --------------------------------------------------------------------------


def _grid_columns(df, *names):
    return df.select("run_name", *[F.col("metrics")[n].alias(n) for n in names])


@register("algorithm_grid")
def algorithm_grid(spark, sf_dir):
    train, test = split(spark, sf_dir)
    grid = search.run_algorithm_grid(train, test, "loan_id", "y", MODEL_FEATURES)
    return _grid_columns(
        grid, "train_auc", "test_auc", "test_accuracy", "test_recall_at_best_t", "test_normalized_custom_score", "best_threshold"
    )


@register("grid_search")
def grid_search(spark, sf_dir):
    runs_df = search.grid_search(model_frame(spark, sf_dir), "loan_id", "y", MODEL_FEATURES)
    return _grid_columns(runs_df, "cv_normalized_score")


@register("random_search")
def random_search(spark, sf_dir):
    runs_df = search.random_search(model_frame(spark, sf_dir), "loan_id", "y", MODEL_FEATURES)
    return _grid_columns(runs_df, "cv_normalized_score")


@register("final_evaluation")
def final_evaluation(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return search.final_evaluation(train, test, "y", MODEL_FEATURES, "random_forest")


@register(
    "run_compare",
    f"SELECT 'score_by__' || priority AS run_name, {near_sql('auc')} AS value, rank() OVER (ORDER BY auc DESC) AS position FROM auc_by",
    ["loans"],
    s.AUC_BY_PRIORITY,
)
def run_compare(spark, sf_dir):
    measured = m.auc_table(loans(spark, sf_dir), "score", "y", by="priority")
    table = measured.select(
        F.concat(F.lit("score_by__"), F.col("priority")).alias("run_name"),
        F.create_map(F.lit("segment"), F.col("priority")).alias("params"),
        F.create_map(F.lit("roc_auc"), F.col("auc")).alias("metrics"),
    )
    return tidy(runs.compare_runs(table, "roc_auc"))
