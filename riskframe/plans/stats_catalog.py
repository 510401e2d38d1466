"""Rank statistics, feature selection, splits, samples and balancing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskframe.operators import sample, select
from riskframe.plans import roles
from riskframe.plans import sqltext as s
from riskframe.plans.registry import near_sql, register, tidy
from riskframe.operators.clean import sanitize
from riskframe.operators.search import run_balance_grid

FEATURES = s.LOAN_FEATURES


def loans(spark, sf_dir):
    return roles.loans(spark, sf_dir)


@register("spearman_target", f"SELECT feature, {near_sql('spearman')} AS spearman FROM spearman", ["loans"], s.SPEARMAN_LONG)
def spearman_target(spark, sf_dir):
    return tidy(select.spearman_target(loans(spark, sf_dir), "y", FEATURES))


PAIR_FEATURES = ["score", "amount", "age", "grade", "noise_band"]
PAIRS = {
    "ranks": "SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in PAIR_FEATURES
    ) + " FROM loans",
    "pairs": " UNION ALL ".join(
        f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, abs(corr({a}, {b})) AS spearman FROM ranks"
        for i, a in enumerate(PAIR_FEATURES)
        for b in PAIR_FEATURES[i + 1 :]
    ),
}


@register(
    "spearman_matrix",
    "SELECT left_feature, right_feature, round(spearman, 6) AS spearman FROM pairs",
    ["loans"],
    PAIRS,
)
def spearman_matrix(spark, sf_dir):
    matrix = select.spearman_matrix(loans(spark, sf_dir), "loan_id", PAIR_FEATURES)
    # One row per pair of columns. Unrelated columns have a correlation near 0,
    # where only absolute digits mean anything.
    rows = [(a, b, matrix[a, b]) for i, a in enumerate(PAIR_FEATURES) for b in PAIR_FEATURES[i + 1 :]]
    pairs = spark.createDataFrame(rows, "left_feature string, right_feature string, spearman double")
    return pairs.withColumn("spearman", F.round("spearman", 6))


MODEL_FEATURES = ["score", "amount_noise", "age", "grade"]


def model_frame(spark, sf_dir):
    """Labelled rows with features that do not give the label away."""
    df = loans(spark, sf_dir)
    return df.select(
        "loan_id",
        "y",
        "score",
        ((F.col("loan_id") * 7919) % 997 + F.col("y") * 150.0).alias("amount_noise"),
        "age",
        "grade",
    )


@register("forest_importance")
def forest_importance(spark, sf_dir):
    importance = select.forest_importance(model_frame(spark, sf_dir), "y", MODEL_FEATURES)
    return spark.createDataFrame(list(importance.items()), "feature string, importance double")


@register("importance_table")
def importance_table(spark, sf_dir):
    return select.importance_table(model_frame(spark, sf_dir), "y", MODEL_FEATURES)


TOP_UNION = {
    **s.SPEARMAN_LONG,
    "means": " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS level FROM loans" for c in FEATURES),
    "metrics": "SELECT feature, spearman, level FROM spearman JOIN means USING (feature)",
    "top": "(SELECT feature FROM metrics ORDER BY spearman DESC, feature LIMIT 2) UNION "
    "(SELECT feature FROM metrics ORDER BY level DESC, feature LIMIT 2)",
}


@register("top_n_union", "SELECT feature FROM top", ["loans"], TOP_UNION)
def top_n_union(spark, sf_dir):
    df = loans(spark, sf_dir)
    means = df.agg(*[F.avg(c).alias(c) for c in FEATURES]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in FEATURES])).alias("m")
    ).select("m.*")
    importance = select.spearman_target(df, "y", FEATURES).join(F.broadcast(means), "feature")
    n = max(2, int(math.sqrt(len(FEATURES))))
    return select.top_n_union(importance, n, "spearman", "level")


CHAIN = ["amount", "amount_log", "amount_pow2", "score", "noise_band", "age"]


@register("correlated_drop")
def correlated_drop(spark, sf_dir):
    """Which of a group of related columns the greedy rule keeps."""
    df = loans(spark, sf_dir).select("loan_id", "y", "amount", "score", "noise_band", "age")
    df = select.power_log_features(df, ["amount"]).drop("amount_pow0_5")
    matrix = select.spearman_matrix(df, "loan_id", CHAIN)
    product = {r["feature"]: r["spearman"] for r in select.spearman_target(df, "y", CHAIN).collect()}
    dropped = select.correlated_drop(CHAIN, matrix, product, 0.7)
    return spark.createDataFrame([(c, int(c not in dropped)) for c in CHAIN], "feature string, kept int")


def _pipeline():
    return select.FeaturePipeline(
        keyCol="loan_id", targetCol="y", nSelect=4, corVal=0.7
    )


@register("feature_pipeline_fit")
def feature_pipeline_fit(spark, sf_dir):
    model = _pipeline().fit(model_frame(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(model.features)), "position int, feature string")


@register(
    "feature_pipeline_transform",
    f"SELECT loan_id, score, grade, {near_sql('sqrt(abs(age))')} AS age_pow0_5, {near_sql('ln(abs(score) + 1e-6::DOUBLE)')} AS score_log, y "
    "FROM loans",
    ["loans"],
)
def feature_pipeline_transform(spark, sf_dir):
    model = select.FeaturePipelineModel()
    model._set(
        keyCol="loan_id", targetCol="y", createList=["age", "score"],
        finalFeatures=["score", "grade", "age_pow0_5", "score_log"],
    )
    return tidy(model.transform(model_frame(spark, sf_dir)), exact=["score"])


# --------------------------------------------------------------------------


@register(
    "stratified_split",
    "SELECT loan_id, y, CAST(r <= floor(0.2::DOUBLE * class_n + 0.5) AS INTEGER) AS is_test FROM placed",
    ["loans"],
    s.CLASS_RANKS,
)
def stratified_split(spark, sf_dir):
    return sample.assign_split(loans(spark, sf_dir).select("loan_id", "y"), "loan_id", "y")


@register("stratified_sample_n", "SELECT loan_id, y FROM sampled", ["loans"], s.SAMPLE_ROWS)
def stratified_sample_n(spark, sf_dir):
    return sample.stratified_sample(loans(spark, sf_dir).select("loan_id", "y"), "loan_id", "y", 500)


@register("stratified_kfold", "SELECT loan_id, y, CAST((r - 1) % 3 AS INTEGER) AS fold FROM placed", ["loans"], s.CLASS_RANKS)
def stratified_kfold(spark, sf_dir):
    return sample.stratified_folds(loans(spark, sf_dir).select("loan_id", "y"), "loan_id", "y", 3)


@register(
    "undersample",
    "SELECT loan_id, y FROM placed WHERE y = 1 OR r <= (SELECT floor(sum(y) / (0.25::DOUBLE / 0.75::DOUBLE)) FROM loans)",
    ["loans"],
    s.CLASS_RANKS,
)
def undersample(spark, sf_dir):
    return sample.undersample(loans(spark, sf_dir).select("loan_id", "y"), "loan_id", "y", 0.25)


def _unit(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


# Rare loans: every class-1 row with two features; about one row in thirteen.
SMOTE = {
    "minor": f"SELECT loan_id, amount, CAST(age AS DOUBLE) AS age, {s.md5_rank('loan_id')} AS r FROM loans WHERE y = 1",
    "sizes": "SELECT sum(y) AS n_min, sum(1 - y) AS n_maj, CAST(floor(0.2::DOUBLE * sum(1 - y)) AS BIGINT) - sum(y) AS wanted FROM loans",
    "near": "SELECT a.loan_id AS base, b.loan_id AS neighbor, b.amount, b.age, row_number() OVER (PARTITION BY a.loan_id "
    "ORDER BY (a.amount - b.amount) * (a.amount - b.amount) + (a.age - b.age) * (a.age - b.age), b.loan_id) AS pick "
    "FROM minor a JOIN minor b ON a.loan_id <> b.loan_id",
    "turns": "SELECT loan_id AS base, amount, age, unnest(generate_series(0, CAST(wanted // n_min "
    "+ CASE WHEN r <= wanted % n_min THEN 1 ELSE 0 END AS BIGINT) - 1)) AS turn FROM minor, sizes",
    "emitted": f"SELECT base, amount, age, turn, 1 + CAST(floor({_unit(chr(39).join(['base || ', ':', ' || turn || ', ':42:n', '']))} * 5) AS INTEGER) AS pick, "
    f"{_unit(chr(39).join(['base || ', ':', ' || turn || ', ':42:u', '']))} AS u FROM turns",
}


@register(
    "smote",
    f"""
SELECT base, neighbor, CAST(turn AS INTEGER) AS turn, {near_sql('e.amount + u * (n.amount - e.amount)')} AS amount,
  {near_sql('e.age + u * (n.age - e.age)')} AS age
FROM emitted e JOIN near n USING (base, pick)""",
    ["loans"],
    SMOTE,
)
def smote(spark, sf_dir):
    df = loans(spark, sf_dir).select("loan_id", "y", "amount", F.col("age").cast("double").alias("age"))
    sizes = sample.class_sizes(df, "y")
    wanted = int(0.2 * sizes[0]) - sizes[1]
    made = sample.synthetic_rows(
        df.where("y = 1"), "loan_id", "y", ["amount", "age"], wanted, sizes[1], keep_origin=True
    )
    return tidy(made.select("base", "neighbor", "turn", "amount", "age"))


@register("hybrid_balance")
def hybrid_balance(spark, sf_dir):
    df = loans(spark, sf_dir).select("loan_id", "y", "amount", F.col("age").cast("double").alias("age"))
    return sample.hybrid_balance(df, "loan_id", "y", ["amount", "age"], 0.3)


@register("balance_grid")
def balance_grid(spark, sf_dir):
    df = sanitize(model_frame(spark, sf_dir), keep=["loan_id", "y"])
    train, test = sample.stratified_split(df, "loan_id", "y")
    return run_balance_grid(train, test, "loan_id", "y", MODEL_FEATURES).select(
        "run_name",
        F.col("params")["technique"].alias("technique"),
        F.col("metrics")["resampled_train_rows"].alias("rows"),
        F.col("metrics")["final_resampled_balance"].alias("balance"),
        F.col("metrics")["test_roc_auc"].alias("test_roc_auc"),
    )
