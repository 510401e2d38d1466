"""The stages end to end: raw tables -> feature table -> processed train / test -> scores.

Each stage reads and writes Parquet, so a lost job restarts from the last table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from riskframe.functions.expr import col, numeric_columns
from riskframe.operators import clean, features
from riskframe.operators.metrics import auc
from riskframe.operators.models import SCORE, train, with_probability
from riskframe.operators.runs import run_record
from riskframe.operators.sample import class_sizes, stratified_split
from riskframe.operators.select import FeaturePipeline
from riskframe.session import materialize
from riskframe.sources import io

# ---- Fixed values: file names of the raw tables, debug size, stage settings ----
RAW_TABLES = {
    "application_train": ["SK_ID_CURR"],
    "application_test": ["SK_ID_CURR"],
    "bureau": ["SK_ID_BUREAU"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE"],
    "previous_application": ["SK_ID_CURR"],
    "POS_CASH_balance": ["SK_ID_CURR", "MONTHS_BALANCE"],
    "installments_payments": ["SK_ID_CURR"],
    "credit_card_balance": ["SK_ID_CURR", "MONTHS_BALANCE"],
}
DEBUG_ROWS = 10_000
CLEAN_SETTINGS = [
    {"completeness": 80, "outlier_percent": 1.0, "cv_threshold": 0.01},
    {"completeness": 85, "outlier_percent": 0.5, "cv_threshold": 0.05},
    {"completeness": 90, "outlier_percent": 0.2, "cv_threshold": 0.1},
]
FEATURE_SETTINGS = [
    {"n_select": 40, "cor_val": 0.7},
    {"n_select": 60, "cor_val": 0.65},
    {"n_select": 80, "cor_val": 0.6},
    {"n_select": 100, "cor_val": 0.6},
]
# ---------------------------------------------------------------------------------


def read_raw(
    spark: SparkSession, data_path: str, schemas: Mapping | None = None, debug: bool = False
) -> dict[str, DataFrame]:
    """The raw CSV tables; types are declared in ``schemas`` or inferred once per table."""
    tables = {}
    for name, order in RAW_TABLES.items():
        path = f"{data_path}/{name}.csv"
        schema = (schemas or {}).get(name) or io.inferred_csv_schema(spark, path)
        df = io.read_csv(spark, path, schema)
        tables[name] = io.first_rows(df, order, DEBUG_ROWS) if debug else df
    return tables


def build_feature_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All feature sets joined to the applications.

    Every child set is written once, which keeps the plan of the join small
    and its input safe against lost executors.
    """
    children = {
        "bureau": features.bureau_features(tables["bureau"], tables["bureau_balance"]),
        "previous": features.previous_features(tables["previous_application"]),
        "pos": features.pos_features(tables["POS_CASH_balance"]),
        "instalments": features.instalment_features(tables["installments_payments"]),
        "card": features.card_features(tables["credit_card_balance"]),
    }
    stored = [materialize(df, name) for name, df in children.items()]
    main = features.application_features(tables["application_train"], tables["application_test"])
    return features.feature_table(main, stored)


def ingest(
    spark: SparkSession, data_path: str, output_path: str, schemas: Mapping | None = None, debug: bool = False
) -> DataFrame:
    io.write_parquet(build_feature_table(read_raw(spark, data_path, schemas, debug)), output_path)
    return io.read_parquet(spark, output_path)


def preprocess(
    df: DataFrame,
    output_path: str,
    completeness: float = 85,
    impute: str = "median",
    cv_threshold: float | None = 0.01,
    outlier_percent: float = 1.0,
    target: str = features.TARGET,
) -> DataFrame:
    """Clean, impute, remove outliers; the result is written and read back."""
    cleaned = materialize(clean.clean_and_impute(df, target, completeness, impute, cv_threshold), "cleaned")
    io.write_parquet(clean.remove_outliers(cleaned, outlier_percent, target), output_path)
    return io.read_parquet(df.sparkSession, output_path)


def quick_evaluation(df: DataFrame, key: str = features.KEY, target: str = features.TARGET, seed: int = 42) -> tuple:
    """Run record of a logistic regression on a stratified split; one class only gives AUC 0."""
    counts = {"final_row_count": df.count(), "final_feature_count": len(df.columns) - 1}
    if len(class_sizes(df, target)) < 2:
        return run_record("preprocess", {"skipped": "one class"}, {"roc_auc": 0.0, **counts})
    train_df, test_df = stratified_split(df, key, target, 0.2, seed)
    columns = numeric_columns(df, [target])
    model = train(train_df, columns, target, "logreg", "standard", seed)
    return run_record("preprocess", {}, {"roc_auc": auc(with_probability(model, test_df), SCORE, target), **counts})


def engineer(
    df: DataFrame,
    output_dir: str,
    n_select: int = 50,
    cor_val: float = 0.7,
    scaler: str = "robust",
    key: str = features.KEY,
    target: str = features.TARGET,
    seed: int = 42,
    **forest,
) -> tuple[DataFrame, DataFrame, tuple]:
    """Split, fit the feature pipeline on train, transform both, write, evaluate.

    Returns the written train and test frames and a run record.
    """
    spark = df.sparkSession
    train_df, test_df = stratified_split(df, key, target, 0.2, seed)
    pipeline = FeaturePipeline(keyCol=key, targetCol=target, nSelect=n_select, corVal=cor_val, seed=seed, **forest)
    fitted = pipeline.fit(materialize(train_df, "train"))
    written = []
    for name, part in (("train_processed", train_df), ("test_processed", test_df)):
        path = f"{output_dir}/{name}.parquet"
        io.write_parquet(fitted.transform(part), path)
        written.append(io.read_parquet(spark, path))
    model = train(written[0], fitted.features, target, "logreg", scaler, seed)
    record = run_record(
        "process",
        {"n_select": n_select, "cor_val": cor_val, "scaler": scaler},
        {
            "roc_auc_test": auc(with_probability(model, written[1]), SCORE, target),
            "train_rows": written[0].count(),
            "test_rows": written[1].count(),
            "final_feature_count": len(fitted.features),
        },
    )
    return written[0], written[1], record


def read_processed(spark: SparkSession, folder: str, target: str = features.TARGET) -> tuple[DataFrame, DataFrame]:
    """Processed train and test frames; a missing file or target is an error."""
    frames = []
    for name in ("train_processed", "test_processed"):
        df = io.read_parquet(spark, f"{folder}/{name}.parquet")
        if target not in df.columns:
            raise ValueError(f"{name} has no column {target!r}")
        frames.append(df.select(*[col(c) for c in df.columns]))
    return frames[0], frames[1]
