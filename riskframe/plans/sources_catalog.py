"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators.features import application_features
from riskframe.operators.metrics import auc_table
from riskframe.operators.runs import append_runs
from riskframe.operators.sample import stratified_sample
from riskframe.operators.select import spearman_target
from riskframe.plans import roles
from riskframe.plans.registry import near, near_sql, register, tidy
from riskframe.plans.sqltext import APPLICATION_FEATURES, AUC_BY_PRIORITY, SAMPLE_ROWS, SPEARMAN_LONG
from riskframe.session import scratch_path
from riskframe.sources import io


@register("scan_csv", "SELECT * FROM bureau", ["bureau"])
def scan_csv(spark, sf_dir):
    df = roles.bureau(spark, sf_dir)
    path = scratch_path(spark, "csv")
    io.write_csv(df, path)
    return io.read_csv(spark, path, df.schema)


@register(
    "scan_limit",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10000""",
)
def scan_limit(spark, sf_dir):
    df = roles.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return io.first_rows(df, df.columns, 10_000)


@register(
    "scan_parquet",
    "SELECT * REPLACE (CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate) FROM lineitem",
)
def scan_parquet(spark, sf_dir):
    df = io.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return df.withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


@register("sink_parquet", "SELECT * FROM features", ["application"], APPLICATION_FEATURES)
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    io.write_parquet(application_features(*roles.application_sides(spark, sf_dir)), path)
    return tidy(io.read_parquet(spark, path))


@register(
    "sink_csv_sample",
    f"SELECT loan_id, y, {near_sql('amount')} AS amount, age, grade FROM sampled",
    ["loans"],
    SAMPLE_ROWS,
)
def sink_csv_sample(spark, sf_dir):
    loans = roles.loans(spark, sf_dir).select("loan_id", "y", "amount", "age", "grade")
    sampled = stratified_sample(loans, "loan_id", "y", 500)
    path = scratch_path(spark, "sample")
    io.write_csv(sampled, path)
    return tidy(io.read_csv(spark, path, sampled.schema))


@register("scan_json_record", r"SELECT event_id, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k FROM events")
def scan_json_record(spark, sf_dir):
    events = roles.table(spark, sf_dir, "events")
    return events.select("event_id", io.parse_record(F.col("props"), "k bigint")["k"].alias("k"))


@register(
    "scan_split_json",
    "SELECT loan_id, amount, CAST(age AS DOUBLE) AS age, score FROM loans",
    ["loans"],
)
def scan_split_json(spark, sf_dir):
    loans = roles.loans(spark, sf_dir)
    columns = ["amount", "age", "score"]
    documents = loans.select("loan_id", io.to_split_json(loans, columns).alias("doc"))
    return io.read_split_json(documents, "doc", columns, keep=["loan_id"])


@register(
    "importance_json",
    f"SELECT feature, {near_sql('spearman')} AS importance FROM spearman",
    ["loans"],
    SPEARMAN_LONG,
)
def importance_json(spark, sf_dir):
    loans = roles.loans(spark, sf_dir)
    importance = spearman_target(loans, "y", ["score", "amount", "age", "grade", "flat", "noise_band"])
    path = scratch_path(spark, "importance")
    io.write_importance_json(importance.withColumnRenamed("spearman", "importance"), path)
    return tidy(io.read_importance_json(spark, path))


@register(
    "run_log",
    f"""
SELECT 'score_by__' || priority AS run_name, priority AS segment, {near_sql('auc')} AS roc_auc,
  CAST(n_pos + n_neg AS DOUBLE) AS n_rows FROM auc_by""",
    ["loans"],
    AUC_BY_PRIORITY,
)
def run_log(spark, sf_dir):
    """One run record per segment, appended to a runs table and read back."""
    measured = auc_table(roles.loans(spark, sf_dir), "score", "y", by="priority")
    runs = measured.select(
        F.concat(F.lit("score_by__"), F.col("priority")).alias("run_name"),
        F.create_map(F.lit("segment"), F.col("priority")).alias("params"),
        F.create_map(
            F.lit("roc_auc"), F.col("auc"), F.lit("n_rows"), (F.col("n_pos") + F.col("n_neg")).cast("double")
        ).alias("metrics"),
    )
    path = scratch_path(spark, "runs")
    append_runs(runs, path)
    saved = spark.read.parquet(path)
    return saved.select(
        "run_name",
        F.col("params")["segment"].alias("segment"),
        near(F.col("metrics")["roc_auc"]).alias("roc_auc"),
        F.col("metrics")["n_rows"].alias("n_rows"),
    )
