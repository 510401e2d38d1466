"""Scoring requests as a stateless stream over a folder of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.models import feature_list
from riskframe.operators.score import Model, expand_payload, rejection, score_batch, validate
from riskframe.session import scratch_path

REQUEST_SCHEMA = "client_id string, features map<string,string>"
RESPONSE_SCHEMA = "client_id string, probability double, prediction int, threshold double"


def score_stream(
    spark: SparkSession,
    model: Model,
    in_dir: str,
    out_dir: str,
    threshold: float,
    checkpoint: str | None = None,
):
    """Score every new request file once; the file sink and checkpoint make reruns safe.

    Invalid requests are left out here; ``rejected_stream`` has them.
    """
    requests = spark.readStream.schema(REQUEST_SCHEMA).json(in_dir)
    required = feature_list(model)
    checked = validate(requests, required)
    valid = expand_payload(checked.where(F.col("is_valid") == 1).drop("missing", "invalid", "is_valid"), required)
    query = (
        score_batch(model, valid, "client_id", threshold)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "score-stream"))
        .trigger(availableNow=True)
        .start(out_dir)
    )
    query.awaitTermination()
    return query


def read_responses(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).parquet(out_dir)


def read_rejections(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("client_id string, error string").parquet(out_dir)


def rejected_stream(spark: SparkSession, required: list[str], in_dir: str, out_dir: str, checkpoint: str | None = None):
    """Invalid requests, with the error text of the batch scorer."""
    checked = validate(spark.readStream.schema(REQUEST_SCHEMA).json(in_dir), required)
    query = (
        rejection(checked)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "reject-stream"))
        .trigger(availableNow=True)
        .start(out_dir)
    )
    query.awaitTermination()
    return query
