"""Watching a stream of scoring requests: each request once, counts per time window.

A request carries an id and the time it was made. Repeats of a request (a client that
tries again) count once while the watermark remembers them; requests that come later
than ``delay`` behind the newest one are left out. Windows of time hold the counts that
drift statistics need: requests, answers, positives, a histogram of scores, and per
input the known values, their sum and their sum of squares. A window is written when
the watermark has passed its end and never again, so a restart from the checkpoint goes
on where the last run stopped.

State: one entry per request id younger than the watermark, and one row per open window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.models import SCORE, feature_list, with_probability
from riskframe.operators.score import Model, parse_value, validate
from riskframe.session import scratch_path

TIMED_REQUEST = "request_id string, at timestamp, client_id string, features map<string,string>"
DELAY, WINDOW, SCORE_BINS = "1 day", "1 day", 10


def once(requests: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each request id once: the first that arrives in a stream, the earliest in a table."""
    if requests.isStreaming:
        return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["request_id"])
    first = requests.groupBy("request_id").agg(F.min_by(F.struct("at", "client_id", "features"), F.struct("at", "client_id")).alias("r"))
    return first.select("request_id", "r.*")


def scored(requests: DataFrame, model: Model) -> DataFrame:
    """Requests with one double per input, ``is_valid``, and the probability of valid ones."""
    required = feature_list(model)
    checked = validate(requests, required)
    values = {f: parse_value(F.try_element_at("features", F.lit(f))) for f in required}
    given = checked.select("request_id", "at", "is_valid", *[v.alias(f) for f, v in values.items()])
    answered = with_probability(model, given)
    return answered.withColumn(SCORE, F.when(F.col("is_valid") == 1, F.col(SCORE)))


def _histogram(score: Column, bins: int) -> Column:
    """Counts of scores in ``bins`` equal parts of 0 to 1."""
    place = F.when(score.isNotNull(), F.least(F.floor(score * bins), F.lit(bins - 1)))
    return F.array(*[F.count_if(place == i) for i in range(bins)])


def window_counts(answers: DataFrame, features: Sequence[str], threshold: float, size: str = WINDOW, bins: int = SCORE_BINS) -> DataFrame:
    """One row per window: window_start, requests, valid, positive, score_sum, score_counts, inputs."""
    inputs = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.count(F.col(f)).alias("known"), F.sum(F.col(f)).alias("total"),
                F.sum(F.col(f) * F.col(f)).alias("squares"),
            )
            for f in features
        ]
    )
    return answers.groupBy(F.window("at", size).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("is_valid").alias("valid"),
        F.count_if(F.col(SCORE) >= threshold).alias("positive"),
        F.sum(SCORE).alias("score_sum"),
        _histogram(F.col(SCORE), bins).alias("score_counts"),
        inputs.alias("inputs"),
    ).select(F.col("w.start").alias("window_start"), "requests", "valid", "positive", "score_sum", "score_counts", "inputs")


def monitor(requests: DataFrame, model: Model, threshold: float, delay: str = DELAY, size: str = WINDOW) -> DataFrame:
    """Window counts of a table or a stream of timed requests."""
    return window_counts(scored(once(requests, delay), model), feature_list(model), threshold, size)


def monitor_stream(
    spark: SparkSession,
    model: Model,
    in_dir: str,
    out_dir: str,
    threshold: float,
    checkpoint: str | None = None,
    delay: str = DELAY,
    size: str = WINDOW,
    files: int = 100,
):
    """Read what is new in ``in_dir``, ``files`` at a time, and write the windows that have closed."""
    requests = spark.readStream.schema(TIMED_REQUEST).option("maxFilesPerTrigger", files).json(in_dir)
    query = (
        monitor(requests, model, threshold, delay, size)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "monitor"))
        .trigger(availableNow=True)
        .start(out_dir)
    )
    query.awaitTermination()
    return query


def score_shift(reference: Column, current: Column) -> Column:
    """Population stability index of two score histograms, over bins that both have."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    p, q = (F.transform(a, lambda x: F.try_divide(x, total(a))) for a in (reference, current))
    terms = F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), (y - x) * F.log(y / x)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
