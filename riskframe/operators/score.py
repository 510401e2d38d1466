"""Payload validation and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import col, digest, status_text, to_double, unit_interval
from riskframe.operators.models import SCORE, LinearModel, feature_list, with_probability

Model = PipelineModel | LinearModel


def missing_features(features: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(features))


def parse_value(text: Column) -> Column:
    """A payload value as a double: numbers and truth values; NULL for all else, NaN included."""
    truth = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0)
    return F.coalesce(to_double(text), truth)


def validate(df: DataFrame, required: Sequence[str], payload: str = "features") -> DataFrame:
    """Add ``missing`` and ``invalid`` (sorted names without a value, with one that is no number) and ``is_valid``.

    Features that the model does not ask for are ignored.
    """
    missing = F.when(col(payload).isNull(), F.array(*[F.lit(r) for r in required])).otherwise(
        missing_features(col(payload), required)
    )
    named = [
        F.when(
            F.map_contains_key(col(payload), F.lit(r)) & parse_value(F.try_element_at(col(payload), F.lit(r))).isNull(), r
        )
        for r in sorted(required)
    ]
    return df.withColumns({"missing": F.sort_array(missing), "invalid": F.array_compact(F.array(*named))}).withColumn(
        "is_valid", ((F.size("missing") == 0) & (F.size("invalid") == 0)).cast("int")
    )


def error_text() -> Column:
    """What is wrong with a checked request, from ``missing`` and ``invalid``; empty if nothing is."""
    parts = [
        F.when(F.size(name) > 0, F.concat(F.lit(f"{label}: "), F.array_join(name, ", ")))
        for name, label in (("missing", "no value for"), ("invalid", "not a number in"))
    ]
    return F.concat_ws("; ", *parts)


def rejection(checked: DataFrame) -> DataFrame:
    """(client_id, error) of the requests that ``validate`` finds invalid."""
    return checked.where(F.col("is_valid") == 0).select("client_id", error_text().alias("error"))


def expand_payload(df: DataFrame, required: Sequence[str], payload: str = "features", default: float | None = None) -> DataFrame:
    """One double column per required feature; unparsable or absent values become ``default``.

    Forms fill in 0.0; requests are validated first, so that nothing is left to fill.
    """
    parsed = {r: parse_value(F.try_element_at(col(payload), F.lit(r))) for r in required}
    values = parsed if default is None else {r: F.coalesce(v, F.lit(float(default))) for r, v in parsed.items()}
    rest = [col(c) for c in df.columns if c != payload]
    return df.select(*rest, *[e.alias(n) for n, e in values.items()])


def respond(scored: DataFrame, client: str, threshold: float) -> DataFrame:
    """(client_id, probability, prediction, threshold)."""
    return scored.select(
        col(client).cast("string").alias("client_id"),
        F.col(SCORE).alias("probability"),
        (F.col(SCORE) >= F.lit(threshold)).cast("int").alias("prediction"),
        F.lit(float(threshold)).alias("threshold"),
    )


def score_batch(model: Model, df: DataFrame, client: str, threshold: float) -> DataFrame:
    return respond(with_probability(model, df), client, threshold)


def score_requests(model: Model, requests: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Split requests (client_id, features map) into scored responses and rejections."""
    required = feature_list(model)
    checked = validate(requests, required)
    valid = expand_payload(checked.where(F.col("is_valid") == 1).drop("missing", "invalid", "is_valid"), required)
    return score_batch(model, valid, "client_id", threshold), rejection(checked)


def answer_requests(model: Model, requests: DataFrame, threshold: float, payload: str = "features") -> DataFrame:
    """(client_id, probability, prediction, threshold, error): every request answered in one pass.

    Each payload is parsed once. ``error`` is the rejection's text, empty for scored requests.
    """
    required = feature_list(model)
    values = F.array(*[parse_value(F.try_element_at(col(payload), F.lit(r))) for r in required])
    parsed = requests.select("client_id", col(payload).alias("__payload"), values.alias("__values"))
    names = [F.struct(F.lit(r).alias("name"), F.lit(i).alias("i")) for i, r in sorted(enumerate(required), key=lambda e: e[1])]
    given = lambda n: F.coalesce(F.map_contains_key("__payload", n["name"]), F.lit(False))
    bad = F.array(*names)
    missing = F.transform(F.filter(bad, lambda n: ~given(n)), lambda n: n["name"])
    invalid = F.transform(F.filter(bad, lambda n: given(n) & F.get("__values", n["i"]).isNull()), lambda n: n["name"])
    checked = parsed.withColumns({"missing": missing, "invalid": invalid}).withColumn(
        "is_valid", ((F.size("missing") == 0) & (F.size("invalid") == 0)).cast("int")
    )
    # Rejected requests go through the model with zeros; their result is not shown.
    ready = checked.select(
        "client_id", "is_valid", error_text().alias("error"), *[F.coalesce(F.get("__values", F.lit(i)), F.lit(0.0)).alias(r) for i, r in enumerate(required)]
    )
    scored = with_probability(model, ready)
    valid = F.col("is_valid") == 1
    return scored.select(
        F.col("client_id").cast("string").alias("client_id"),
        F.when(valid, F.col(SCORE)).alias("probability"),
        F.when(valid, (F.col(SCORE) >= F.lit(threshold)).cast("int")).alias("prediction"),
        F.when(valid, F.lit(float(threshold))).alias("threshold"),
        "error",
    )


def with_status(responses: DataFrame) -> DataFrame:
    return responses.withColumn("status", status_text(F.col("prediction")))


# ---- Fixed values: range rules of made-up records, the first match counts ----
RECORD_RULES = [
    (("DAYS",), -20000.0, 0.0),
    (("AMT", "CREDIT", "ANNUITY"), 0.0, 1000000.0),
    (("PERC", "RATE"), 0.0, 1.0),
    (("FLAG", "CODE"), "binary", None),
    (("pow",), 0.0, 100.0),
]
RECORD_DEFAULT = (0.0, 10.0)
# -------------------------------------------------------------------------------


def record_value(name: str, unit: Column) -> Column:
    """Turn a number in [0, 1) into a value in the range the name asks for."""
    for words, low, high in RECORD_RULES:
        if any(w in name for w in words):
            if low == "binary":
                return F.when(unit < 0.5, 0.0).otherwise(1.0)
            return F.lit(low) + unit * F.lit(high - low)
    low, high = RECORD_DEFAULT
    return F.lit(low) + unit * F.lit(high - low)


def synthetic_records(ids: DataFrame, key: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """One made-up record per id, reproducible from id, feature name and seed."""
    return ids.select(
        col(key), *[record_value(f, unit_interval(digest([col(key), f, seed]))).alias(f) for f in features]
    )
