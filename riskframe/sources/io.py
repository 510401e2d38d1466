"""Tables in and out: CSV, Parquet, JSON records, split-orient JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import col, nan_frame_to_null

# ---- Fixed values: texts a CSV reader takes as missing ----
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# -----------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and a declared schema; the usual missing-value texts become NULL."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared.fields])
    raw = spark.read.csv(path, header=True, schema=as_text, enforceSchema=False, quote='"', escape='"')
    return raw.select(
        *[
            F.when(~col(f.name).isin(MISSING_TEXTS), col(f.name)).cast(f.dataType).alias(f.name)
            for f in declared.fields
        ]
    )


def inferred_csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column types by scanning the file; a helper for writing down a schema."""
    return spark.read.csv(path, header=True, inferSchema=True).schema


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_frame_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 10_000) -> DataFrame:
    """Debug mode: the first rows in key order, so that reruns agree."""
    return df.orderBy(*[col(o) for o in order_by]).limit(n)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def parse_record(c: Column, schema: T.StructType | str) -> Column:
    return F.from_json(c, schema)


SPLIT_SCHEMA = "struct<columns:array<string>,data:array<array<double>>>"


def to_split_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Split-orient document of one row: ``{"columns": [...], "data": [[...]]}``."""
    return F.to_json(
        F.struct(
            F.array(*[F.lit(c) for c in columns]).alias("columns"),
            F.array(F.array(*[col(c).cast("double") for c in columns])).alias("data"),
        )
    )


def read_split_json(documents: DataFrame, json_col: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of split-orient documents; columns are matched by name."""
    parsed = documents.select(*[col(k) for k in keep], F.from_json(col(json_col), SPLIT_SCHEMA).alias("d"))
    rows = parsed.select(*[col(k) for k in keep], F.col("d.columns").alias("names"), F.explode("d.data").alias("row"))
    return rows.select(
        *[col(k) for k in keep],
        *[F.get(F.col("row"), (F.array_position("names", c) - 1).cast("int")).alias(c) for c in columns],
    )


def write_importance_json(importance: DataFrame, path: str) -> None:
    """Importance records, largest first (one row per feature)."""
    importance.orderBy(F.col("importance").desc(), "feature").coalesce(1).write.mode("overwrite").json(path)


def read_importance_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="feature string, importance double")
