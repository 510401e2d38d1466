"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
that its predecessor kept. All but the last return the columns they were given.

Defined cases, for every stage: null and empty texts stay as they are unless the
classifier rejects them (scored as empty) and are packed as one closing id; rows
without an id stay; repeated rows are judged each, and rows that share an id are one
document to the near-duplicate stage; ties go to the smaller id; other columns are
carried along under their names (the stages' own begin with two underscores); an
empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import lines, minhash, packing, quality, secrets
from riskframe.llm.queries import tokenizer_path
from riskframe.llm.store import keep, sized


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with ``n_chars`` brought up to date."""
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.length("text").cast(kind))
    return docs.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_quality(docs, model, column="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; documents that had nothing else go."""
    out = lines.delete_repeated_lines(docs, runs="__runs")
    left = (F.size("__runs") == 0) | F.col("text").rlike(r"\S")
    return _with_length(out.where(left), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    copies = sized(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return _with_length(secrets.redact(docs, secrets.find_secrets(docs, planted=True)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("secret scan", hide_secrets),
    ("packing", pack_sequences),
]

#: The stages are models and hashes that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
