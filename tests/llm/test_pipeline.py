import brute
import corpus_pipeline
from pyspark.sql import functions as F

from riskframe.llm.store import keep

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
            assert out.where("n_chars <> length(text)").isEmpty()
        if name == "near-duplicate removal":
            old = {r.doc_id: r.text for r in docs.collect()}
            want = brute.near_duplicates(list(old.items()))
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        if name == "secret scan":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            assert not out.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count()
        before[name], docs = docs, out
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before["packing"].collect()}
    run = corpus_pipeline.run(spark, SF)
    assert run.exceptAll(docs).isEmpty() and docs.exceptAll(run).isEmpty()


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "stage")
        assert docs.count() == 0
