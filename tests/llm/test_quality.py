import zlib

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import quality


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.with_quality(docs, model).withColumn("held", quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").select("doc_id", "quality", "score", "held").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held]
    right = np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in held])
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert right >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert min(good) >= quality.THRESHOLD  # clean documents stay
    again = quality.with_quality(docs, quality.fit(docs.repartition(5), labels))
    a, b = ({r.doc_id: r.score for r in df.select("doc_id", "score").collect()} for df in (scored, again))
    assert a == b  # whatever the partitions


def test_odd_rows_and_labels(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "text"), (5, "same"), (5, "same"), (6, "word " * 50_000), (7, "\x00 \U0001f642 ***")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "y", "slot")})
    labels = spark.createDataFrame([(4, 1), (7, 0), (4, 1), (None, 1), (6, 5), (3, None)], "doc_id long, quality int")
    for known, constant in ((labels, None), (labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        out = quality.with_quality(docs, quality.fit(docs, known), column="p")
        got = [r.p for r in out.collect()]
        assert len(got) == len(rows) and all(0 <= p <= 1 for p in got)
        assert constant is None or set(got) == {constant}
    empty = docs.limit(0)
    assert quality.with_quality(empty, quality.fit(empty, labels), column="p").count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c w"), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original = quality.train_network
    quality.train_network = lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        quality.fit(docs, labels, train_rows=40)
    finally:
        quality.train_network = original
    assert seen == [40]


def test_temperature_and_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=900) > 0).astype(int)
    model = quality.QualityModel(None, quality.train_network(x, y), 0.5)
    p = model.probabilities(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.85
    assert abs(p.mean() - y.mean()) < 0.05
