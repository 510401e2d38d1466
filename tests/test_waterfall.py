from pyspark.sql import functions as F

from riskframe.operators import explain


def test_parts_of_a_waterfall_follow_the_entries(spark, monkeypatch):
    long = spark.range(400).select(
        F.col("id").alias("k"), F.lit(1).alias("class"), F.lit(0.5).alias("base"),
        F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("feature"), ((F.col("id") * (i + 3)) % 17 - 8.0).alias("contribution")) for i in range(10)])).alias("s"),
    ).select("k", "class", "base", "s.*")
    want = sorted(map(tuple, explain.waterfall(long, "k", 7).collect()))
    monkeypatch.setattr(explain, "TASK_ENTRIES", 100)
    got = explain.waterfall(long, "k", 7)
    assert got.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, got.collect())) == want and len(want) == 400 * 8
    assert all(abs(r["final"] - 0.5 - sum((r["k"] * (i + 3)) % 17 - 8.0 for i in range(10))) < 1e-9 for r in got.collect())
