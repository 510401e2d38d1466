import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import gradient, models

NAMES = ["a", "b", "c"]


def frame(spark, rows=1200, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)) * 4)
    y = (x[:, 0] + 0.5 * x[:, 1] + 2 * rng.normal(size=rows) > 0).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "k int, y int, a double, b double, c double")


@pytest.mark.parametrize("driver_bytes", [1 << 20, 0])
def test_boosting_equals_plain_boosting(spark, monkeypatch, driver_bytes):
    """With few values all splits are candidates, so the trees are those of ``pyspark.ml`` on the rows."""
    monkeypatch.setattr(gradient, "DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(gradient, "PART_CELLS", 100)
    monkeypatch.setattr(gradient, "REFRESH", 2)
    df = frame(spark).persist()
    model = models.train(df, NAMES, "y", "gradient_boosting", maxIter=5, maxDepth=3)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.withColumn("label", F.col("y").cast("double")))
    plain = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.1, maxBins=64).fit(vectors).transform(vectors)
    want = {r[0]: r[1] for r in plain.select("k", vector_to_array("probability")[1]).collect()}
    got = {r[0]: r[1] for r in models.with_probability(model, df).select("k", models.SCORE).collect()}
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)], atol=1e-9)


def test_samples_and_refused_parameters(spark):
    df = frame(spark, 300)
    first, second = (models.train(df, NAMES, "y", "gradient_boosting", maxIter=3, maxDepth=2, subsamplingRate=0.5) for _ in range(2))
    assert [t.feature for t in first.trees] == [t.feature for t in second.trees]
    assert all(50 < t.cover[0] < 250 for t in first.trees)
    for wrong in ({"maxDepth": 31}, {"stepSize": 0.0}, {"subsamplingRate": 1.5}):
        with pytest.raises(ValueError):
            models.train(df, NAMES, "y", "gradient_boosting", **wrong)


def test_one_job_for_a_level_of_a_tree(spark):
    """Ten more trees of three levels are at most thirty more jobs."""
    df = frame(spark, 300).persist()
    jobs = []
    for rounds in (1, 11):
        spark.sparkContext.setJobGroup(f"gradient{rounds}", "")
        models.train(df, NAMES, "y", "gradient_boosting", maxIter=rounds, maxDepth=3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gradient{rounds}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] - jobs[0] <= 30
