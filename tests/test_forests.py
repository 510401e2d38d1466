import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import cells, forests, metrics, models, search

NAMES = ["a", "b", "c"]


def frame(spark, rows=1200, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)) * 4)
    y = (x[:, 0] + 0.5 * x[:, 1] + 2 * rng.normal(size=rows) > 0).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "k long, y int, a double, b double, c double").persist()


def rows_of(df):
    table = df.toPandas()
    return table["y"].to_numpy(), table[NAMES].to_numpy(float).T


def mean_share(trees, values):
    return np.mean([t.value[0][t.leaves(values, False)] for t in trees], axis=0)


@pytest.mark.parametrize("shared", [64 << 20, 0])
@pytest.mark.parametrize("least", [1, 7])
def test_one_tree_equals_plain_tree(spark, monkeypatch, shared, least):
    """All rows, all features and few values: the tree is that of ``pyspark.ml``, joined siblings included."""
    monkeypatch.setattr(forests, "SHARED_BYTES", shared)
    monkeypatch.setattr(forests, "LOCAL", 150)
    df = frame(spark)
    blocks, cuts, classes = cells.counted(df, "y", NAMES)
    (trees,) = forests.grow_forests(blocks, cuts, classes, [forests.Setting(1, 5, least, bootstrap=False)])
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.withColumn("label", F.col("y").cast("double")))
    plain = RandomForestClassifier(numTrees=1, maxDepth=5, maxBins=64, minInstancesPerNode=least, bootstrap=False).fit(vectors).transform(vectors)
    want = {r[0]: r[1] for r in plain.select("k", vector_to_array("probability")[1]).collect()}
    got = mean_share(trees, rows_of(df.orderBy("k"))[1])
    np.testing.assert_allclose(got, [want[k] for k in sorted(want)], atol=1e-9)


def test_both_ways_give_the_same_forests(spark, monkeypatch):
    df = frame(spark)
    blocks, cuts, classes = cells.counted(df, "y", NAMES)
    settings = [forests.Setting(6, 5, 1), forests.Setting(9, 7, 3)]
    near = forests.grow_forests(blocks, cuts, classes, settings)
    monkeypatch.setattr(forests, "SHARED_BYTES", 0)
    monkeypatch.setattr(forests, "LOCAL", 120)
    monkeypatch.setattr(forests, "HISTOGRAM_BYTES", 20_000)  # some nodes in a pass
    monkeypatch.setattr(forests, "MOVED_BYTES", 3_000)
    monkeypatch.setattr(forests, "STEP", 50)
    apart = forests.grow_forests(blocks, cuts, classes, settings)
    values = rows_of(df)[1]
    for one, other in zip(near, apart):
        assert len(one) == len(other)
        for a, b in zip(one, other):
            assert len(a.feature) == len(b.feature)
            np.testing.assert_array_equal(a.value[0][a.leaves(values, False)], b.value[0][b.leaves(values, False)])


def test_forest_agrees_with_a_plain_forest(spark):
    df = frame(spark, 4000)
    blocks, cuts, classes = cells.counted(df, "y", NAMES)
    (trees,) = forests.grow_forests(blocks, cuts, classes, [forests.Setting(60, 6)])
    model = models.train(df, NAMES, "y", "random_forest", numTrees=60, maxDepth=6)
    want = np.array([r[0] for r in models.with_probability(model, df.orderBy("k")).select(models.SCORE).collect()])
    got = mean_share(trees, rows_of(df.orderBy("k"))[1])
    assert np.corrcoef(got, want)[0, 1] > 0.99 and abs(got - want).mean() < 0.03
    assert 0.9 < sum(t.cover[0] for t in trees) / 60 / 4000 < 1.1


def test_search_scores_held_out_rows_of_each_fold(spark):
    """The score of a trial is the mean best score of forests fitted outside each fold, from the rows themselves."""
    df = frame(spark, 900).select("k", "y", *NAMES)
    got = search.random_search(df, "k", "y", NAMES, trials=2, ranges={"numTrees": (3, 6), "maxDepth": (2, 5)}).collect()
    drawn = search.draw_params({"numTrees": (3, 6), "maxDepth": (2, 5)}, 2)
    data = search._fold_frame(df, "k", "y", NAMES, 3, 42).withColumnRenamed("__label", "y").persist()
    share = data.agg(F.avg("y")).first()[0]
    for run, params in zip(got, drawn):
        scores = []
        for fold in range(3):
            blocks, cuts, classes = cells.counted(data.where(F.col("fold") != fold), "y", NAMES)
            (trees,) = forests.grow_forests(blocks, cuts, classes, [forests.Setting(**params)])
            y, values = rows_of(data.where(F.col("fold") == fold))
            scored = spark.createDataFrame([(int(t), float(p)) for t, p in zip(y, mean_share(trees, values))], "y int, p double")
            scores.append(metrics.best_threshold(scored, "p", "y", share)[1])
        assert run.metrics["cv_normalized_score"] == pytest.approx(np.mean(scores), abs=1e-9)


def test_search_does_not_fit_each_forest_alone(spark):
    """More and larger forests need no more jobs."""
    df, jobs = frame(spark, 300), []
    for name, trials, trees in (("few", 1, 2), ("many", 4, 20)):
        spark.sparkContext.setJobGroup(name, name)
        search.random_search(df, "k", "y", NAMES, trials=trials, ranges={"numTrees": (trees, trees), "maxDepth": (trees // 2, trees // 2)}).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 3


def test_other_parameters_still_reach_the_plain_forest(spark):
    df = frame(spark, 300)
    out = search.random_search(df, "k", "y", NAMES, trials=1, ranges={"numTrees": (2, 3), "subsamplingRate": (0.5, 0.9)}).collect()
    assert "cv_normalized_score" in out[0].metrics and "subsamplingRate" in out[0].params


def test_refused(spark):
    df = frame(spark, 200)
    for wrong in ({"numTrees": 0}, {"maxDepth": 31}, {"minInstancesPerNode": 0}):
        with pytest.raises(ValueError):
            forests.Setting(**wrong)
    gaps = df.withColumn("b", F.when(F.col("k") > 3, F.col("b")))
    out = search.random_search(gaps, "k", "y", NAMES, trials=2, ranges={"numTrees": (2, 3)}).collect()
    assert all("error" in r.params and not r.metrics for r in out)
