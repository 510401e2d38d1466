import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from riskframe.operators import cells, select


def frame(spark, rows=1500, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=rows) > 0).astype(int)
    return spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x)], "y int, a double, b double, c double").coalesce(1)


@pytest.mark.parametrize("local", [100_000, 200])
def test_importance_agrees_with_a_plain_forest(spark, monkeypatch, local):
    monkeypatch.setattr(cells, "LOCAL", local)
    df = frame(spark)
    got = select.forest_importance(df, "y", ["a", "b", "c"], trees=12)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    want = RandomForestClassifier(numTrees=12, maxDepth=30, seed=42).fit(vectors).featureImportances.toArray()
    assert list(got) == ["a", "b", "c"]
    np.testing.assert_allclose(list(got.values()), want, atol=0.04)
    if local == 100_000:
        assert got == select.forest_importance(df, "y", ["a", "b", "c"], trees=12)


def test_grown_gains_equal_exhaustive_search():
    rng = np.random.default_rng(5)
    bins, labels = rng.integers(0, 6, (2, 80)).astype(np.uint8), rng.integers(0, 2, 80)
    copies = rng.integers(1, 4, 80)
    want = np.zeros(2)

    def purity(rows):
        c = [copies[rows][labels[rows] == k].sum() for k in (0, 1)]
        return (c[0] ** 2 + c[1] ** 2) / sum(c)

    def grow(rows, level):
        best = (1e-9, None)
        for f in range(2) if level else ():
            for cut in range(6):
                left = bins[f, rows] <= cut
                if left.any() and not left.all():
                    gain = purity(rows[left]) + purity(rows[~left]) - purity(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, left)
        if best[1] is not None:
            want[best[1]] += best[0]
            grow(rows[best[2]], level - 1)
            grow(rows[~best[2]], level - 1)

    grow(np.arange(80), 4)
    np.testing.assert_allclose(cells.grown_gains(bins, labels, copies, 4, 2, 2, rng), want)


def test_rows_with_gaps_are_refused(spark):
    df = spark.createDataFrame([(1, 2.0), (0, None)], "y int, a double")
    with pytest.raises(ValueError):
        select.forest_importance(df, "y", ["a"])
