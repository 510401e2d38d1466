import numpy as np
import pytest

from riskframe.operators import sample, search
from riskframe.operators.metrics import auc
from riskframe.operators.models import SCORE, train, with_probability

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(700) < 0.12).astype(int)
    x = rng.normal(size=(700, 2)) * [1.0, 30.0] + np.outer(y, [0.8, 20.0])
    rows = [(i, int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double").persist()
    return df.where("id % 4 > 0"), df.where("id % 4 = 0")


def test_runs_equal_single_fits(spark, sides):
    """Every run has the rows of its resampled table and the area of a regression fitted to them alone."""
    fit, test = sides
    runs = search.run_balance_grid(fit, test, "id", "y", FEATURES, targets=[0.05, 0.3]).collect()
    assert len(runs) == 6
    for run in runs:
        share, technique = float(run.params["target_balance"]), run.params["technique"]
        if share == 0.05:
            assert ("error" in run.params) == (technique == "undersample") and ("skipped" in run.params) == (technique != "undersample")
            assert not run.metrics
            continue
        rows = sample.rebalance(fit, "id", "y", FEATURES, technique, share)
        sizes = sample.class_sizes(rows, "y")
        assert run.metrics["resampled_train_rows"] == sum(sizes.values())
        assert run.metrics["final_resampled_balance"] == pytest.approx(sizes[1] / sum(sizes.values()))
        single = auc(with_probability(train(rows, FEATURES, "y", max_iter=1000), test), SCORE, "y")
        assert run.metrics["test_roc_auc"] == pytest.approx(single, abs=2e-4)


def test_parts_make_up_the_balances(spark, sides):
    """The shared rows of a balance are those of its own resampling, synthetic ones included."""
    fit, _ = sides
    sizes = sample.class_sizes(fit, "y")
    wanted = [("undersample", 0.3), ("oversample", 0.3), ("hybrid", 0.3), ("oversample", 0.5), ("hybrid", 0.5)]
    cuts = [sample.balance_cuts(sizes, *w) for w in wanted]
    rows, members = sample.nested_balances(fit, "id", "y", FEATURES, cuts, sizes)
    pooled = rows.toPandas()
    for (technique, share), parts in zip(wanted, members):
        own = sample.rebalance(fit, "id", "y", FEATURES, technique, share).select("y", *FEATURES).toPandas()
        mine = pooled[pooled["part"].isin(parts)][["y", *FEATURES]]
        np.testing.assert_array_equal(*(f.sort_values(["y", *FEATURES]).to_numpy(dtype=float) for f in (mine, own)))


def test_jobs_do_not_grow_with_the_runs(spark, sides):
    def jobs(name, targets):
        spark.sparkContext.setJobGroup(name, name)
        search.run_balance_grid(*sides, "id", "y", FEATURES, targets=targets).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    try:
        few, many = jobs("few", [0.2]), jobs("many", [0.2, 0.3, 0.4, 0.5])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 25  # a few more steps of the fit, not 9 more fits and areas
