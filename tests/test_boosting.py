import numpy as np
import pytest
from oracle_check import duck
from pyspark.sql import functions as F

from riskframe.operators import boosting, metrics, models


def frame(spark, rows=600, seed=1, missing=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)), 1)
    z = 1.5 * x[:, 0] - (x[:, 1] > 0.3) + 0.5 * x[:, 0] * x[:, 2]
    y = (rng.random(rows) < 1 / (1 + np.exp(-z))).astype(float)
    lost = rng.random(rows) < missing
    x[lost & (y == 1), 1] = np.nan
    data = [(i, float(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "id bigint, y double, a double, b double, c double").repartition(3), x, y


def exact_trees(x, y, rounds, depth, rate=0.3, l2=1.0, min_hessian=1.0):
    """Greedy trees over every value and both sides for missing values; the margins after all rounds."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree, step = {}, np.zeros(len(y))

        def grow(rows, level, name):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-12, None)
            for f in range(x.shape[1] if level < depth else 0):
                v = x[rows, f]
                for cut in np.unique(v[~np.isnan(v)]):
                    for left_missing in (False, True):
                        left = (v <= cut) | (np.isnan(v) & left_missing)
                        hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                        if min(hl, hr) < min_hessian:
                            continue
                        gl, gr = g[rows][left].sum(), g[rows][~left].sum()
                        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, left_missing), left)
            tree[name] = best[1]
            if best[1] is None:
                step[rows] = -rate * total_g / (total_h + l2)
                return
            grow(rows[best[2]], level + 1, name + "l")
            grow(rows[~best[2]], level + 1, name + "r")

        grow(np.arange(len(y)), 0, "")
        margin = margin + step
        trees.append(tree)
    return trees, margin


def paths_of(tree, node=0, name=""):
    if tree.feature[node] < 0:
        return {name: None}
    return {
        name: (tree.feature[node], tree.threshold[node], tree.default_left[node]),
        **paths_of(tree, tree.left[node], name + "l"),
        **paths_of(tree, tree.right[node], name + "r"),
    }


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_second_order_equals_exact_greedy(spark, monkeypatch, missing):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    df, x, y = frame(spark, missing=missing)
    model = boosting.train_boosting(df, ["a", "b", "c"], "y", rounds=3, depth=3)
    trees, margin = exact_trees(x, y, 3, 3)
    for got, want in zip(model.trees, trees):
        found = paths_of(got)
        assert {k: v and (v[0], v[1]) for k, v in found.items()} == {k: v and v[:2] for k, v in want.items()}
    np.testing.assert_allclose(model.margins(x.T), margin, atol=1e-9)
    scored = {r.id: r.p for r in df.select("id", model.probability().alias("p")).collect()}
    np.testing.assert_allclose([scored[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_missing_values_choose_their_side(spark):
    rows = [(float(i % 7), 1.0) for i in range(70)] + [(None, 0.0) for _ in range(40)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = boosting.train_boosting(df, ["a"], "y", rounds=2, depth=2)
    p = 1 / (1 + np.exp(-model.margins(np.array([[3.0, np.nan]]))))
    assert p[0] > 0.7 and p[1] < 0.4


def test_weights_count_like_repeated_rows(spark):
    df, x, y = frame(spark, rows=200, missing=0.0)
    weighted = df.withColumn("w", F.when(F.col("id") % 3 == 0, 2.0).otherwise(1.0))
    repeated = df.union(df.where("id % 3 = 0"))
    one = boosting.train_boosting(weighted, ["a", "b"], "y", rounds=2, depth=3, weight="w")
    two = boosting.train_boosting(repeated, ["a", "b"], "y", rounds=2, depth=3)
    np.testing.assert_allclose(one.margins(x.T[:2]), two.margins(x.T[:2]), atol=1e-9)


def test_sketch_keeps_ranks():
    rng = np.random.default_rng(3)
    values, weights = rng.exponential(size=50_000), rng.random(50_000)
    v, w = np.empty(0), np.empty(0)
    for at in range(0, 50_000, 2_500):
        v, w = boosting.prune(np.r_[v, values[at : at + 2_500]], np.r_[w, weights[at : at + 2_500]], 512)
    assert w.sum() == pytest.approx(weights.sum())
    order = np.argsort(values)
    for cut, share in zip(boosting.cut_points(v, w, 64), np.arange(1, 65) / 64):
        true = weights[values <= cut].sum() / weights.sum()
        assert abs(true - share) < 20 / 512 + 1 / 64
    assert boosting.cut_points(v, w, 64)[-1] == values[order[-1]]
    assert boosting.cut_points(*boosting.prune(np.array([3.0, 1.0, 3.0]), np.ones(3), 8), 4).tolist() == [1.0, 3.0]


def ordered_margins(x, y, place, prefixes, trees, base):
    """Scores of every model, tree by tree, with plain loops over the fitted splits."""
    ends = [0.0, *prefixes, np.inf]
    margin = np.full((len(ends), len(y)), base)
    values = []
    for tree in trees:
        leaf = tree.leaves(x.T, False)
        step = np.zeros((len(ends), len(tree.feature)))
        for m, end in enumerate(ends):
            own = place < end
            p = 1 / (1 + np.exp(-margin[m]))
            for n in set(leaf[own].tolist()):
                rows = own & (leaf == n)
                step[m, n] = -0.1 * (p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + 3.0)
        margin = margin + step[:, leaf]
        values.append(step)
    return margin, values


def test_ordered_prefix_models(spark, monkeypatch):
    """Leaf values of every prefix model come from its own rows alone, also across refreshes."""
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, x, y = frame(spark, rows=500)
    model = boosting.train_boosting(
        df, ["a", "b", "c"], "y", kind="ordered", rounds=5, depth=3, learning_rate=0.1, l2=3.0, key="id", prefix_rows=50
    )
    place = np.array([r.p for r in df.select("id", boosting.order_place("id").alias("p")).orderBy("id").collect()])
    halvings = int(np.log2(500 / 50))
    prefixes = [0.5**j for j in range(halvings, 0, -1)]
    margin, values = ordered_margins(x, y, place, prefixes, model.trees, model.base)
    for tree, want in zip(model.trees, values):
        np.testing.assert_allclose(tree.value, want, atol=1e-9)
        assert len({(tree.feature[n], tree.threshold[n]) for n in range(1, 3)}) == 1  # one split per level
    np.testing.assert_allclose(model.margins(x.T), margin[-1], atol=1e-9)
    assert (model.trees[0].value[0] == 0).all()


def test_ordered_gradients_do_not_know_their_own_label():
    """The model that gives a row its gradient ends before the row."""
    ensemble = boosting._Ensemble(1, 0.0, (0.125, 0.25, 0.5))
    place = np.linspace(0, 0.999, 1000)
    ends = np.r_[0.0, ensemble.prefixes, np.inf]
    assert (ends[ensemble.row_model(place)] <= place).all()


@pytest.mark.parametrize("algorithm", list(models.BOOSTING))
def test_learns_and_scores(spark, algorithm):
    train, _, _ = frame(spark, 1500, 5)
    test, _, _ = frame(spark, 800, 6)
    model = models.train(train, ["a", "b", "c"], "y", algorithm, rounds=15, depth=4)
    scored = models.with_probability(model, test)
    assert metrics.auc(scored, models.SCORE, "y") > 0.8
    assert models.feature_list(model) == ["a", "b", "c"]
    share = model.importance()
    assert sum(share.values()) == pytest.approx(1) and share["a"] > share["c"]


def test_edges(spark):
    df, _, _ = frame(spark, 50)
    empty = boosting.train_boosting(df.where("id < 0"), ["a"], "y", rounds=2)
    assert empty.trees == [] and empty.margins(np.array([[1.0]])) == 0
    for kind in ("second_order", "ordered"):
        one = boosting.train_boosting(df.where("y = 1"), ["a", "b"], "y", kind=kind, rounds=2)
        assert one.margins(np.array([[0.0], [0.0]]))[0] > 5
        lost = boosting.train_boosting(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", kind=kind, rounds=1)
        assert np.isfinite(lost.margins(np.array([[np.nan]]))).all()
    with pytest.raises(ValueError):
        boosting.train_boosting(df, ["a"], "y", kind="other")


def test_ordered_codes(spark, sf_dir):
    from riskframe.plans.roles import loans

    df = loans(spark, sf_dir).select("loan_id", "priority", "y")
    got = boosting.ordered_codes(df, "loan_id", "priority", "y", prior=0.25, strength=2.0, part_rows=50)
    rows = {r.loan_id: r.code for r in got.collect()}
    whole = boosting.ordered_codes(df, "loan_id", "priority", "y", prior=0.25, strength=2.0)
    assert {r.loan_id: r.code for r in whole.collect()} == pytest.approx(rows, abs=1e-12)
    # Turning a row's label round changes later rows' codes, never its own.
    chosen = sorted(rows)[3]
    turned = df.withColumn("y", F.when(F.col("loan_id") == chosen, 1 - F.col("y")).otherwise(F.col("y")))
    after = {r.loan_id: r.code for r in boosting.ordered_codes(turned, "loan_id", "priority", "y", 0.25, 2.0).collect()}
    assert after[chosen] == rows[chosen] and after != rows
    final = boosting.final_codes(df, spark.createDataFrame([("none",)], "priority string"), "priority", "y", 0.25).first()
    assert final.code == pytest.approx(0.25)


def test_blocks_of_one_part_are_dealt_to_all_cores(spark, monkeypatch):
    parts, stored = [], boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, name: (parts.append(df.rdd.getNumPartitions()), stored(df, name))[1])
    df, x, _ = frame(spark, rows=400)
    one = boosting.train_boosting(df.coalesce(1), ["a", "b", "c"], "y", kind="ordered", rounds=2, depth=2, key="id")
    assert parts[0] == spark.sparkContext.defaultParallelism > 1
    # One group or many, and scores kept from tree to tree or made anew: the same trees.
    monkeypatch.setattr(boosting, "GROUP_BYTES", 1)
    monkeypatch.setattr(boosting, "REFRESH", 1)
    many = boosting.train_boosting(df, ["a", "b", "c"], "y", kind="ordered", rounds=2, depth=2, key="id")
    np.testing.assert_allclose(one.margins(x.T), many.margins(x.T), atol=1e-9)


def test_rows_keep_only_the_scores_they_need(spark):
    """Scores of the models from the row's own place on: about three a row, however many prefixes there are."""
    from riskframe.operators.ordered import OrderedEnsemble, added

    rng = np.random.default_rng(2)
    prefixes = tuple(0.5**j for j in range(10, 0, -1))
    ensemble, place = OrderedEnsemble(1, 0.1, prefixes), np.sort(rng.random(20_000))
    kept = ensemble.empty(place)
    assert 2.9 < sum(m.size for m in kept) / len(place) < 3.1
    values, leaf = rng.random((12, 4)), rng.integers(0, 4, len(place))
    first = added(kept, values, leaf)
    again = ensemble.stored(ensemble.packed(first), place)
    model = ensemble.row_model(place)
    np.testing.assert_array_equal(np.concatenate([m[0] for m in again]), 0.1 + values[model, leaf])
    np.testing.assert_array_equal(np.concatenate([m[-1] for m in again]), 0.1 + values[-1, leaf])


@pytest.mark.parametrize("group_bytes", [64 << 20, 20_000])
def test_ordered_weights_and_samples(spark, monkeypatch, group_bytes):
    """A weight of two counts as much as both copies of a row; a sampled tree is the same again."""
    monkeypatch.setattr(boosting, "GROUP_BYTES", group_bytes)
    df, x, _ = frame(spark, rows=300)
    twice = df.withColumn("w", F.lit(2.0))
    one = boosting.train_boosting(twice, ["a", "b"], "y", kind="ordered", rounds=2, depth=3, weight="w", key="id", prefix_rows=50)
    two = boosting.train_boosting(df.unionByName(df), ["a", "b"], "y", kind="ordered", rounds=2, depth=3, key="id", prefix_rows=100)
    np.testing.assert_allclose(one.margins(x.T[:2]), two.margins(x.T[:2]), atol=1e-9)
    sampled = [boosting.train_boosting(df, ["a", "b"], "y", kind="ordered", rounds=2, depth=3, key="id", subsampling=0.5) for _ in range(2)]
    np.testing.assert_array_equal(sampled[0].margins(x.T[:2]), sampled[1].margins(x.T[:2]))
    assert sampled[0].trees[0].cover != one.trees[0].cover


def test_ordered_boosting_is_one_job_a_level(spark):
    df, jobs = frame(spark, rows=300)[0].persist(), []
    for rounds in (1, 9):
        spark.sparkContext.setJobGroup(f"ordered{rounds}", "")
        boosting.train_boosting(df, ["a", "b"], "y", kind="ordered", rounds=rounds, depth=3, key="id")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ordered{rounds}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] - jobs[0] <= 8 * 4  # three levels and the leaf values
