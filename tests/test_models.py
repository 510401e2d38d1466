"""Scores, scalers, models, attribution, scoring and the stream."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import attribution, explain, metrics, models, runs, scale, score, search
from riskframe.plans.stats_catalog import MODEL_FEATURES, model_frame
from riskframe.sources import io
from riskframe.streaming.score import read_responses, rejected_stream, score_stream


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    y = (rng.random(800) < 0.2).astype(int)
    p = np.round(np.clip(rng.random(800) * 0.7 + y * 0.25, 0, 1), 2)
    return spark.createDataFrame(pd.DataFrame({"y": y, "p": p})).persist(), y, p


def plain_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def plain_cost(y, hit, share):
    tp, fp = ((y == 1) & hit).sum(), ((y == 0) & hit).sum()
    fn, tn = ((y == 1) & ~hit).sum(), ((y == 0) & ~hit).sum()
    return (2 * tp + tn - fp - 10 * fn) / len(y) / max(share, 1e-9)


@pytest.mark.parametrize("buckets", [1, 6])
def test_auc_with_ties(scored, buckets):
    df, y, p = scored
    assert metrics.auc_table(df, "p", "y", buckets=buckets).first()["auc"] == pytest.approx(plain_auc(y, p), abs=1e-12)


def test_sweep_is_first_maximum(scored):
    df, y, p = scored
    best, top = 0.5, -math.inf
    for t in metrics.THRESHOLDS:
        value = plain_cost(y, p >= t, 0.2)
        if value > top:
            best, top = t, value
    assert metrics.best_threshold(df, "p", "y", 0.2) == (best, pytest.approx(top))


def test_reached_thresholds_at_equality(spark):
    values = [0.0, 1.0, 0.005, 0.995, *metrics.THRESHOLDS, *[math.nextafter(t, 0) for t in metrics.THRESHOLDS]]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for grid in (metrics.THRESHOLDS, [0.1, 0.15, 0.7]):
        got = df.select("p", metrics.thresholds_reached(F.col("p"), grid).alias("n")).collect()
        assert all(r["n"] == sum(r["p"] >= t for t in grid) for r in got)


def test_single_class_is_defined(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.9)], "y int, p double")
    row = metrics.accuracy_recall(metrics.confusion(df, "p", "y", 0.5)).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["recall"]) == (1, 1, 0, 0, 0.0)
    assert metrics.auc(df, "p", "y") == 0.0


# mean 3.75, population variance 13.1875; quartiles 1.75, 2, 4
SCALED = {
    "standard": [(v - 3.75) / math.sqrt(13.1875) for v in (1, 2, 2, 10)],
    "minmax": [0, 1 / 9, 1 / 9, 1],
    "robust": [(v - 2) / 2.25 for v in (1, 2, 2, 10)],
    "none": [1, 2, 2, 10],
}


@pytest.mark.parametrize("how,want", SCALED.items())
def test_scalers(spark, how, want):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 3.0), (10.0, 3.0)], "a double, flat double")
    got = scale.scale(df, [], ["a", "flat"], how)[0].toPandas().sort_values("a")
    assert list(got["a"]) == pytest.approx(want, abs=1e-12)
    assert how == "none" or (got["flat"] == 0).all()
    with pytest.raises(ValueError):
        scale.fit_scaler(df, ["a"], "other")


def test_logreg_minimises_the_penalised_loss(spark):
    """The gradient of C * loss + |w|^2 / 2 vanishes at the fitted weights."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = models.train(df, ["a", "b"], "y", "logreg", c=0.5)
    fitted = model.stages[-1]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(0.5 * z.T @ (p - y) + w).max() < 1e-2


@pytest.fixture(scope="module")
def loans(spark, sf_dir):
    return model_frame(spark, sf_dir).persist()


def shapley_by_subsets(nodes, output, x, n_features):
    """Shapley values of the path-dependent expectation, by all subsets."""

    def expect(i, known):
        node = nodes[i]
        if node["left"] < 0:
            return output(node)
        if node["feature"] in known:
            return expect(node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], known)
        return sum(nodes[c]["n"] / node["n"] * expect(c, known) for c in (node["left"], node["right"]))

    phi = np.zeros(n_features)
    for f in range(n_features):
        others = [g for g in range(n_features) if g != f]
        for size in range(n_features):
            for subset in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(n_features - size - 1) / math.factorial(n_features)
                phi[f] += weight * (expect(0, {*subset, f}) - expect(0, set(subset)))
    return phi


def test_shapley_against_all_subsets(spark, loans, monkeypatch):
    model = models.train(loans, MODEL_FEATURES, "y", "random_forest", numTrees=3, maxDepth=4)
    forest = model.stages[-1]
    trees, constant = attribution.path_trees(forest, spark)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 4))
    got = attribution.tree_shapley(x, trees)[:, 1, :]

    def share_of_ones(node):
        stats = np.array(node["stats"])
        return stats[1] / stats.sum()

    monkeypatch.setattr(attribution, "ROWS", 4)
    assert np.allclose(attribution.tree_shapley(x, trees)[:, 1, :], got, atol=1e-12)
    nodes = attribution.node_table(spark, forest)
    for i in range(len(x)):
        want = sum(shapley_by_subsets(t, share_of_ones, x[i], 4) for t in nodes) / len(nodes)
        assert got[i] == pytest.approx(want, abs=1e-10)


def random_tree(rng, depth, features):
    """A tree whose paths repeat features, with counts."""
    rows = []

    def grow(level, cover):
        me = len(rows)
        rows.append(None)
        if level == 0 or cover < 2 or rng.random() < 0.1:
            v = rng.normal()
            rows[me] = (-1, 0.0, -1, -1, False, cover, (-v, v))
        else:
            first = int(rng.integers(1, cover))
            sides = grow(level - 1, first), grow(level - 1, cover - first)
            rows[me] = (int(rng.integers(features)), rng.normal(), *sides, bool(rng.integers(2)), cover, (0.0, 0.0))
        return me

    grow(depth, 3000)
    return attribution.PathTree(*[np.array(c) for c in zip(*rows)])


def test_shapley_of_deep_trees_with_repeated_features_and_missing_values():
    rng = np.random.default_rng(2)
    for depth, features in ((1, 1), (5, 3), (9, 5), (14, 6)):
        tree = random_tree(rng, depth, features)
        nodes = [
            {"left": int(tree.left[n]), "right": int(tree.right[n]), "feature": int(f), "threshold": tree.threshold[n], "n": tree.cover[n], "v": tree.value[n, 1]}
            for n, f in enumerate(tree.feature)
        ]
        x = rng.normal(size=(3, features))
        got = attribution.tree_shapley(x, [tree])
        for i in range(len(x)):
            want = shapley_by_subsets(nodes, lambda node: node["v"], x[i], features)
            assert got[i, 1] == pytest.approx(want, abs=1e-9) and got[i, 0] == pytest.approx(-want, abs=1e-9)
        # A missing value goes where the tree sends it.
        lost = x.copy()
        lost[:, 0] = np.nan
        for side in (True, False):
            tree.missing_left[:] = side
            there = x.copy()
            there[:, 0] = -1e9 if side else 1e9
            assert attribution.tree_shapley(lost, [tree]) == pytest.approx(attribution.tree_shapley(there, [tree]))


@pytest.mark.parametrize("algorithm,params", [("random_forest", {"numTrees": 6, "maxDepth": 5}), ("gradient_boosting", {"maxIter": 4, "maxDepth": 3}), ("logreg", {}), ("second_order_boosting", {"rounds": 4, "depth": 4}), ("ordered_boosting", {"rounds": 4, "depth": 4})])
def test_contributions_add_up(loans, algorithm, params):
    model = models.train(loans, MODEL_FEATURES, "y", algorithm, **params)
    long = explain.contributions(model, loans, "loan_id")
    total = long.where("class = 1").groupBy("loan_id").agg((F.first("base") + F.sum("contribution")).alias("total"))
    both = total.join(models.with_probability(model, loans), "loan_id").toPandas()
    p = both[models.SCORE]
    want = p if algorithm == "random_forest" else np.log(p / (1 - p))
    assert np.allclose(both["total"], want, atol=1e-8)


def test_answers_in_one_pass_equal_the_two_tables(spark, loans):
    rows = [("ok", {"score": "1", "amount_noise": "2.5", "age": "true", "grade": "3"}), ("missing", {"score": "1"}), ("text", {"score": "x", "amount_noise": "2", "age": "1", "grade": None}),
            ("empty", {}), ("none", None), ("extra", {"score": "1", "amount_noise": "2", "z": "9", "age": "0", "grade": "NaN"}), ("more", {"z": "1", "score": "-1e3", "amount_noise": "2", "age": "4", "grade": "1"})]
    requests = spark.createDataFrame(rows, "client_id string, features map<string,string>")
    for model in (models.LinearModel(tuple(MODEL_FEATURES), (0.1, 0.2, -0.3, 0.4)), models.train(loans, MODEL_FEATURES, "y", "logreg", max_iter=5)):
        answered, rejected = score.score_requests(model, requests, 0.5)
        want = {r.client_id: (r.probability, r.prediction, r.threshold, "") for r in answered.collect()}
        want |= {r.client_id: (None, None, None, r.error) for r in rejected.collect()}
        assert {r.client_id: tuple(r)[1:] for r in score.answer_requests(model, requests, 0.5).collect()} == want


def test_payload_cases(spark):
    rows = [("ok", {"a": "1", "b": "2.5"}), ("missing", {"a": "1"}), ("text", {"a": "x", "b": "2"}), ("empty", {}), ("extra", {"a": "1", "b": "2", "z": "9"})]
    df = spark.createDataFrame(rows, "client_id string, features map<string,string>")
    got = {r["client_id"]: r for r in score.validate(df, ["a", "b"]).collect()}
    assert {k: r["is_valid"] for k, r in got.items()} == {"ok": 1, "missing": 0, "text": 0, "empty": 0, "extra": 1}
    assert got["empty"]["missing"] == ["a", "b"] and got["text"]["invalid"] == ["a"]
    values = {r["client_id"]: (r["a"], r["b"]) for r in score.expand_payload(df, ["a", "b"], default=0.0).collect()}
    assert values["text"] == (0.0, 2.0) and values["missing"] == (1.0, 0.0)
    more = [("nan", {"a": "NaN", "b": "1"}), ("null", {"a": None, "b": "x"}), ("truth", {"a": "true", "b": "-1e3"}), ("none", None)]
    checked = score.validate(spark.createDataFrame(more, df.schema), ["b", "a"])
    assert {r["client_id"]: (r["is_valid"], r["invalid"]) for r in checked.collect()} == {
        "nan": (0, ["a"]), "null": (0, ["a", "b"]), "truth": (1, []), "none": (0, [])
    }
    errors = {r["client_id"]: r["error"] for r in score.rejection(checked).collect()}
    assert errors == {"nan": "not a number in: a", "null": "not a number in: a, b", "none": "no value for: a, b"}


def test_stream_equals_batch(spark, loans, tmp_path):
    model = models.train(loans, MODEL_FEATURES, "y", "logreg")
    payload = F.create_map(*[x for c in MODEL_FEATURES for x in (F.lit(c), F.col(c).cast("string"))])
    requests = loans.select(F.col("loan_id").cast("string").alias("client_id"), payload.alias("features"))
    broken = requests.limit(3).withColumn("client_id", F.concat(F.lit("bad"), "client_id")).withColumn(
        "features", F.map_filter("features", lambda k, v: k != "age")
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests.unionByName(broken).repartition(4).write.json(folder)
    score_stream(spark, model, folder, out, 0.13)
    batch, rejected = score.score_requests(model, requests.unionByName(broken), 0.13)
    streamed = read_responses(spark, out)
    assert streamed.count() == loans.count() and rejected.count() == 3
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    rejected_stream(spark, MODEL_FEATURES, folder, str(tmp_path / "bad"))
    errors = spark.read.parquet(str(tmp_path / "bad"))
    assert {r["error"] for r in errors.collect()} == {"no value for: age"}


def test_algorithm_grid_and_compare(spark, loans):
    grid = search.run_algorithm_grid(
        loans, loans, "loan_id", "y", MODEL_FEATURES, balances=["init", 0.15],
        algorithms={"logreg": {}, "random_forest": {"numTrees": 5, "maxDepth": 4}},
    )
    assert grid.count() == 4
    ranked = runs.compare_runs(grid, "test_auc").orderBy("position").collect()
    assert ranked[0]["position"] == 1 and ranked[0]["value"] >= ranked[-1]["value"]


def test_random_search_records_failures(loans):
    out = search.random_search(
        loans, "loan_id", "y", MODEL_FEATURES, ranges={"numTrees": (2, 3), "maxDepth": (40, 50)}, trials=1
    ).collect()
    assert "error" in out[0]["params"] and not out[0]["metrics"]


def test_csv_missing_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x,name\n1,NA,abc\n2,1.5,\n3,nan,N/A\n")
    got = io.read_csv(spark, str(tmp_path / "a.csv"), "k int, x double, name string").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, "abc"), (2, 1.5, None), (3, None, None)]


def test_registered_grids_use_the_reference_sizes(monkeypatch):
    """Nothing but the data and the column names is given, so the library's defaults hold."""
    import inspect

    from riskframe.plans import analytics_catalog, models_catalog

    seen = {}

    def note(module, name):
        kept = inspect.signature(getattr(module, name))
        monkeypatch.setattr(module, name, lambda *a, **k: seen.update({name: kept.bind(*a, **k).arguments}))

    for catalog in (models_catalog, analytics_catalog):
        monkeypatch.setattr(catalog, "split", lambda *a: (None, None))
    monkeypatch.setattr(models_catalog, "model_frame", lambda *a: None)
    monkeypatch.setattr(models_catalog, "_grid_columns", lambda *a: None)
    monkeypatch.setattr(analytics_catalog.explain, "contributions", lambda *a: None)
    for name in ("run_algorithm_grid", "grid_search", "random_search"):
        note(search, name)
    note(models, "train")
    for query in (models_catalog.algorithm_grid, models_catalog.grid_search, models_catalog.random_search, analytics_catalog.shap_values):
        query(None, None)
    for name, given in seen.items():
        data = {"df", "train_df", "test_df", "key", "target", "features"} | ({"algorithm"} if name == "train" else set())
        assert set(given) <= data, name
    assert len(seen) == 4 and seen["train"]["algorithm"] == "random_forest"
