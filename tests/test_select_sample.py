"""Rank correlation, greedy decorrelation, samples, neighbours and SMOTE."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import encode, sample, select
from riskframe.operators.neighbors import nearest_neighbors


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 1500
    a = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "a": a,
            "b": np.round(a + rng.normal(scale=0.5, size=n), 1),
            "c": rng.integers(0, 4, n).astype(float),
            "flat": 2.0,
            "y": (a + rng.normal(size=n) > 1.6).astype(int),
        }
    )
    return spark.createDataFrame(pdf).persist(), pdf


@pytest.mark.parametrize("buckets", [1, 5])
def test_spearman_target(frame, buckets):
    df, pdf = frame
    got = {r["feature"]: r["spearman"] for r in select.spearman_target(df, "y", ["a", "b", "c", "flat"], buckets).collect()}
    for c in "abc":
        assert got[c] == pytest.approx(abs(pdf[c].rank().corr(pdf["y"].rank())), abs=1e-12)
    assert got["flat"] == 0.0


def test_spearman_skips_missing_cells(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, None, 4.0, 3.0], "y": [0, 0, 1, 1, 0]})
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 1), (4.0, 1), (3.0, 0)], "x double, y int")
    ok = pdf.dropna()
    want = ok["x"].rank().corr(ok["y"].rank())
    assert select.spearman_target(df, "y", ["x"]).first()["spearman"] == pytest.approx(want)


def test_spearman_matrix(frame):
    df, pdf = frame
    matrix = select.spearman_matrix(df, "id", ["a", "b", "c"])
    assert matrix[("a", "b")] == pytest.approx(abs(pdf["a"].rank().corr(pdf["b"].rank())), abs=1e-9)


def _pairs(columns, values):
    full = {(a, b): 0.0 for a in columns for b in columns}
    for (a, b), v in values.items():
        full[(a, b)] = full[(b, a)] = v
    return full


def test_correlated_drop_keeps_the_best_of_a_pair():
    corr = _pairs("abc", {("a", "b"): 0.9})
    assert select.correlated_drop(["a", "b", "c"], corr, {"a": 1, "b": 2, "c": 3}, 0.7) == ["a"]
    assert select.correlated_drop(["a", "b", "c"], corr, {"a": 2, "b": 1, "c": 3}, 0.7) == ["b"]
    assert select.correlated_drop(["a", "b", "c"], corr, {"a": 2, "b": 1, "c": 3}, 0.9) == []


def test_correlated_drop_group_may_vanish():
    # a loses against b; c is then compared with the dropped a, which wins and stays dropped.
    corr = _pairs("abc", {("a", "b"): 0.9, ("a", "c"): 0.8})
    assert set(select.correlated_drop(["a", "b", "c"], corr, {"a": 2, "b": 3, "c": 1}, 0.7)) == {"a", "c"}


def test_correlated_drop_ignores_undefined():
    corr = _pairs("ab", {("a", "b"): float("nan")})
    assert select.correlated_drop(["a", "b"], corr, {"a": 1, "b": 2}, 0.7) == []


def test_feature_pipeline(spark, frame, tmp_path):
    df, _ = frame
    fitted = select.FeaturePipeline(keyCol="id", targetCol="y", nSelect=3, corVal=0.7, numTrees=5, maxDepth=4).fit(df)
    out = fitted.transform(df)
    assert out.columns == ["id", *fitted.features, "y"]
    assert any("_" in f for f in fitted.features) or "a" in fitted.features
    fitted.save(str(tmp_path / "m"))
    again = select.FeaturePipelineModel.load(str(tmp_path / "m"))
    assert again.features == fitted.features
    with pytest.raises(ValueError):
        fitted.transform(df.select("id", "y"))


def test_split_and_folds(frame):
    df, pdf = frame
    train, test = sample.stratified_split(df, "id", "y", 0.2)
    tr, te = train.toPandas(), test.toPandas()
    assert set(tr["id"]) | set(te["id"]) == set(pdf["id"]) and not set(tr["id"]) & set(te["id"])
    for c, n in pdf["y"].value_counts().items():
        assert (te["y"] == c).sum() == int(0.2 * n + 0.5)
    folds = sample.stratified_folds(df, "id", "y", 3).toPandas()
    sizes = folds.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_sample_n(frame):
    df, pdf = frame
    assert sample.stratified_sample(df, "id", "y", 100).count() == 100
    assert sample.stratified_sample(df, "id", "y", 10**6).count() == len(pdf)


def test_undersample(frame):
    df, pdf = frame
    got = sample.undersample(df, "id", "y", 0.4).toPandas()
    n = int(pdf["y"].sum())
    assert got["y"].sum() == n and (got["y"] == 0).sum() == int(n / (0.4 / 0.6))
    with pytest.raises(ValueError):
        sample.undersample(df, "id", "y", 0.01)


def brute_force(points, k):
    d2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    out = {}
    for i in range(len(points)):
        order = sorted((d2[i, j], j) for j in range(len(points)) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("block,pivots", [(10_000, 1), (60, 12), (25, 40)])
def test_nearest_neighbours_with_copies(spark, block, pivots):
    """Integer points make exact ties; a third of all rows are copies of one point."""
    rng = np.random.default_rng(11)
    points = rng.integers(0, 25, size=(450, 2)).astype(float)
    points[rng.random(450) < 0.34] = [3.0, 3.0]
    points[440:] += 500.0  # a far cluster
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    got = nearest_neighbors(df, 5, block, pivots).toPandas()
    want = brute_force(points, 5)
    for i, part in got.groupby("id"):
        assert list(part.sort_values("rank")["neighbor"]) == want[i]
    assert got["id"].nunique() == 450


def test_smote_and_hybrid(frame):
    df, pdf = frame
    sizes = pdf["y"].value_counts()
    out = sample.smote(df, "id", "y", ["a", "b"], 0.5).toPandas()
    assert (out["y"] == 1).sum() == int(0.5 * sizes[0])
    made = out[out["id"].isna()]
    real = pdf[pdf["y"] == 1]
    for c in "ab":
        assert made[c].between(real[c].min() - 1e-9, real[c].max() + 1e-9).all()
    mixed = sample.hybrid_balance(df, "id", "y", ["a", "b"], 0.4).toPandas()
    assert (mixed["y"] == 1).mean() == pytest.approx(0.4, abs=0.005)
    assert sample.rebalance(df, "id", "y", ["a"], "oversample", 0.01) is None
    with pytest.raises(ValueError):
        sample.rebalance(df, "id", "y", ["a"], "magic", 0.3)


def test_rows_without_a_label_are_refused(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id long, y int")
    for deal in (
        lambda: sample.stratified_split(df, "id", "y"),
        lambda: sample.stratified_sample(df, "id", "y", 10),
        lambda: sample.stratified_folds(df, "id", "y"),
    ):
        with pytest.raises(ValueError, match="without a value"):
            deal()
    train, test = sample.stratified_split(df.where("y is not null"), "id", "y")
    assert train.count() + test.count() == 30


def test_codes_of_many_categories(spark):
    n = 6_000  # more than one-hot columns allow
    df = spark.range(2 * n).select("id", F.concat(F.lit("c"), (F.col("id") * 7919) % n).alias("v"))
    df = df.withColumn("v", F.when(F.col("id") != 5, F.col("v")))
    seen, want = {}, {}
    for r in df.orderBy("id").collect():
        want[r["id"]] = -1 if r["v"] is None else seen.setdefault(r["v"], len(seen))
    got = {r["id"]: r["v"] for r in encode.factorize(df, ["v"], ["id"]).collect()}
    assert got == want


@pytest.mark.parametrize("n,spread", [(300, 0.0), (1500, 0.0), (6000, 0.0), (3000, 1.0)])
def test_graph_neighbours_with_many_columns(spark, n, spread):
    """40 columns: nearly all true neighbours, without comparing all pairs; also in dense groups."""
    from riskframe.operators import neighbors

    rng = np.random.default_rng(n)
    k = 5
    x = rng.normal(size=(n, 40))
    if spread:
        x = 0.02 * x + rng.normal(size=(3, 40))[rng.choice(3, n, p=[0.8, 0.1, 0.1])]
    x[50] = x[51]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in neighbors.nearest_neighbors(points, k).collect():
        assert abs(((x[r["id"]] - x[r["neighbor"]]) ** 2).sum() - r["distance2"]) < 1e-9
        got.setdefault(r["id"], set()).add(r["neighbor"])
    d2 = ((x**2).sum(1)[:, None] + (x**2).sum(1)[None]) - 2 * x @ x.T
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1)[:, :k]
    assert all(len(v) == k and i not in v for i, v in got.items()) and len(got) == n
    assert 51 in got[50] and 50 in got[51]
    assert np.mean([len(got[i] & set(want[i])) / k for i in range(n)]) >= 0.9


def test_graph_neighbours_of_few_points(spark):
    x = np.random.default_rng(1).normal(size=(4, 12))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = nearest_neighbors(points, 5).toPandas()
    assert got.groupby("id")["neighbor"].apply(set).to_dict() == {i: set(range(4)) - {i} for i in range(4)}
    assert nearest_neighbors(points.where("id = 0"), 5).collect() == []
    assert nearest_neighbors(points.where("id < 0"), 5).collect() == []
