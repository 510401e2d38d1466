"""The distributed rank and quantile helpers against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ranks
from riskframe.operators.aggregate import aggregate


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; values with ties, a heavy value and missing ones."""
    rng = np.random.default_rng(5)
    n = 6000
    key = np.where(rng.random(n) < 0.34, 7, rng.integers(0, 60, n))
    value = np.round(rng.normal(50, 20, n), 1)
    value[rng.random(n) < 0.3] = 42.0
    rows = [(int(i), int(k), None if i % 17 == 0 else float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(rows, "id long, k long, v double").repartition(6).persist()


def test_hash_rank_is_a_permutation_per_stratum(skewed):
    ranked = ranks.hash_rank(skewed, ["id"], ["k"], 42)
    pdf = ranked.select("k", "hash_rank").toPandas()
    for _, part in pdf.groupby("k"):
        assert sorted(part["hash_rank"]) == list(range(1, len(part) + 1))


def test_hash_rank_does_not_depend_on_prefix_length_or_partitions(skewed):
    a = {r["id"]: r["hash_rank"] for r in ranks.hash_rank(skewed, ["id"], [], 1, digits=1).collect()}
    b = {r["id"]: r["hash_rank"] for r in ranks.hash_rank(skewed.repartition(3), ["id"], [], 1, digits=4).collect()}
    assert a == b


@pytest.mark.parametrize("buckets", [1, 2, 7, 50])
def test_running_counts_by_ranges(skewed, buckets):
    pdf = skewed.toPandas().dropna()
    counts = skewed.where("v is not null").withColumn("g", F.col("k") % 3).groupBy("g", "v").agg(F.count("*").alias("n"))
    got = ranks.running_counts(counts, ["g"], "v", ["n"], buckets, next_value="nxt").collect()
    for r in got:
        group = pdf[pdf["k"] % 3 == r["g"]]["v"]
        assert r["n_below"] == (group < r["v"]).sum()
        larger = group[group > r["v"]]
        assert r["nxt"] == (larger.min() if len(larger) else None)


@pytest.mark.parametrize("limit", [10, 10**9])
def test_exact_quantiles_both_ways(skewed, limit):
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = ranks.exact_quantiles(skewed, ["v", "id"], probs, cell_limit=limit)
    pdf = skewed.toPandas()
    for c in ("v", "id"):
        assert got[c] == pytest.approx(list(pdf[c].dropna().quantile(probs)), abs=1e-9)


def test_exact_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert ranks.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("buckets", [1, 9])
def test_label_quantiles(skewed, buckets):
    df = skewed.withColumn("g", F.when(F.col("k") == 7, "hot").otherwise("rest"))
    got = {r["g"]: r for r in ranks.label_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], buckets).collect()}
    pdf = df.toPandas().dropna()
    for g, part in pdf.groupby("g"):
        assert got[g]["n"] == len(part)
        assert [got[g][f"q{i}"] for i in range(3)] == pytest.approx(list(part["v"].quantile([0.1, 0.5, 0.9])))


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_aggregate_hot_and_light_groups(skewed, hot_rows):
    spec = {"v": ["min", "max", "mean", "sum", "var", "median", "size", "nunique"]}
    got = aggregate(skewed, "k", spec, "P_", slices={"S_": F.col("id") % 2 == 0}, hot_rows=hot_rows).toPandas().set_index("k")
    pdf = skewed.toPandas()
    for prefix, part in (("P_", pdf), ("S_", pdf[pdf["id"] % 2 == 0])):
        want = part.groupby("k")["v"].agg(["min", "max", "mean", "sum", "var", "median", "size", "nunique"])
        for how in want.columns:
            left = got[f"{prefix}v_{how.upper()}"].astype(float).sort_index()
            right = want[how].astype(float).reindex(left.index)
            assert np.allclose(left, right, equal_nan=True), (prefix, how)


@pytest.mark.parametrize("buckets", [6, 1, None])
def test_ranked_cells_with_frequent_values(skewed, buckets):
    got = ranks.ranked_cells(skewed, "id", ["v"], buckets).toPandas().set_index("id")
    pdf = skewed.toPandas().dropna().set_index("id")
    want = pdf["v"].rank(method="average")
    mine = got["n_below"] + (got["n"] + 1) / 2
    assert len(mine) == len(want)
    assert np.allclose(mine.sort_index().astype(float), want.sort_index())


@pytest.mark.parametrize("hows", [["median"], ["median", "nunique"], ["mean", "median"]])
def test_large_groups_as_small_ones(skewed, hows):
    """Median-only specs and NaN values give the same rows on both ways."""
    df = skewed.withColumn("w", F.when(F.col("k") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    spec = {"v": hows, "w": hows}
    a = aggregate(df, "k", spec, "P_", hot_rows=1).toPandas().set_index("k").sort_index()
    b = aggregate(df, "k", spec, "P_").toPandas().set_index("k").sort_index()
    assert list(a.columns) == list(b.columns)
    assert (a.isna() == b.isna()).all().all()
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)


@pytest.mark.parametrize("limit", [5, 60, 10**9])
def test_values_at_by_narrowing(skewed, limit):
    pdf = skewed.toPandas().dropna()
    counts = skewed.where("v is not null").withColumn("g", F.col("k") % 3).groupBy("g", "v").agg(F.count("*").alias("c"))
    lists = {g: sorted(part["v"]) for g, part in pdf.groupby(pdf["k"] % 3)}
    goals = [(int(g), p) for g, values in lists.items() for p in {0, len(values) // 3, len(values) // 2, len(values) - 1}]
    wanted = skewed.sparkSession.createDataFrame(goals, "g long, pos long")
    got = {(r["g"], r["pos"]): r["v"] for r in ranks.values_at(counts, ["g"], wanted, limit).collect()}
    assert got == {(g, p): lists[g][p] for g, p in goals}
