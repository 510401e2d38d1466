import numpy as np
import pytest

from riskframe.operators import drift, state

COLUMNS = ["a", "b", "few", "none"]


def frame(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(shift, 2, n), rng.exponential(size=n) * 1e6 + 1e9
    rows = [(float(x), float(y) if i % 5 else None, int(i % 7), None) for i, (x, y) in enumerate(zip(a, b))]
    rows[0] = (float("nan"), *rows[0][1:])
    return spark.createDataFrame(rows, "a double, b double, few int, none double").repartition(3)


@pytest.fixture(scope="module")
def batches(spark):
    return [frame(spark, n, i).persist() for i, n in enumerate((3000, 500, 8000))]


def test_merged_state_equals_one_pass(spark, batches):
    whole = batches[0].union(batches[1]).union(batches[2])
    merged = state.merge_states(state.merge_states(*[state.profile_state(b, COLUMNS) for b in batches[:2]]), state.profile_state(batches[2], COLUMNS))
    got = {r.feature: r for r in state.describe_state(merged).collect()}
    one = {r.feature: r for r in state.describe_state(state.profile_state(whole, COLUMNS)).collect()}
    for c in COLUMNS:
        for name in ("rows", "known", "minimum", "maximum", "n_distinct"):
            assert got[c][name] == one[c][name]
        for name in ("mean", "deviation"):
            assert got[c][name] == (None if c == "none" else pytest.approx(one[c][name], rel=1e-12))
    assert got["none"].known == 0 and got["none"]["q_0.5"] is None and got["few"].n_distinct == 7

    rows = whole.toPandas()
    for c in ("a", "b"):
        v = np.sort(rows[c].dropna().to_numpy())
        assert got[c].known == len(v)
        assert got[c].deviation == pytest.approx(v.std(), rel=1e-9)
        for q in state.QUANTILES:
            place = got[c][f"q_{q}"]
            low, high = np.searchsorted(v, place) / len(v), np.searchsorted(v, place, side="right") / len(v)
            assert low - state.rank_error() <= q <= high + state.rank_error()
        assert abs(got[c].n_distinct / len(set(v)) - 1) < 0.06


def test_many_small_batches_keep_the_bound(spark):
    df = frame(spark, 6000, 9).persist()
    states = [state.profile_state(df.where(f"abs(hash(a, b)) % 12 = {i}"), ["a"]) for i in range(12)]
    row = state.describe_state(state.merge_states(*states)).first()
    v = np.sort(df.toPandas()["a"].dropna().to_numpy())
    for q in state.QUANTILES:
        assert abs(np.searchsorted(v, row[f"q_{q}"]) / len(v) - q) <= state.rank_error() + 1 / len(v)


def test_drift_from_states(spark, batches):
    other = frame(spark, 6000, 11, shift=0.7)
    got = {r.feature: r for r in state.state_drift(state.profile_state(batches[2], COLUMNS), state.profile_state(other, COLUMNS)).collect()}
    exact = {r.feature: r for r in drift.drift_numeric(drift.drift_inputs(batches[2], other), ["a", "b", "few"]).collect()}
    for c in ("a", "b", "few"):
        assert abs(got[c].ks - exact[c].ks) <= got[c].ks_error
    assert got["a"].wasserstein_normed == pytest.approx(exact["a"].wasserstein_normed, rel=0.05)
    assert got["none"].ks is None


def test_empty_table(spark, batches):
    empty = state.profile_state(batches[0].limit(0), COLUMNS)
    merged = state.describe_state(state.merge_states(empty, state.profile_state(batches[1], COLUMNS)))
    assert {r.feature: r.rows for r in merged.collect()} == dict.fromkeys(COLUMNS, 500)
    assert {r.feature: (r.rows, r.mean) for r in state.describe_state(empty).collect()} == dict.fromkeys(COLUMNS, (0, None))
