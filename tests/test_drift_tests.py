import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.tails import chi_square_tail, kolmogorov_tail, normal_tails
from riskframe.operators import drift

# Upper points of published tables: (degrees of freedom, value, probability).
CHI_SQUARE = [(1, 3.841459, 0.05), (1, 6.634897, 0.01), (2, 5.991465, 0.05), (5, 11.070498, 0.05), (10, 23.209251, 0.01),
              (10, 3.940299, 0.95), (30, 43.772972, 0.05), (100, 124.342113, 0.05), (100, 77.929465, 0.95)]


def test_chi_square_tail_equals_tables(spark):
    df = spark.createDataFrame([(d, x, p) for d, x, p in CHI_SQUARE], "d int, x double, p double")
    for r in df.select("p", chi_square_tail(F.col("x"), F.col("d")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-7)
    # Even degrees of freedom have a closed form, also far out and for many of them.
    rows = [(d, float(x)) for d in (2, 4, 40, 2000) for x in (0.5, d, 1.3 * d + 5, 60.0)]
    got = spark.createDataFrame(rows, "d int, x double").select("d", "x", chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        terms = [math.exp(i * math.log(r.x / 2) - math.lgamma(i + 1) - r.x / 2) for i in range(r.d // 2)]
        assert r.p == pytest.approx(sum(terms), rel=1e-9, abs=1e-14)
    edge = spark.createDataFrame([(3, 0.0), (0, 1.0), (1, 2000.0)], "d int, x double").select(chi_square_tail(F.col("x"), F.col("d")).alias("p"))
    assert [r.p for r in edge.collect()] == [1.0, None, 0.0]


def test_normal_and_kolmogorov_tails(spark):
    one = spark.range(1)
    for z in (0.1, 1.0, 1.959964, 5.0):
        assert one.select(normal_tails(F.lit(z)).alias("p")).first().p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    # Critical values of the limiting distribution; both series at the place where they meet.
    for x, p in ((1.3581015, 0.05), (1.6276236, 0.01), (0.8275736, 0.5), (0.5, 0.9639452), (0.05, 1.0)):
        got = one.select(kolmogorov_tail(F.lit(x / math.sqrt(50)), F.lit(100), F.lit(100)).alias("p")).first().p
        assert got == pytest.approx(p, abs=1e-6)
    left, right = (one.select(kolmogorov_tail(F.lit(x), F.lit(2), F.lit(2)).alias("p")).first().p for x in (1 - 1e-12, 1 + 1e-12))
    assert left == pytest.approx(right, abs=1e-10)


def sides(spark, n, shift, seed=1):
    rng = np.random.default_rng(seed)

    def rows(move):
        return [
            (float(rng.normal() + move), float(rng.integers(0, 3)), float(rng.random() < 0.5 + move / 4),
             "ab"[int(rng.random() < 0.5 + move / 4)], "abcdefgh"[int(rng.integers(0, 8 if not move else 4))], 1.0)
            for _ in range(n)
        ]

    schema = "x double, few double, flag double, two string, many string, flat double"
    return drift.drift_inputs(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(shift), schema))


NUMERIC, CATEGORICAL = ["x", "few", "flag", "flat"], ["two", "many"]


@pytest.mark.parametrize("n,shift", [(400, 0.0), (400, 0.8), (1500, 0.8)])
def test_chosen_by_kind_cardinality_and_size(spark, n, shift):
    got = {r.feature: r for r in drift.drift_tests(sides(spark, n, shift), NUMERIC, CATEGORICAL).collect()}
    small = {"x": "kolmogorov_smirnov", "few": "chi_square", "flag": "share_difference", "two": "share_difference", "many": "chi_square", "flat": "share_difference"}
    large = {"x": "wasserstein_normed"}
    assert {f: r.test for f, r in got.items()} == (small if n <= 1000 else {f: large.get(f, "js_distance") for f in small})
    assert {f for f, r in got.items() if r.drifted} == ({"x", "flag", "two", "many"} if shift else set())
    assert got["flat"].p_value == 1.0 and got["x"].kind == "numeric" and got["few"].kind == "categorical"


def test_shares_of_two_categories(spark):
    """The z of the pooled two-share test."""
    a, b = [("a",)] * 30 + [("b",)] * 70, [("a",)] * 50 + [("b",)] * 30
    both = drift.drift_inputs(spark.createDataFrame(a, "c string"), spark.createDataFrame(b, "c string"))
    row = drift.drift_tests(both, [], ["c"]).first()
    p1, p2, pooled = 0.3, 0.625, 80 / 180
    z = abs(p1 - p2) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 80))
    assert row.statistic == pytest.approx(z) and row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_one_side_without_rows(spark):
    df = sides(spark, 50, 0.0)
    for r in drift.drift_tests(df.where("side = 'reference'"), NUMERIC, CATEGORICAL).collect():
        assert r.p_value is None and r.drifted == 0
