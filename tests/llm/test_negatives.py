import math
import random

import numpy as np
import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from riskframe.llm import negatives
from riskframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (5, 64, 9), (64, 64, 64), (70, 65, 99), (256, 64, 300), (33, 40, 129), (40, 0, 40)])
def test_strassen_is_exact(m, k, n):
    rng = np.random.default_rng(m * k + n)
    a, b = (rng.integers(-(2**31), 2**31, s) for s in ((m, k), (n, k)))
    assert (negatives.strassen(a, b) == a @ b.T).all()


def test_strassen_wraps_like_a_plain_product():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, (80, 70)), rng.integers(-(2**62), 2**62, (90, 70))
    assert (negatives.strassen(a, b) == a @ b.T).all()


def test_first_of_rows():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 4, (40, 30))
    scores[0, :] = np.iinfo(np.int64).min
    allowed = rng.random((40, 30)) < 0.3
    allowed[1] = False
    rows, columns = negatives._first_of_rows(scores, allowed.copy(), 3)
    got = sorted(zip(rows.tolist(), columns.tolist()))
    want = []
    for r in range(40):
        order = sorted(np.flatnonzero(allowed[r]).tolist(), key=lambda c: (-int(scores[r, c]), c))
        want += [(r, c) for c in order[:3]]
    assert got == sorted(want)


def brute(rows, is_anchor, positives=5, count=3):
    """The contract, pair by pair."""
    one = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, v) in one.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, (_, w) in one.items() if b != a)
        for p, positive in [s for s in scored if one[s[1]][0] == label][:positives]:
            fits = [(s, b) for s, b in scored if one[b][0] != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, positive, k + 1, b, -p, -s) for k, (s, b) in enumerate(fits[:count])]
    return sorted(out)


def test_defined_cases_and_ties(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, -0.25]) for _ in range(rng.choice([3, 6]))], rng.choice([0, 0, 1, 2])) for i in range(400)]
    rows += [
        (None, [1.0], 1), (401, None, 1), (450, [1.0, None], 1), (500, [float("nan")], 0), (550, [float("inf")], 0), (600, [1.0], None),
        (650, [], 1), (651, [], 0), (50, [0.5, 0.5, 0.5], 0), (50, [0.5, 0.5, 0.5], 0), (1000, [3.0e4, -2.0e4], 0), (1001, [3.0e4, 1.0e4], 0),
    ]
    table = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id bigint, embedding array<float>, label int, id string").repartition(5)
    want = brute(rows, lambda i: i % 50 == 0)
    for size in (4096, 37):
        monkeypatch.setattr(negatives, "SLICE", size)
        monkeypatch.setattr(negatives, "PANEL", max(3, size // 8))
        got = negatives.mine_hard_negatives(table, F.col("id") % 50 == 0)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 40
    assert negatives.mine_hard_negatives(table.where("vec_id < 0"), F.col("id") % 50 == 0).collect() == []
    assert negatives.mine_hard_negatives(table.where("vec_id = 3"), F.col("id") % 50 == 0).collect() == []


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), "op12", QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"], sf_dir) is None
