import math
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import forest, hamming


def clustered(rng, n, dims=16):
    centres = rng.normal(size=(n // 6, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.25, 3.0], (n, 1))
    return x


def brute_links(ids, x, cosine=0.9):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    hit = y @ y.T >= cosine
    np.fill_diagonal(hit, False)
    comps = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit))])
    return {i: (int(hit[k].sum()), comps[i]) for k, i in enumerate(ids)}


def test_forest_recall_and_no_false_links(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 3000)
    ids = list(range(10, 3010))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_vectors(df, leaf=64).collect()}
    want = brute_links(ids, x)
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.97 * sum(n for n, _ in want.values())
    same = sum(got[i].component_id == want[i][1] for i in ids)
    assert same >= 0.95 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_one_leaf_is_exact_and_large_leaves_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 50)
    rng = np.random.default_rng(6)
    x = np.concatenate([clustered(rng, 300), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(230, 16))])
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = brute_links(ids, x)
    for leaf in (10_000, 32):
        got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df, leaf=leaf, trees=12).collect()}
        assert leaf < 10_000 or got == want
        hot = [i for i in ids if i >= 300]
        assert all(got[i] == want[i] for i in hot)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.1]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (11, []), (None, [1.0, 0.0]), (1, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("rep", "copies", "usable")})
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in forest.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in range(4, 12)]
    assert got == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), *alone]
    assert forest.near_vectors(df.limit(0)).count() == 0
    assert forest.near_vectors(df.where("vec_id = 5")).collect()[0].n_links == 0


def plain_topk(codes, queries, k):
    out = set()
    for q, c in set(queries):
        near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in set(codes))[:k]
        out |= {(q, c, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


def test_nearest_codes_against_all(spark):
    rng = random.Random(8)
    words = [rng.getrandbits(64) - 2**63 for _ in range(250)]
    near = [w ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for w in words[:40]]
    codes = list(enumerate(words + near + [words[0]] * 60))
    codes.append(codes[3])
    df = spark.createDataFrame(codes, "id long, code long")
    queries = df.where("id % 20 = 0")
    want = plain_topk(codes, [c for c in codes if c[0] % 20 == 0], 5)
    got = hamming.nearest_codes(df, queries, 5).join(queries.distinct().select(F.col("id").alias("query_id"), "code"), "query_id")
    assert {(r.query_id, r.code, r.rank, r.id, r.distance) for r in got.collect()} == want
    few = df.where("id < 3")
    assert {(r.query_id, r.id) for r in hamming.nearest_codes(few, few, 5).collect()} == {(a, b) for a in range(3) for b in range(3)}
    assert hamming.nearest_codes(df.limit(0), queries, 5).count() == 0
    assert hamming.nearest_codes(df, queries.limit(0), 5).count() == 0


def test_sign_codes(spark):
    rows = [(1, [1.0, -1.0, 2.0]), (2, None), (3, []), (4, [None, math.nan, math.inf]), (5, [1.0] * 64), (6, [1.0] * 65), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.id: r.code for r in hamming.sign_codes(df).collect()} == {1: 5, 4: 0, 5: -1}


def test_every_length_has_its_own_forest(spark):
    rng = np.random.default_rng(9)
    parts = {8: clustered(rng, 600, 8), 12: clustered(rng, 900, 12), 3: clustered(rng, 6, 3)}
    ids, rows, want = 0, [], {}
    for x in parts.values():
        own = list(range(ids, ids + len(x)))
        ids += len(x)
        rows += [(i, v.tolist()) for i, v in zip(own, x)]
        want |= brute_links(own, x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df, leaf=10_000).collect()}
    assert got == want
    found = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=64).collect()}
    assert all(found[i] <= n for i, (n, _) in want.items())
    assert sum(found.values()) >= 0.97 * sum(n for n, _ in want.values())
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0]), (4, [3.0]), (5, [-1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in forest.near_vectors(odd).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_trees_follow_the_depth():
    sample = np.random.default_rng(3).normal(size=(500, 16))
    trees = [len(forest.Forest(sample, n).directions) for n in (500, 200_000, 1_000_000_000)]
    assert trees == [10, 10, 22]
