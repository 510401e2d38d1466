import random

import brute
from pyspark.sql import functions as F

from riskframe.llm.components import connected_components
from riskframe.llm.minhash import near_duplicates


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = near_duplicates(docs)
    want = brute.near_duplicates([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = got.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_of_near_copies(spark):
    """A bucket larger than the first rounds' probes; links only over intermediate texts count too."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in range(i // 15):
            words[k * 3 % 60] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    got = found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_duplicates(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two"), (None, "one two"),
        (7, "a b c d e f"), (7, "a b c d e f"), (8, "A B C D E F"), (9, "ÄA B C D E F"), (10, "long " * 20_000), (11, "\x00"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rep", "n", "key", "component")})
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [
        ((False, 1), 0, 1, True), ((False, 2), 0, 2, True), ((False, 3), 0, 3, True),
        ((False, 4), 1, 4, True), ((False, 5), 1, 4, False), ((False, 6), 1, 4, False),
        ((False, 7), 2, 7, True), ((False, 7), 2, 7, True), ((False, 8), 2, 7, False), ((False, 9), 2, 9, True),
        ((False, 10), 1, 10, True), ((False, 11), 1, 11, True), ((True, 0), 1, None, True),
    ]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5 + k) for k in range(1, 40)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(170)] + [(7000, 7000), (None, 3)]
    df = connected_components(spark.createDataFrame(edges, "u long, v long"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute.components({n for e in real for n in e}, real)
    assert {r.node: r.component for r in df.collect()} == want
