import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from riskframe.llm import periods
from riskframe.llm.queries import QUERIES


def plain_runs(words, exponent=4, min_length=6):
    """{(start, length): smallest period}, by walking along every period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    size, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 5])
    words = [b"%d" % rng.randrange(kinds) for _ in range(size)]
    if words and rng.random() < 0.6:
        a = rng.randrange(size)
        p = rng.randint(1, max(1, (size - a) // 3))
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        exponent, min_length = rng.choice([2, 3, 4]), rng.choice([2, 6])
        for words, got in zip(docs, periods.runs_of(docs, exponent, min_length)):
            assert [tuple(r) for r in got.tolist()] == plain_runs(words, exponent, min_length)


def test_candidates_in_small_blocks(monkeypatch):
    rng = random.Random(4)
    docs = [random_words(rng) for _ in range(30)]
    whole = periods.runs_of(docs)
    monkeypatch.setattr(periods, "BLOCK_CANDIDATES", 7)
    for a, b in zip(whole, periods.runs_of(docs)):
        assert a.tolist() == b.tolist()


def test_grammar_levels_are_logarithmic_and_extensions_exact():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 3000)
    text[1000:2500] = np.resize(text[1000:1017], 1500)
    text = np.r_[5, text, 6]
    grammar = periods.Grammar(text)
    assert len(grammar.levels) < 60
    x = rng.integers(1, len(text) - 1, 500)
    y = np.where(rng.random(500) < 0.5, x + 17, rng.integers(1, len(text) - 1, 500))
    y = np.minimum(np.where(x == y, x + 1, y), len(text) - 1)
    x, y = x[x != y], y[x != y]
    for a, b, f, g in zip(x, y, grammar.forward(x, y), grammar.backward(x, y)):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        m = 0
        while text[a - 1 - m] == text[b - 1 - m]:
            m += 1
        assert (f, g) == (a + n, a - m)


def test_long_periodic_text():
    assert periods.runs_of([[b"a"] * 100_000])[0].tolist() == [[0, 100_000, 1]]
    words = [b"%d" % (i % 1000) for i in range(50_000)]
    assert periods.runs_of([words])[0].tolist() == [[0, 50_000, 1000]]


def test_defined_cases(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a a a a a", None), (5, "a a a a a a", "y"),
        (5, "a a a a a a", "y"), (None, "b c " * 4, "z"), (6, " x  x\n" * 3, "z"), (7, "long " + "w" * 200_000, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], len(r.collapsed)) for r in periods.find_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, [], 0), (2, 0, [], 0), (3, 0, [], 0), (4, 5, [], 9), (5, 6, [(0, 6, 1)], 1), (5, 6, [(0, 6, 1)], 1),
            (None, 8, [(0, 8, 2)], 3), (6, 6, [(0, 6, 1)], 2), (7, 2, [], 200_005),
        ],
        key=str,
    )
    assert periods.find_runs(docs.where("doc_id > 99")).collect() == []


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha(listed), sha(" ".join(kept)))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
        ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    want = [expected(r.doc_id, r.text) for r in docs if len(r.text or "") < 20_000]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    assert [rows[w[0]] for w in want] == want
    assert sum(w[1] > 0 for w in want) > 5
