"""Quality scores from random-indexing word vectors and a small network.

Words are hashed to a fixed number of slots. Every slot has a random sparse
index vector; the vector of a word is the sum of the index vectors of its
neighbours over the whole corpus. A document is described by its pooled vectors
(over all words, over distinct words, and the pooled index vectors). A network
with one hidden layer, trained with numpy on a bounded sample of labelled rows,
gives a logit; a temperature fitted on a part kept from training turns it into
a probability.

Defined cases: null, empty and blank texts have zero vectors and get the score
of those; without labels of both kinds the score is the share of good labels
(0.5 without any); rows without an id are scored but never used as labelled;
repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import released, small_batches

#: Hash slots of words, and dimensions: the word vectors take 4 MB whatever the corpus.
SLOTS, DIMENSIONS, NONZERO = 1 << 15, 32, 4
FEATURES = 3 * DIMENSIONS + 6
#: Labelled rows used for fitting, at most.
TRAIN_ROWS = 20_000
#: Documents below this score are rejected.
THRESHOLD = 0.3
HIDDEN, EPOCHS, SEED = 32, 60, 10

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Slots(dict):
    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        slot = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % SLOTS
        return slot


_slots = _Slots()


def slots_of(text: str | None) -> np.ndarray:
    found = _TOKEN.findall(text or "")
    return np.fromiter(map(_slots.__getitem__, found), np.uint16, len(found))


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 per slot."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIMENSIONS), np.int8)
    places = np.argsort(rng.random((SLOTS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), (SLOTS, NONZERO)), axis=1)
    return out


def _neighbour_sums(batches):
    """Per task: for each slot the sum of its neighbours' index vectors."""
    index = index_vectors()
    total = np.zeros((SLOTS, DIMENSIONS), np.int64)
    for batch in batches:
        docs = [slots_of(t.as_py()) for t in batch.column(0)]
        docs = [d for d in docs if len(d) > 1]
        if not docs:
            continue
        flat = np.concatenate(docs)
        vectors = index[flat].astype(np.int16)
        around = np.zeros_like(vectors)
        around[1:] += vectors[:-1]
        around[:-1] += vectors[1:]
        ends = np.cumsum([len(d) for d in docs])[:-1]
        around[ends] -= vectors[ends - 1]  # no neighbours across documents
        around[ends - 1] -= vectors[ends]
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total[ordered[starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)
    used = np.flatnonzero(total.any(axis=1))
    columns = [pa.array(used.astype(np.int32)), *[pa.array(total[used, d]) for d in range(DIMENSIONS)]]
    yield pa.RecordBatch.from_arrays(columns, ["slot", *[f"v{d}" for d in range(DIMENSIONS)]])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors per slot from all documents; the result has a fixed size."""
    small_batches(docs.sparkSession)
    schema = "slot int, " + ", ".join(f"v{d} bigint" for d in range(DIMENSIONS))
    sums = (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(released(_neighbour_sums, _slots), schema)
        .groupBy("slot")
        .agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMENSIONS)])
        .toArrow()
    )
    out = np.zeros((SLOTS, DIMENSIONS), np.float32)
    slot = sums.column("slot").to_numpy()
    for d in range(DIMENSIONS):
        out[slot, d] = sums.column(f"v{d}").to_numpy()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        slots = slots_of(text)
        if not len(slots):
            continue
        distinct, counts = np.unique(slots, return_counts=True)
        share = (counts / len(slots)).astype(np.float32)
        found = vectors[distinct]
        means = [share @ found, found.mean(axis=0), share @ index[distinct]]
        row[: 3 * DIMENSIONS] = np.concatenate(means)
        # How long the pooled vectors are, how often index vectors one and two
        # places apart agree, and how many words there are.
        sizes = [np.log(1e-4 + m @ m) for m in means]
        agree = [(slots[k:] == slots[:-k]).mean() if len(slots) > k else 0.0 for k in (1, 2)]
        row[3 * DIMENSIONS :] = [*sizes, *np.sqrt(agree), np.log1p(len(slots))]
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: tuple | None
    prior: float

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        mean, scale, w1, b1, w2, b2, temperature = self.weights
        x = np.clip((features - mean) / scale, -6, 6)
        logit = np.tanh(x @ w1 + b1) @ w2 + b2
        return 1.0 / (1.0 + np.exp(-logit / temperature))

    def scorer(self, spark):
        """A column function: text -> probability of good quality."""
        shared = spark.sparkContext.broadcast(self)

        def scores(batches):
            model = shared.value
            for texts in batches:
                yield pa.array(model.probabilities(pooled(texts.to_pylist(), model.vectors, index_vectors_cached())), pa.float64())

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from released(scores, _slots)(batches)

        return score


_index: list[np.ndarray] = []


def index_vectors_cached() -> np.ndarray:
    if not _index:
        _index.append(index_vectors().astype(np.float32))
    return _index[0]


def train_network(x: np.ndarray, y: np.ndarray) -> tuple:
    """Adam on the log loss; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(SEED)
    kept = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[~kept])) < 2 or len(np.unique(y[kept])) < 2:
        kept = np.zeros(len(y), bool)
    fit_x, fit_y = x[~kept], y[~kept].astype(np.float64)
    mean, scale = fit_x.mean(axis=0), np.maximum(fit_x.std(axis=0), 1e-4)
    fit_x = np.clip((fit_x - mean) / scale, -6, 6).astype(np.float64)
    params = [
        rng.normal(0, fit_x.shape[1] ** -0.5, (fit_x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for rows in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 128)):
            w1, b1, w2, b2 = params
            hidden = np.tanh(fit_x[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - fit_y[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - hidden**2)
            grads = [fit_x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = params
    temperature = 1.0
    if kept.any():
        logit = np.tanh(np.clip((x[kept] - mean) / scale, -6, 6) @ w1 + b1) @ w2 + b2
        sign = np.where(y[kept] == 1, 1.0, -1.0)
        grid = np.geomspace(0.5, 10, 60)
        temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid])])
    return mean, scale, w1, b1, w2, float(b2[0]), temperature


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> QualityModel:
    """Word vectors from all documents; the network from at most ``train_rows`` labelled ones.

    The labelled rows are those with the smallest hashes of their id, without the held-out ones.
    """
    vectors = word_vectors(docs, text)
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    # At most train_rows rows of 12 bytes.
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), shared.value, index_vectors_cached())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["id", "y", "x"])

    got = rows.select("id", "y", "text").mapInArrow(released(features, _slots), "id bigint, y int, x array<float>").toArrow()
    ids, y = got.column("id").to_numpy(), got.column("y").to_numpy()
    if not len(y):
        return QualityModel(vectors, None, 0.5)
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(len(y), FEATURES)
    order = np.lexsort((*x.T[::-1], y, ids))  # the order of rows must not depend on the run
    order = order[np.argsort((ids[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")]
    x, y = x[order], y[order]
    if len(np.unique(y)) < 2:
        return QualityModel(vectors, None, float(y.mean()))
    return QualityModel(vectors, train_network(x, y), float(y.mean()))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    small_batches(docs.sparkSession)
    score = model.scorer(docs.sparkSession)
    return docs.withColumn(column, score(F.col(text).cast("string")))
