"""Near-duplicate documents by circulant MinHash.

One permutation spreads a document's shingles over a universe of 2^20 places, a
second one ranks the places; coordinate k of the signature is the smallest rank
after a circular shift by k. As a shift only moves the start, all coordinates of
a shingle are one slice of the rank table. Bands of four coordinates give
buckets; pairs from buckets are confirmed on the full shingle sets.

No bucket is ever expanded into all its pairs. Equal sets are one vertex. Each
bucket's members are compared with its smallest one first; after that only
documents outside a bucket's largest component meet the bucket, so every pair
that shares a bucket is either compared or already linked over others.

Defined cases: null, empty or blank texts have no shingles and link with
nothing; fewer words than a shingle give one shingle of all words; rows without
an id are returned unlinked; rows that share an id count as one document where
links are followed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.components import connected_components
from riskframe.llm.store import keep, released, sized, small_batches

WORDS = 5
SIMILARITY = 75  # percent
ROWS, BANDS = 4, 32
UNIVERSE_BITS = 20
SEED = 20

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers whose output bits depend on all input bits."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words seen by this worker; emptied at LIMIT entries."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    total = h[:n] * _FACTORS[0]
    for k in range(1, words):
        total += h[k : k + n] * _FACTORS[k]
    return np.unique(mix(total))


@functools.cache
def _slices(coordinates: int) -> np.ndarray:
    """Row i: the ranks of place i under every shift, as views into one table."""
    size = 1 << UNIVERSE_BITS
    ranks = np.random.default_rng(SEED).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash signature of a non-empty shingle set."""
    places = (mix(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    table = _slices(coordinates)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, table[places[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key per band."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=np.uint64)), parts.shape[:2])
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r])
    return keys.view(np.int64)


def _profiles(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.int64)
            if full:
                keys[full] = band_keys(np.stack([signature(sets[i], bands * rows) for i in full]), rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32), pa.array(keys.ravel())
                    ),
                ],
                ["doc_id", "n", "set_key", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], ["rep", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return joined.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _links_between_components(
    members: DataFrame, labels: DataFrame, sets: DataFrame, classes: DataFrame, percent: int
) -> DataFrame:
    """All links of documents that share a bucket and are not yet connected.

    Of two such documents one at least is no member of the bucket's largest
    component, so only those meet the whole bucket. A document whose shingles
    are too often found in no other open document cannot have a partner and is
    left out first. A pair is compared in the first bucket that it shares, on
    the full sets, inside the join, so that only links become rows.
    """
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = keep(several.where("low <> high").select("key"), "several")
    named = keep(named.join(several, "key"), "open")

    inside = sets.join(named.select("rep").distinct(), "rep", "left_semi")
    alone = (
        inside.select("rep", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1")
        .groupBy("rep").agg(F.count("*").alias("alone"))
    )
    alive = named.join(alone, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    alive = keep(alive.where(100 * F.col("shared") >= percent * F.col("n")).drop("alone"), "alive")
    sizes = alive.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = (
        sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("largest"))
        .where("parts > 1").select("key", "largest")
    )
    largest = keep(largest, "largest")
    full = (
        alive.join(largest, "key")
        .join(sets, "rep")
        .join(classes.select("rep", "bands"), "rep")
        .withColumn("outside", F.col("component") != F.col("largest"))
        .drop("largest")
    )
    left = full.where("outside").select("key", *[F.col(c).alias(f"a_{c}") for c in ("rep", "n", "shared", "component", "shingles", "bands")])
    right = full.select("key", *[F.col(c).alias(f"b_{c}") for c in ("rep", "n", "shared", "component", "shingles", "bands", "outside")])
    both, total = F.size(F.array_intersect("a_shingles", "b_shingles")), F.col("a_n") + F.col("b_n")
    linked = (
        (left["key"] == right["key"])
        & (F.col("a_component") != F.col("b_component"))
        & (~F.col("b_outside") | (F.col("a_rep") < F.col("b_rep")))
        & _near_in_size(F.col("a_n"), F.col("b_n"), percent)
        & ((100 + percent) * F.least("a_shared", "b_shared") >= percent * total)
        & (F.array_min(F.array_intersect("a_bands", "b_bands")) == left["key"])
        & ((100 + percent) * both >= percent * total)
    )
    return keep(left.join(right, linked).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")), "links")


def _near_in_size(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept.

    With 32 bands of 4, two sets of similarity 0.75 miss each other with
    probability 5e-6, and every pair that is found is confirmed exactly.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profiles = keep(
        source.mapInArrow(released(_profiles(words, bands, rows), _hashes), "doc_id bigint, n bigint, set_key binary, bands array<bigint>"),
        "profiles",
    )
    known = profiles.where("doc_id is not null and n > 0")
    classes = keep(
        known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "bands")).alias("m"))
        .select("set_key", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands")),
        "classes",
    )
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    # Stored, as are the other tables below that are joined back to the rows they sum
    # up: a join over two plain shuffles can split a hot bucket.
    heads = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("head"))
    crowded = keep(heads.where("c > 1").select("key", "head"), "crowded")
    members = keep(keys.join(crowded, "key"), "members")

    wanted = sized(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = keep(source.join(wanted, "doc_id", "left_semi").mapInArrow(released(_sets(words), _hashes), "rep bigint, shingles array<bigint>"), "sets")

    pairs = members.where((F.col("rep") != F.col("head.rep")) & _near_in_size(F.col("n"), F.col("head.n"), percent))
    pairs = pairs.select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = keep(_confirmed(pairs, sets, percent), "links")
    labels = connected_components(links)

    more = _links_between_components(members, labels, sets, classes, percent)
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("component"))
    key = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    out = profiles.select("doc_id", "n", key.alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
