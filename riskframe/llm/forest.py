"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits by random directions, one per level: a node's threshold is a
sparse place near the median of a bounded sample there, and vectors near the
threshold go to both sides (spill). Levels below the sample's reach take the threshold from the
deepest node that the sample still fills, so depth grows with the number of
vectors and leaves keep their size. Vectors that share a leaf are compared by
cosine in double precision. A large leaf is dealt out as pairs of blocks.

Inside a pair of blocks the task counts links per vector and keeps a spanning
forest of them, so neither pairs nor groups are ever emitted. A pair that meets
in several leaves is counted in the first tree it shares only. Equal vectors are
one vertex with a count.

Vectors of different lengths have no cosine: every length has a forest of its own.
Deep forests have more trees, because every level is one more chance to part a pair.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; rows without an id are returned unlinked; rows that
share an id but not a vector are one vertex, whose links are added up; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.llm.components import connected_components
from riskframe.llm.store import keep

COSINE = 0.9
#: Trees up to SHALLOW levels; one more for each further level.
TREES, SHALLOW = 10, 10
LEAF = 256
#: Vectors this close to a threshold go both ways, in units of the usual offset of a pair at the cosine bound.
SPILL = 0.2
#: Vectors that thresholds are fitted on, at most.
SAMPLE = 20_000
#: Sample vectors that a node needs for a threshold of its own.
NODE_SAMPLE = 64
#: Rows of a block of a large leaf.
BLOCK = 512
SEED = 8


class Forest:
    """Directions and thresholds; their size depends on the sample alone."""

    def __init__(
        self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, cosine: float = COSINE
    ):
        rng = np.random.default_rng(SEED)
        self.depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))
        self.fitted = max(0, min(self.depth, int(np.log2(max(len(sample), 1) / NODE_SAMPLE))))
        dims = sample.shape[1]
        trees += max(0, self.depth - SHALLOW)
        self.directions = _unit(rng.normal(size=(trees * self.depth, dims))).reshape(trees, self.depth, dims)
        # How far two vectors at the cosine bound usually lie apart in one direction.
        self.offset = np.sqrt((2 - 2 * cosine) / dims)
        self.spill = spill * self.offset
        # Thresholds by tree, level and node; levels past `fitted` use the node of that level.
        self.thresholds = []
        for t in range(trees):
            projected = sample @ self.directions[t].T
            node = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                cuts = np.array([self._threshold(projected[node == k, level]) for k in range(1 << min(level, self.fitted))])
                self.thresholds.append(cuts)
                if level < self.fitted:
                    node = node * 2 + (projected[:, level] > cuts[node])

    def _threshold(self, x: np.ndarray) -> float:
        """The emptiest place between the third and seventh tenth; none where most vectors lie close to it.

        So a dense group is not cut through. One that fills its node stays
        together, and its leaf is dealt out in blocks.
        """
        if not len(x):
            return 0.0
        x = np.sort(x)
        places = np.quantile(x, np.linspace(0.3, 0.7, 17))
        near = np.searchsorted(x, places + self.offset) - np.searchsorted(x, places - self.offset)
        best = min(range(17), key=lambda i: (near[i], abs(i - 8)))
        return float(places[best]) if near[best] <= 0.6 * len(x) else np.inf

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) of every place that the vectors go to."""
        out = []
        for t in range(len(self.directions)):
            row, node, top = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            projected = x @ self.directions[t].T
            for level in range(self.depth):
                p, cut = projected[row, level], self.thresholds[t * self.depth + level][top]
                left, right = p <= cut + self.spill, p > cut - self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([node[left] * 2, node[right] * 2 + 1])
                top = node if level < self.fitted else np.concatenate([top[left], top[right]])
            out.append((row, np.full(len(row), t), node))
        return tuple(np.concatenate(c) for c in zip(*out))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _places(shared):
    """Rows (width, place, rep, copies, embedding, own places) for every leaf of every vector; ``width`` is its length."""

    def run(batches):
        forests = shared.value
        for batch in batches:
            values = batch.column(2)
            starts, sizes = values.offsets.to_numpy()[:-1] - values.offsets[0].as_py(), np.diff(values.offsets.to_numpy())
            flat = np.asarray(values.flatten())
            for width in np.unique(sizes):
                some = np.flatnonzero(sizes == width)
                x = flat[starts[some][:, None] + np.arange(width)].astype(np.float64)
                row, tree, leaf = forests[int(width)].leaves(_unit(x))
                # A vector's places, sorted: tree and leaf in one number.
                code = tree.astype(np.int64) << 48 | leaf
                order = np.lexsort((code, row))
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(some)))].astype(np.int32)
                own = pa.ListArray.from_arrays(ends, pa.array(code[order]))
                take = pa.array(some[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), width, np.int32)), pa.array(code), batch.column(0).take(take),
                        batch.column(1).take(take), values.take(take), own.take(pa.array(row)),
                    ],
                    ["width", "place", "rep", "copies", "embedding", "places"],
                )

    return run


def _forests(classes: DataFrame, trees: int, leaf: int, spill: float, cosine: float) -> dict[int, Forest]:
    """A forest for each length, fitted on at most SAMPLE of its vectors, chosen by hash."""
    # One row per length that occurs.
    totals = {r["width"]: r["c"] for r in classes.groupBy("width").agg(F.count("*").alias("c")).collect()}
    samples = {w: np.zeros((0, w)) for w in totals}
    deep = {w: min(1.0, SAMPLE / n) for w, n in totals.items() if n > leaf}
    if deep:
        share = F.create_map(*[F.lit(v) for w, part in deep.items() for v in (w, int(part * (1 << 30)))])
        lucky = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < share[F.col("width")]
        by_id = Window.partitionBy("width").orderBy("rep")
        drawn = classes.where(F.col("width").isin(list(deep)) & lucky).withColumn("r", F.row_number().over(by_id))
        rows = drawn.where(F.col("r") <= SAMPLE).orderBy("width", "rep").select("width", "embedding").toArrow()
        widths = rows.column("width").to_numpy()
        vectors = rows.column("embedding").combine_chunks()
        for w in set(widths.tolist()):
            part = vectors.take(pa.array(np.flatnonzero(widths == w)))
            samples[w] = np.asarray(part.flatten(), np.float64).reshape(-1, w)
    return {w: Forest(_unit(samples[w]), n, trees, leaf, spill, cosine) for w, n in totals.items()}


def _compare(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        place = group["place"].iloc[0]
        same = group["left"].iloc[0] == group["right"].iloc[0]
        sides = group["side"].to_numpy()
        x = _unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        places = [np.asarray(p) for p in group["places"]]
        one = np.arange(len(group)) if same else np.flatnonzero(sides == 0)
        two = one if same else np.flatnonzero(sides == 1)
        hit = x[one] @ x[two].T >= cosine
        if same:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        i, j = one[i], two[j]
        # A pair counts here unless an earlier place is common to both. Near
        # copies have few different lists of earlier places, so these are compared once.
        keys, kind = np.unique([p[: np.searchsorted(p, place)].tobytes().hex() for p in places], return_inverse=True)
        lists = [np.frombuffer(bytes.fromhex(k), np.int64) for k in keys]
        pairs, back = np.unique(kind[i] * len(keys) + kind[j], return_inverse=True)
        fresh = [not np.intersect1d(lists[p // len(keys)], lists[p % len(keys)], assume_unique=True).size for p in pairs]
        first = np.array(fresh, bool)[back]
        i, j = i[first], j[first]
        links = np.zeros(len(group), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        # Smallest neighbour by label propagation: a spanning set of links, one per vector at most.
        label = rep.copy()
        while len(i):
            before = label.copy()
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            if (label == before).all():
                break
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "root": label[some], "links": links[some]})

    return run


def _key():
    """The vector with 0.0 for -0.0, which are equal."""
    return F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    # Single-precision vectors travel as such; cosines are computed in double precision.
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = (
        F.forall("embedding", finite)
        & F.exists("embedding", lambda v: v != 0)
        & F.col("vec_id").isNotNull()
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = keep(
        rows.where("usable").groupBy(_key().alias("embedding"))
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("width", F.size("embedding")),
        "vectors",
    )
    forests = _forests(classes, trees, leaf, spill, cosine)
    if forests:
        shared = spark.sparkContext.broadcast(forests)
        schema = f"width int, place bigint, rep bigint, copies bigint, embedding {kind}, places array<bigint>"
        spread = classes.select("rep", "copies", "embedding").mapInArrow(_places(shared), schema)
        sizes = spread.groupBy("width", "place").agg(F.count("*").alias("c")).where("c > 1")
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        dealt = (
            spread.join(sizes, ["width", "place"])
            .withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "width", "place", "rep", "copies", "embedding", "places",
                F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
            )
        )
        # Else the join's partitioning by place would hold all blocks of a large leaf together.
        dealt = dealt.repartition("width", "place", "left", "right")
        compared = dealt.groupBy("width", "place", "left", "right").applyInPandas(_compare(cosine), "rep bigint, root bigint, links bigint")
        compared = keep(compared, "compared")
        counts = compared.groupBy("rep").agg(F.sum("links").alias("others"))
        labels = connected_components(compared.where("rep <> root").select("rep", "root"))
    else:
        counts = spark.createDataFrame([], "rep bigint, others bigint")
        labels = spark.createDataFrame([], "node bigint, component bigint")
    named = (
        classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", F.col("copies"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.select("vec_id", F.when(F.col("usable"), _key()).alias("embedding")).join(named, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
