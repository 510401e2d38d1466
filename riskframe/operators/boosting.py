"""Second-order and ordered boosting of histogram trees for a 0/1 target.

Rows are stored in blocks: a matrix of values, its bins, labels, weights and the
scores so far. One aggregate per tree level serves all open nodes: every task adds
up gradients and hessians by node, feature and bin, the partial histograms meet by
node and feature, and one row per node and feature, its best split, reaches the
driver. Nothing that grows with the rows does.

``second_order``: each node is split where the regularised gain
G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2) is greatest and above
``min_gain``; missing values go to the side that gains more, which the tree learns.

``ordered``: symmetric trees (one split for all nodes of a level), grown in ``ordered.py``. Rows stand in a
random order given by a hash. Prefix models are trained on 1/2, 1/4, ... of the
rows, and the gradient of a row comes from a model whose rows all stand before it,
so no gradient knows its own label. The final leaf values are fitted on all rows.

Cut points come from a mergeable quantile sketch whose weights are the hessians.
Every ``REFRESH`` trees the sketch is made anew from the present hessians and the
blocks are stored with new bins and scores; in between each new tree is added once to
the kept scores, and the levels of the next tree read the gradients made from them. Columns with at most ``bins`` values are cut at each of them,
so the splits are those of an exhaustive search. Ties go to the smaller feature,
then the lower cut, then missing values to the right.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.expr import col, digest
from riskframe.session import discard, materialize, spread

#: Rows of a block; trees between two refreshes of bins and scores.
BLOCK_ROWS, REFRESH = 16_384, 10
#: Entries of a sketch per bin: one pruning moves a rank by at most 1 / (SKETCH * bins) of the weight.
SKETCH = 8
#: Partial sketches that meet in one task.
MERGED = 64
MISSING = 65_535
#: Partial histograms that meet in one group, in bytes.
GROUP_BYTES = 64 << 20
#: Rows of one group and part of the order that one task numbers, about.
PART_ROWS = 200_000


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 in a leaf. ``value`` has one row per model of the ensemble."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    value: np.ndarray | None = None

    def add(self, cover: float = 0.0) -> int:
        for part, start in (
            (self.feature, -1), (self.threshold, 0.0), (self.bin, 0), (self.default_left, False),
            (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.cover, cover),
        ):
            part.append(start)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, threshold: float, default_left: bool, gain: float, covers) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node] = feature, cut, threshold
        self.default_left[node], self.gain[node] = default_left, gain
        self.left[node], self.right[node] = self.add(covers[0]), self.add(covers[1])
        return self.left[node], self.right[node]

    def leaves(self, columns: np.ndarray, binned: bool) -> np.ndarray:
        """The node in which each row ends; ``columns`` are bins or values, one row per feature."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        limit = np.array(self.bin if binned else self.threshold)
        default = np.array(self.default_left)
        n = columns.shape[1]
        node, rows = np.zeros(n, np.int32), np.arange(n)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            x = columns[np.maximum(f, 0), rows]
            lost = x == MISSING if binned else np.isnan(x)
            goes_left = np.where(lost, default[node], x <= limit[node])
            node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


@dataclass
class BoostedModel:
    """A fitted ensemble; its probability is a column, so it scores like the other models."""

    features: tuple[str, ...]
    base: float
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log odds of rows of values, one row per feature; NaN is missing."""
        out = np.full(values.shape[1], self.base)
        for tree in self.trees:
            out += tree.value[-1][tree.leaves(values, False)]
        return out

    def probability(self) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.margins(x.to_numpy(dtype=float, na_value=np.nan).T))))

        return score(F.struct(*[col(f).cast("double").alias(f"c{i}") for i, f in enumerate(self.features)]))

    def importance(self) -> dict[str, float]:
        """Share of the summed gains per feature."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[self.features[f]] += gain
        whole = sum(total.values()) or 1.0
        return {f: g / whole for f, g in total.items()}


# --------------------------------------------------------------------------
# Blocks

_BLOCK = "block long, n int, vals binary, label binary, weight binary, place binary, bins binary, margin binary"


def _blocks(d: int, in_order: bool = False):
    """Rows (label, weight, place, features...) as blocks without bins and scores."""

    def run(batches):
        held: list[np.ndarray] = []
        number = 0

        def block(rows: np.ndarray):
            nonlocal number
            if in_order:
                rows = rows[rows[:, 2].argsort(kind="stable")]
            parts = [np.ascontiguousarray(rows[:, 3:].T).tobytes(), *[np.ascontiguousarray(rows[:, i]).tobytes() for i in range(3)]]
            number += 1
            # The task's blocks are told apart by their contents; equal blocks are interchangeable.
            name = int(pd.util.hash_array(rows[:1, :].ravel()).sum().astype(np.int64)) ^ number
            return [name, len(rows), *parts, b"", b""]

        def out(rows):
            names = [p.split()[0] for p in _BLOCK.split(", ")]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(rows, kinds)], names)

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= BLOCK_ROWS:
                rows = np.concatenate(held)
                whole = len(rows) // BLOCK_ROWS * BLOCK_ROWS
                for at in range(0, whole, BLOCK_ROWS):
                    yield out(block(rows[at : at + BLOCK_ROWS]))
                held = [rows[whole:]]
        rows = np.concatenate(held) if held else np.empty((0, d + 3))
        if len(rows):
            yield out(block(rows))

    return run


def _numbers(data, kind=float) -> np.ndarray:
    return np.frombuffer(data.as_py(), kind)


def _derivatives(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return weight * (p - label), weight * p * (1 - p)


@dataclass
class _Ensemble:
    """What tasks need to know: the order's prefixes, the base score and the trees since the last refresh."""

    d: int
    base: float
    prefixes: tuple[float, ...] = ()
    recent: list[Tree] = field(default_factory=list)

    def models(self) -> int:
        """Rows of scores: all rows' model alone, or the base, one per prefix, and that of all rows."""
        return len(self.prefixes) + 2 if self.prefixes else 1

    def scores(self, batch, i: int, columns: np.ndarray, binned: bool) -> np.ndarray:
        n = columns.shape[1]
        stored = _numbers(batch.column("margin")[i])
        margin = stored.reshape(self.models(), n).copy() if len(stored) else np.full((self.models(), n), self.base)
        for tree in self.recent:
            margin += tree.value[:, tree.leaves(columns, binned)]
        return margin

    def packed(self, margin: np.ndarray) -> bytes:
        return margin.tobytes()

    def row_model(self, place: np.ndarray) -> np.ndarray:
        """The model that gives each row its gradient: the largest prefix that ends before it."""
        return np.searchsorted(np.array(self.prefixes), place, side="right") if self.prefixes else np.zeros(len(place), int)

    def row_derivatives(self, margin: np.ndarray, place: np.ndarray, label: np.ndarray, weight: np.ndarray):
        return _derivatives(margin[self.row_model(place), np.arange(len(place))], label, weight)


# --------------------------------------------------------------------------
# Cut points


def prune(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A weighted sample, sorted, equal values joined, of at most ``size`` entries that stand for what they follow."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, int)
    values = values[first]
    weights = np.add.reduceat(weights, first) if len(first) else weights
    if len(values) <= size:
        return values, weights
    below = np.cumsum(weights)
    last = np.unique(np.searchsorted(below, below[-1] * np.arange(1, size + 1) / size).clip(max=len(values) - 1))
    # The greatest value always stays.
    last = np.unique(np.r_[last, len(values) - 1])
    return values[last], np.diff(np.r_[0.0, below[last]])


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of the bins: every value if there are at most ``bins``, else weighted quantiles."""
    if len(values) <= bins:
        return values
    below = np.cumsum(weights)
    at = np.searchsorted(below, below[-1] * np.arange(1, bins + 1) / bins).clip(max=len(values) - 1)
    return values[np.unique(at)]


_ENTRIES = "feature int, part int, vals binary, weights binary"


def _sketches(ensemble: _Ensemble, size: int):
    def run(batches):
        held = [(np.empty(0), np.empty(0))] * ensemble.d
        name = 0
        for batch in batches:
            for i in range(batch.num_rows):
                name = int(batch.column("block")[i].as_py())
                x = _numbers(batch.column("vals")[i]).reshape(ensemble.d, -1)
                label, weight, place = (_numbers(batch.column(c)[i]) for c in ("label", "weight", "place"))
                _, h = ensemble.row_derivatives(ensemble.scores(batch, i, x, False), place, label, weight)
                for f in range(ensemble.d):
                    known = ~np.isnan(x[f])
                    v, w = held[f]
                    held[f] = prune(np.r_[v, x[f][known]], np.r_[w, h[known]], size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(ensemble.d), pa.int32()), pa.array([name % MERGED] * ensemble.d, pa.int32()),
                pa.array([v.tobytes() for v, _ in held]), pa.array([w.tobytes() for _, w in held]),
            ],
            ["feature", "part", "vals", "weights"],
        )

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        v, w = (np.concatenate([np.frombuffer(b) for b in table.column(c).to_pylist()]) for c in ("vals", "weights"))
        v, w = prune(v, w, size)
        head = table.select(["feature", "part"]).slice(0, 1)
        return head.append_column("vals", pa.array([v.tobytes()])).append_column("weights", pa.array([w.tobytes()]))

    return run


def find_cuts(blocks: DataFrame, ensemble: _Ensemble, bins: int) -> list[np.ndarray]:
    """Cut points per feature from hessian-weighted sketches of all rows, merged in two steps."""
    size = SKETCH * bins
    merge = _merge(size)
    parts = blocks.mapInArrow(_sketches(ensemble, size), _ENTRIES).groupBy("feature", "part").applyInArrow(merge, _ENTRIES)
    rows = parts.groupBy("feature").applyInArrow(merge, _ENTRIES).collect()
    found = {r["feature"]: cut_points(np.frombuffer(r["vals"]), np.frombuffer(r["weights"]), bins) for r in rows}
    return [found.get(f, np.empty(0)) for f in range(ensemble.d)]


def _refreshed(ensemble: _Ensemble, cuts: list[np.ndarray]):
    """Blocks with new bins and with the newest trees in their scores."""

    def run(batches):
        for batch in batches:
            bins, margins = [], []
            for i in range(batch.num_rows):
                x = _numbers(batch.column("vals")[i]).reshape(ensemble.d, -1)
                margins.append(ensemble.packed(ensemble.scores(batch, i, x, False)))
                placed = np.empty(x.shape, np.uint16)
                for f in range(ensemble.d):
                    placed[f] = np.searchsorted(cuts[f], x[f]).clip(max=max(0, len(cuts[f]) - 1))
                    placed[f][np.isnan(x[f])] = MISSING
                bins.append(placed.tobytes())
            columns = [batch.column(c) for c in batch.schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(margins)], batch.schema.names)

    return run


_WORK = ["block", "label", "weight", "place", "bins", "margin"]
_NARROW = "block long, label binary, weight binary, place binary, bins binary, margin binary, g binary, h binary"


def _derived(ensemble: _Ensemble):
    """Blocks with the newest trees in their scores, and the gradient and hessian of each row."""

    def run(batches):
        for batch in batches:
            margins, gradients, hessians = [], [], []
            for i in range(batch.num_rows):
                bins = _numbers(batch.column("bins")[i], np.uint16).reshape(ensemble.d, -1)
                label, weight, place = (_numbers(batch.column(c)[i]) for c in ("label", "weight", "place"))
                margin = ensemble.scores(batch, i, bins, True)
                g, h = ensemble.row_derivatives(margin, place, label, weight)
                margins.append(margin.tobytes())
                gradients.append(g.tobytes())
                hessians.append(h.tobytes())
            columns = [batch.column(c) for c in _WORK[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(margins), pa.array(gradients), pa.array(hessians)], [*_WORK, "g", "h"])

    return run


def _with_trees(blocks: DataFrame, ensemble: _Ensemble) -> DataFrame:
    return blocks.select(*_WORK).mapInArrow(_derived(ensemble), _NARROW).persist()


# --------------------------------------------------------------------------
# Levels


@dataclass(frozen=True)
class Limits:
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0


_SUMMED = ["block", "place", "bins", "g", "h"]
_HISTOGRAM = "bucket int, feature int, node int, part long, g binary, h binary"
_SPLIT = "node int, feature int, gain double, bin int, default_left boolean, gl double, hl double, gr double, hr double"


def _histograms(ensemble: _Ensemble, tree: Tree, nodes: list[int], sizes: list[int], rate: float, seed: int, bucket: int):
    """Per task, node and feature the sums of gradient and hessian by bin, missing values last.

    ``bucket`` pairs of feature and node go to one group.
    """

    def run(batches):
        width = max(sizes) + 1
        place_of = np.full(len(tree.feature), -1)
        place_of[nodes] = np.arange(len(nodes))
        g_sum, h_sum = np.zeros((2, ensemble.d, len(nodes) * width))
        name = None
        for batch in batches:
            for i in range(batch.num_rows):
                name = int(batch.column("block")[i].as_py()) if name is None else name
                bins = _numbers(batch.column("bins")[i], np.uint16).reshape(ensemble.d, -1)
                g, h = (_numbers(batch.column(c)[i]) for c in ("g", "h"))
                at = place_of[tree.leaves(bins, True)]
                use = at >= 0
                if rate < 1:
                    use &= _drawn(_numbers(batch.column("place")[i]), seed) < rate
                at, g, h = at[use] * width, g[use], h[use]
                for f in range(ensemble.d):
                    b = bins[f][use].astype(np.int64)
                    b[b == MISSING] = width - 1
                    g_sum[f] += np.bincount(at + b, g, len(g_sum[f]))
                    h_sum[f] += np.bincount(at + b, h, len(h_sum[f]))
        if name is None:
            return
        count = ensemble.d * len(nodes)
        feature, node = np.divmod(np.arange(count, dtype=np.int32), np.int32(len(nodes)))
        cells = [[row.tobytes() for row in sums.reshape(count, width)] for sums in (g_sum, h_sum)]
        numbers = [np.arange(count, dtype=np.int32) // np.int32(bucket), feature, np.array(nodes, np.int32)[node], np.full(count, name)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in numbers + cells], ["bucket", "feature", "node", "part", "g", "h"])

    return run


def _drawn(place: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 per row that depends on its place in the order and the seed alone."""
    x = place.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _sums(table: pa.Table):
    """(feature, node, gradients, hessians) of each pair, the tasks' histograms added in a fixed order."""
    table = table.sort_by([(c, "ascending") for c in ("feature", "node", "part")])
    feature, node = table.column("feature").to_numpy(), table.column("node").to_numpy()
    starts = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (node[1:] != node[:-1])])
    g, h = (np.stack([np.frombuffer(b) for b in table.column(c).to_pylist()]) for c in ("g", "h"))
    return zip(feature[starts].tolist(), node[starts].tolist(), np.add.reduceat(g, starts), np.add.reduceat(h, starts))


def side_scores(g: np.ndarray, h: np.ndarray, size: int, limits: Limits):
    """For each cut, and missing values right or left: gain over the unsplit node and the left sums.

    Not allowed cuts, with too little hessian on one side, have the gain -inf.
    """
    total_g, total_h = g[:size].sum() + g[-1], h[:size].sum() + h[-1]
    gl, hl = np.cumsum(g[:size]), np.cumsum(h[:size])
    gl, hl = np.stack([gl, gl + g[-1]], axis=1), np.stack([hl, hl + h[-1]], axis=1)
    gr, hr = total_g - gl, total_h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (hl + limits.l2) + gr**2 / (hr + limits.l2) - total_g**2 / (total_h + limits.l2)
    allowed = (hl >= max(limits.min_hessian, 1e-12)) & (hr >= max(limits.min_hessian, 1e-12))
    # Without missing values both ways are the same; the first counts.
    allowed[:, 1] &= h[-1] > 0
    # A cut above all values parts nothing but missing values.
    allowed[-1:, 1] = False
    return np.where(allowed, gain, -np.inf), gl, hl, total_g, total_h


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [p.split() for p in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _best_splits(sizes: list[int], limits: Limits):
    """The best split of each node by each feature of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for f, node, g, h in _sums(table):
            gain, gl, hl, total_g, total_h = side_scores(g, h, sizes[f], limits)
            if gain.size and np.isfinite(gain).any():
                b, side = np.unravel_index(gain.argmax(), gain.shape)
                best = gain[b, side], int(b), bool(side), gl[b, side], hl[b, side], total_g - gl[b, side], total_h - hl[b, side]
            else:
                best = -np.inf, 0, False, total_g, total_h, 0.0, 0.0
            rows.append((node, f, *best))
        return _table(_SPLIT, rows)

    return run


# --------------------------------------------------------------------------
# Training


def _level_wise_tree(blocks, ensemble, cuts, depth, limits, rate, seed, learning_rate, bucket) -> Tree:
    tree, sums = Tree(), {}
    sizes = [len(c) for c in cuts]
    nodes = [tree.add()]
    for _ in range(depth):
        if not nodes:
            break
        partial = blocks.select(*_SUMMED).mapInArrow(_histograms(ensemble, tree, nodes, sizes, rate, seed, bucket), _HISTOGRAM)
        rows = partial.groupBy("bucket").applyInArrow(_best_splits(sizes, limits), _SPLIT).collect()
        following = []
        for node in nodes:
            found = [r for r in rows if r["node"] == node]
            if not found:
                sums[node] = (0.0, 0.0)
                continue
            best = min(found, key=lambda r: (-r["gain"], r["feature"]))
            sums[node] = (best["gl"] + best["gr"], best["hl"] + best["hr"])
            tree.cover[node] = sums[node][1]
            if not best["gain"] > limits.min_gain:
                continue
            f, cut = best["feature"], best["bin"]
            sides = (best["gl"], best["hl"]), (best["gr"], best["hr"])
            children = tree.split(node, f, cut, float(cuts[f][cut]), best["default_left"], best["gain"], [h for _, h in sides])
            sums.update(zip(children, sides))
            following += children
        nodes = following
    tree.value = np.array([[-learning_rate * g / (h + limits.l2) if h + limits.l2 > 0 else 0.0 for g, h in (sums[n] for n in range(len(tree.feature)))]])
    return tree


def order_place(key: str | Sequence[str], seed: int = 42) -> Column:
    """The place of a row in the random order, from 0 to 1: the first 52 bits of md5(key:seed)."""
    keys = [key] if isinstance(key, str) else list(key)
    bits = F.conv(F.substring(digest([*[col(k) for k in keys], seed]), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(16**13))


def train_boosting(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    kind: str = "second_order",
    rounds: int = 100,
    depth: int = 6,
    learning_rate: float = 0.3,
    l2: float = 1.0,
    min_gain: float = 0.0,
    min_hessian: float = 1.0,
    bins: int = 256,
    subsampling: float = 1.0,
    weight: str | None = None,
    key: str | Sequence[str] | None = None,
    seed: int = 42,
    prefix_rows: int = 64,
) -> BoostedModel:
    """Fit an ensemble on the labelled rows of ``df``.

    ``key`` names the columns that give the random order of ``ordered`` and of
    ``subsampling``; without it the features do. ``prefix_rows`` is
    about the size of the shortest prefix model. Null and NaN are missing values.
    """
    if kind not in ("second_order", "ordered"):
        raise ValueError(f"no boosting named {kind!r}")
    features, d = list(features), len(features)
    if not 2 <= bins < MISSING:
        raise ValueError("bins must be from 2 to 65534")
    order = list([key] if isinstance(key, str) else key) if key is not None else features
    labelled = df.where(col(target).isNotNull())
    rows = labelled.select(
        col(target).cast("double").alias("__y"),
        (col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
        order_place(order, seed).alias("__place"),
        *[F.coalesce(col(f).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, f in enumerate(features)],
    )
    rows.persist()  # counted, then dealt out
    try:
        blocks = materialize(spread(rows, rows.count()).mapInArrow(_blocks(d, kind == "ordered"), _BLOCK), "blocks")
    finally:
        rows.unpersist()

    def totals(batches):
        for batch in batches:
            found = [[_numbers(batch.column(c)[i]) for c in ("label", "weight")] for i in range(batch.num_rows)]
            columns = [[float(len(y)), float(w.sum()), float(w @ y)] for y, w in found]
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in columns]) for j in range(3)], ["n", "w", "wy"])

    whole = blocks.mapInArrow(totals, "n double, w double, wy double").agg(F.sum("n"), F.sum("w"), F.sum("wy")).first()
    n, w, wy = (x or 0.0 for x in whole)
    share = min(max(wy / w, 1e-6), 1 - 1e-6) if w else 0.5
    base = math.log(share / (1 - share))
    prefixes: tuple[float, ...] = ()
    if kind == "ordered":
        halvings = max(1, int(math.log2(max(2.0, n / prefix_rows))))
        prefixes = tuple(0.5**j for j in range(halvings, 0, -1))
    limits = Limits(l2, min_gain, min_hessian)
    if kind == "ordered":
        from riskframe.operators.ordered import OrderedEnsemble, grow_ordered  # builds on this module

        ordered = OrderedEnsemble(d, base, prefixes)
        return BoostedModel(tuple(features), base, grow_ordered(blocks, n, ordered, rounds, depth, limits, subsampling, seed, learning_rate, bins))
    ensemble = _Ensemble(d, base)
    trees: list[Tree] = []
    narrow = before = None
    try:
        for number in range(rounds):
            if not n:
                break
            if number % REFRESH == 0:
                older, cuts = blocks, find_cuts(blocks, ensemble, bins)
                blocks = materialize(older.mapInArrow(_refreshed(ensemble, cuts), _BLOCK), "blocks")
                if narrow is not None:
                    narrow.unpersist()
                discard(older)
                ensemble = _Ensemble(d, base)
                narrow = _with_trees(blocks, ensemble)
                bucket = max(1, GROUP_BYTES // (16 * (bins + 1)) // blocks.rdd.getNumPartitions())
            tree = _level_wise_tree(narrow, ensemble, cuts, depth, limits, subsampling, seed + number, learning_rate, bucket)
            if before is not None:  # its rows are all in the one that followed
                before.unpersist()
                before = None
            trees.append(tree)
            ensemble.recent.append(tree)
            if (number + 1) % REFRESH and number + 1 < rounds:
                before, narrow = narrow, _with_trees(narrow, _Ensemble(d, base, recent=[tree]))
    finally:
        for kept in (narrow, before):
            if kept is not None:
                kept.unpersist()
        discard(blocks)
    return BoostedModel(tuple(features), base, trees)


# --------------------------------------------------------------------------
# Ordered target statistics


def ordered_codes(
    df: DataFrame,
    key: str,
    column: str,
    target: str,
    prior: float,
    strength: float = 1.0,
    seed: int = 42,
    out: str = "code",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``df`` with the mean target of the earlier rows of the same category, drawn towards ``prior``.

    Rows stand in the order of md5(key:seed). A row's code is (sum of earlier targets +
    prior * strength) / (number of earlier rows + strength), so it does not depend on its own
    target. A category's rows are summed by parts of the order first, so no task holds a whole
    category. Missing values are a category of their own; ``key`` must be unique, rows without a
    target count for nobody.
    """
    rows = df.count()
    digits = max(1, math.ceil(math.log(max(1.0, rows / part_rows), 16)))
    tagged = df.withColumns(
        {
            "__digest": digest([col(key), seed]),
            "__none": col(column).isNull(),
            "__category": F.coalesce(col(column).cast("string"), F.lit("")),
            "__known": col(target).isNotNull().cast("long"),
            "__target": F.coalesce(col(target).cast("double"), F.lit(0.0)),
        }
    ).withColumn("__part", F.substring("__digest", 1, digits))
    group = ["__none", "__category", "__part"]
    before = Window.partitionBy("__none", "__category").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(tagged.groupBy(*group).agg(F.sum("__target").alias("s"), F.sum("__known").alias("n")), "parts")
    offsets = parts.select(
        *[F.col(g).alias(f"{g}_") for g in group],
        F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("__s0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
    )
    inside = Window.partitionBy(*group).orderBy("__digest", col(key)).rowsBetween(Window.unboundedPreceding, -1)
    running = tagged.withColumns(
        {"__s": F.coalesce(F.sum("__target").over(inside), F.lit(0.0)), "__n": F.coalesce(F.sum("__known").over(inside), F.lit(0))}
    )
    match = [F.col(g) == F.col(f"{g}_") for g in group]
    code = (F.col("__s0") + F.col("__s") + F.lit(float(prior) * strength)) / (F.col("__n0") + F.col("__n") + F.lit(float(strength)))
    return running.join(offsets, match[0] & match[1] & match[2]).select(*[col(c) for c in df.columns], code.alias(out))


def final_codes(
    train: DataFrame, df: DataFrame, column: str, target: str, prior: float, strength: float = 1.0, out: str = "code"
) -> DataFrame:
    """``df`` with the same statistic over all rows of ``train``; unseen categories have the prior."""
    known = train.where(col(target).isNotNull())
    sums = known.groupBy(col(column).alias("__c")).agg(F.sum(col(target).cast("double")).alias("__s"), F.count(F.lit(1)).alias("__n"))
    code = (F.coalesce("__s", F.lit(0.0)) + F.lit(float(prior) * strength)) / (F.coalesce("__n", F.lit(0)) + F.lit(float(strength)))
    sums = materialize(sums, "codes")
    return df.join(sums, col(column).eqNullSafe(F.col("__c")), "left").select(*[col(c) for c in df.columns], code.alias(out))
