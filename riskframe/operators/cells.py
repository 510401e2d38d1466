"""Impurity importance of a random forest with deep trees.

Values are binned, and rows with the same bins and label are one cell with a count: a
bootstrap draws Poisson(1) copies of each row, so Poisson(count) copies of a cell, and
the trees are those of the rows. While a node of a tree holds more than ``LOCAL`` cells,
one aggregate per level adds up the classes by tree, node, feature and bin; the best split
of each node reaches the driver. The cells of smaller nodes then meet by tree and node, and
one task grows the rest of that subtree and returns its summed gains, so no deep node
leaves its task.

A split is taken where the Gini impurity falls most, among about the root of the number
of features drawn for the node. Ties go to the smaller feature, then the lower cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import col
from riskframe.operators.boosting import Tree
from riskframe.session import spread

#: Bins of a feature; entries of the quantile sketch.
BINS, SKETCH = 32, 10_000
#: Cells of a node that one task may grow; bytes of histograms held at once while it does.
LOCAL, HISTOGRAM_BYTES = 100_000, 64 << 20
#: A split must lower the summed impurity by more than this.
LEAST_GAIN = 1e-9


def cut_points(df: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the bins but the last: every value where there are at most ``BINS``, else quantiles of all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    row = df.agg(
        *[F.percentile_approx(c, shares, SKETCH).alias(f"q{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    cuts = []
    for i, c in enumerate(names):
        values = [r[0] for r in df.select(c).distinct().limit(BINS + 1).collect()] if row[f"n{i}"] <= 2 * BINS else []
        found = np.unique(values)[:-1] if 0 < len(values) <= BINS else np.unique(row[f"q{i}"] or [])
        cuts.append(found.astype(float))
    return cuts


def _binned(cuts: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            bins = np.stack([np.searchsorted(c, batch.column(i + 1).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)], axis=1)
            cells = pa.array([row.tobytes() for row in bins.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), cells], ["label", "cell"])

    return run


_CELLS = "block long, bins binary, labels binary, counts binary"


def _blocks(d: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = b"".join(batch.column("cell").to_pylist())
                bins = np.ascontiguousarray(np.frombuffer(rows, np.uint8).reshape(-1, d).T)
                labels, counts = (batch.column(c).to_numpy() for c in ("label", "count"))
                columns = [zlib.crc32(rows, zlib.crc32(labels.tobytes()))], [bins.tobytes()], [labels.tobytes()], [counts.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "bins", "labels", "counts"])

    return run


def _drawn(batches, d: int, seed: int, trees: range):
    """(tree, bins, labels, copies) of the cells that each tree's bootstrap holds."""
    for batch in batches:
        for block, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            bins, labels, counts = (np.frombuffer(p, k) for p, k in zip(parts, (np.uint8, np.int32, np.int64)))
            bins = bins.reshape(d, -1)
            for tree in trees:
                copies = np.random.default_rng([seed, tree, block]).poisson(counts)
                held = copies > 0
                yield tree, bins[:, held], labels[held], copies[held]


def _sums(bins: np.ndarray, labels: np.ndarray, copies: np.ndarray, node: np.ndarray, nodes: int, classes: int) -> np.ndarray:
    """Copies by node, feature, bin and class."""
    out = np.empty((nodes, len(bins), BINS, classes))
    base = node.astype(np.int64) * BINS * classes + labels
    for f, b in enumerate(bins):
        out[:, f] = np.bincount(base + b.astype(np.int64) * classes, copies, nodes * BINS * classes).reshape(nodes, BINS, classes)
    return out


def best_splits(sums: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin and summed fall of the impurity of each node's best split; ``taken`` marks the features it may use."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = [(x * x).sum(-1) / x.sum(-1) for x in (left, right, total)]
    gain = purity[0] + purity[1] - purity[2]
    gain = np.where(np.isfinite(gain) & taken[:, :, None], gain, 0.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    return best // (BINS - 1), best % (BINS - 1), gain[np.arange(len(gain)), best]


def grown_gains(bins: np.ndarray, labels: np.ndarray, copies: np.ndarray, depth: int, classes: int, tried: int, rng) -> np.ndarray:
    """Summed gains by feature of a tree of at most ``depth`` levels, grown level by level."""
    d, gains = len(bins), np.zeros(len(bins))
    node = np.zeros(bins.shape[1], np.int64)
    step = max(1, HISTOGRAM_BYTES // (d * BINS * classes * 8))
    for _ in range(depth):
        if not len(node):
            break
        order = np.argsort(node, kind="stable")
        bins, labels, copies, node = bins[:, order], labels[order], copies[order], node[order]
        nodes = int(node[-1]) + 1
        feature, cut, gain = np.empty(nodes, int), np.empty(nodes, int), np.empty(nodes)
        for at in range(0, nodes, step):
            end = min(nodes, at + step)
            mine = slice(*np.searchsorted(node, [at, end]))
            taken = rng.random((end - at, d)).argsort(1).argsort(1) < tried
            sums = _sums(bins[:, mine], labels[mine], copies[mine], node[mine] - at, end - at, classes)
            feature[at:end], cut[at:end], gain[at:end] = best_splits(sums, taken)
        split = gain > LEAST_GAIN
        gains += np.bincount(feature[split], gain[split], d)
        on = split[node]
        bins, labels, copies, node = bins[:, on], labels[on], copies[on], node[on]
        right = bins[feature[node], np.arange(len(node))] > cut[node]
        node = np.unique(node * 2 + right, return_inverse=True)[1]
    return gains


_SUMS = "tree int, node int, cells long, sums binary"
_SPLIT = "tree int, node int, cells long, feature int, bin int, gain double"
_PART = "tree int, node int, level int, bins binary, labels binary, copies binary"


def _tree_key(tree: int, node: int) -> list[int]:
    return [tree + 1, node + 1]


def counted(df: DataFrame, target: str, features: Sequence[str], dealt: bool = False) -> tuple[DataFrame, list[np.ndarray], int]:
    """The rows as blocks of counted cells, persisted, the upper ends of the bins, and the number of classes.

    ``dealt``: the rows are spread over all cores already.
    """
    names = [f"c{i}" for i in range(len(features))]
    rows = _plain(df, target, features)
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c)) for c in ["label", *names]]
    n, top, *lost = rows.agg(F.count(F.lit(1)), F.max("label"), *bad).first()
    if any(lost):
        raise ValueError("a forest needs a label and all features in every row")
    if not n:
        raise ValueError("a forest can't be fitted without rows")
    classes = int(top) + 1
    cuts = cut_points(rows, names)
    return _counted(rows, n, cuts, dealt), cuts, classes


def placed(df: DataFrame, target: str, features: Sequence[str], cuts: list[np.ndarray], dealt: bool = False) -> DataFrame:
    """Other rows as blocks of counted cells of the same bins, persisted."""
    rows = _plain(df, target, features)
    n, *lost = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull() | F.isnan(c)) for c in rows.columns]).first()
    if any(lost):
        raise ValueError("a forest needs a label and all features in every row")
    return _counted(rows, n, cuts, dealt)


def scored(blocks: DataFrame, d: int, trees: Sequence[Tree], probabilities: Callable, target: str, score: str, count: str) -> DataFrame:
    """The cells with their label, probability by ``probabilities(trees, bins)`` and number of rows."""
    shared = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for _, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bins, labels, counts = (np.frombuffer(p, k) for p, k in zip(parts, (np.uint8, np.int32, np.int64)))
                p = probabilities(shared.value, bins.reshape(d, -1))
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (labels, p, counts)], [target, score, count])

    return blocks.mapInArrow(run, f"`{target}` int, `{score}` double, `{count}` long")


def _plain(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    return df.select(col(target).cast("double").alias("label"), *[col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])


def _counted(rows: DataFrame, n: int, cuts: list[np.ndarray], dealt: bool) -> DataFrame:
    cells = (rows if dealt else spread(rows, n)).mapInArrow(_binned(cuts), "label int, cell binary").groupBy("cell", "label").count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LOCAL // 10))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "label").mapInArrow(_blocks(len(cuts)), _CELLS).persist()


def importance(df: DataFrame, target: str, features: Sequence[str], trees: int, depth: int, seed: int) -> dict[str, float]:
    """Share of the mean decrease in impurity per feature; each tree counts the same."""
    d, tried = len(features), math.ceil(math.sqrt(len(features)))
    blocks, _, classes = counted(df, target, features)
    gains = np.zeros((trees, d))
    grown = [Tree() for _ in range(trees)]
    level = [{tree.add(): 0} for tree in grown]  # levels of the nodes
    large, small = [[0] for _ in grown], [[] for _ in grown]

    def histograms(batches):
        sums: dict[tuple[int, int], list] = {}
        for tree, bins, labels, copies in _drawn(batches, d, seed, range(trees)):
            if large[tree]:
                place = np.full(len(grown[tree].feature), -1)
                place[large[tree]] = np.arange(len(large[tree]))
                at = place[grown[tree].leaves(bins, True)]
                on = at >= 0
                found = _sums(bins[:, on], labels[on], copies[on], at[on], len(large[tree]), classes)
                for node, cells, part in zip(large[tree], np.bincount(at[on], minlength=len(large[tree])), found):
                    held = sums.setdefault((tree, node), [0, 0.0])
                    held[0], held[1] = held[0] + int(cells), held[1] + part
        if sums:
            columns = [t for t, _ in sums], [x for _, x in sums], [c for c, _ in sums.values()], [s.tobytes() for _, s in sums.values()]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "node", "cells", "sums"])

    def split(table: pa.Table) -> pa.Table:
        tree, node = (table.column(c)[0].as_py() for c in ("tree", "node"))
        sums = sum(np.frombuffer(s) for s in table.column("sums").to_pylist()).reshape(1, d, BINS, classes)
        taken = np.random.default_rng([seed, *_tree_key(tree, node)]).permutation(d) < tried
        f, b, gain = (x[0].item() for x in best_splits(sums, taken[None]))
        row = tree, node, sum(table.column("cells").to_pylist()), f, b, gain
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [p.split()[0] for p in _SPLIT.split(", ")])

    def subtrees(batches):
        for tree, bins, labels, copies in _drawn(batches, d, seed, range(trees)):
            leaf = grown[tree].leaves(bins, True)
            rows = []
            for node in small[tree]:
                on = leaf == node
                if on.any():
                    rows.append((tree, node, level[tree][node], bins[:, on].tobytes(), labels[on].tobytes(), copies[on].tobytes()))
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in _PART.split(", ")])

    def rest(table: pa.Table) -> pa.Table:
        tree, node, from_level = (table.column(c)[0].as_py() for c in ("tree", "node", "level"))
        parts = [[np.frombuffer(b, k) for b in table.column(c).to_pylist()] for c, k in (("bins", np.uint8), ("labels", np.int32), ("copies", np.int64))]
        bins = np.concatenate([b.reshape(d, -1) for b in parts[0]], axis=1)
        rng = np.random.default_rng([seed, *_tree_key(tree, node), 1])
        found = grown_gains(bins, np.concatenate(parts[1]), np.concatenate(parts[2]), depth - from_level, classes, tried, rng)
        kept = np.flatnonzero(found)
        columns = pa.array(np.full(len(kept), tree), pa.int32()), pa.array(kept, pa.int32()), pa.array(found[kept])
        return pa.Table.from_arrays(list(columns), ["tree", "feature", "gain"])

    try:
        if blocks.agg(F.sum(F.octet_length("labels"))).first()[0] // 4 <= LOCAL:
            large, small = small, large
        while any(large):
            found = blocks.mapInArrow(histograms, _SUMS).groupBy("tree", "node").applyInArrow(split, _SPLIT).collect()
            large = [[] for _ in grown]
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                t, node = r["tree"], r["node"]
                if r["cells"] <= LOCAL:
                    small[t].append(node)
                elif r["gain"] > LEAST_GAIN and level[t][node] < depth:
                    gains[t, r["feature"]] += r["gain"]
                    children = grown[t].split(node, r["feature"], r["bin"], 0.0, False, r["gain"], (0.0, 0.0))
                    level[t].update(dict.fromkeys(children, level[t][node] + 1))
                    large[t] += children
        deep = blocks.mapInArrow(subtrees, _PART).groupBy("tree", "node").applyInArrow(rest, "tree int, feature int, gain double")
        for r in deep.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
            gains[r["tree"], r["feature"]] += r["gain"]
    finally:
        blocks.unpersist()
    whole = gains.sum(1, keepdims=True)
    shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(0)
    return dict(zip(features, (shares / (shares.sum() or 1.0)).tolist()))
