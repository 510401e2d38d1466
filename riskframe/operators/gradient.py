"""Gradient boosting of regression trees for a 0/1 target, on counted cells.

The method is that of ``pyspark.ml``'s boosting: the first tree is fitted to the labels
-1 and 1, each later one to the negative gradients 4 y / (1 + exp(2 y F)) of the log loss at
the margin F, by the fall of the squared error, and enters with the step size; a leaf has the
mean of its rows, and the log odds are twice the margin. Values are binned as in ``cells``,
with every value where there are at most ``BINS``. Rows with the same bins and label have
the same margin for ever, so a cell with its count stands for them, and a tree's sample of a
cell is a binomial draw.

While the cells are few (``WHOLE``), one task grows all trees; a job for each level would cost more than its work.
Else each task keeps its cells with their margins. A level of a tree is one pass that adds up
rows and gradients by node, feature and bin. While these sums are small they meet on the
driver in one stage; else they meet by node, and only the best splits reach the driver.
Ties go to the smaller feature, then the lower cut.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.boosting import BoostedModel, Tree
from riskframe.operators.cells import BINS, LEAST_GAIN, counted

#: Cells of a task, about; bytes of a level's sums, of all tasks, that may meet on the driver.
PART_CELLS, DRIVER_BYTES = 100_000, 1 << 20
#: Cells times features that one task boosts from the first tree to the last.
WHOLE = 4_000_000
#: Trees after which the margins are made anew from the cells, so lineages stay short.
REFRESH = 25


def _ends(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node in which each cell ends; leaves lead to themselves."""
    inner = np.array(tree.feature) >= 0
    own = np.arange(len(inner), dtype=np.int32)
    child = np.stack([np.where(inner, side, own) for side in (tree.left, tree.right)], axis=1).astype(np.int32).ravel()
    n = bins.shape[1]
    start, limit = np.where(inner, tree.feature, 0) * n, np.array(tree.bin, np.uint8)
    flat, rows, node = bins.ravel(), np.arange(n), np.zeros(n, np.int32)
    while inner[node].any():
        right = flat.take(start.take(node) + rows) > limit.take(node)
        node = child.take(2 * node + right)
    return node


def _joined(d: int):
    """One entry per task: its name, and the bins, labels -1 and 1, counts and margins of its cells."""

    def run(number, rows):
        rows = list(rows)
        if rows:
            bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(d, -1) for r in rows], axis=1)
            labels = np.concatenate([np.frombuffer(r["labels"], np.int32) for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
            yield number, bins, np.where(labels == 1, 1.0, -1.0), counts, np.zeros(len(labels))

    return run


def _stepped(trees: list[Tree], number: int, rate: float, seed: int):
    """The entries with ``trees`` in their margins, and what tree ``number`` is fitted to: copies and gradients."""

    def run(entries):
        for name, bins, y, counts, margin, *_ in entries:
            for tree in trees:
                margin = margin + tree.value[-1][_ends(tree, bins)]
            copies = counts
            if rate < 1:
                copies = np.random.default_rng([seed, number, name]).binomial(counts, rate)
            gradient = 4 * y / (1 + np.exp(np.clip(y * margin, -500, 500))) if number else y
            yield name, bins, y, counts, margin, copies.astype(float), gradient * copies

    return run


def _sums(tree: Tree, nodes: list[int]):
    """Per task the rows and gradients by node, feature and bin."""

    def run(entries):
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        for name, bins, _, _, _, copies, gradient in entries:
            at = place[_ends(tree, bins)]
            use = at >= 0
            base, n, g = at[use] * BINS, copies[use], gradient[use]
            out = np.empty((2, len(nodes), len(bins), BINS))
            for f, b in enumerate(bins):
                for held, weight in zip(out, (n, g)):
                    held[:, f] = np.bincount(base + b[use], weight, len(nodes) * BINS).reshape(len(nodes), BINS)
            yield name, out

    return run


def _by_node(nodes: list[int]):
    def run(entry):
        name, sums = entry
        return [(node, (name, sums[:, i])) for i, node in enumerate(nodes)]

    return run


def best_split(sums: np.ndarray, least: int) -> tuple:
    """(feature, bin, gain, rows left, gradients left, rows right, gradients right) of a node's best split."""
    n, g = sums
    left_n, left_g = np.cumsum(n, axis=1), np.cumsum(g, axis=1)
    total_n, total_g = left_n[:, -1:], left_g[:, -1:]
    right_n, right_g = total_n - left_n, total_g - left_g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_n + right_g**2 / right_n - total_g**2 / total_n
    least = max(1, least)
    gain = np.where((left_n >= least) & (right_n >= least), gain, 0.0)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return int(f), int(b), *(float(x[f, b]) for x in (gain, left_n, left_g, right_n, right_g))


def _met(least: int):
    def run(parts):
        return best_split(sum(sums for _, sums in sorted(parts, key=lambda p: p[0])), least)

    return run


def _following(tree: Tree, nodes: list[int], mean: dict[int, float], found: dict[int, tuple], cuts: list[np.ndarray]) -> list[int]:
    """The open nodes of the next level; ``mean`` gets theirs."""
    following = []
    for node in nodes:
        f, b, gain, left_n, left_g, right_n, right_g = found.get(node, (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
        if node == 0 and left_n + right_n:
            tree.cover[0], mean[0] = left_n + right_n, (left_g + right_g) / (left_n + right_n)
        if gain <= LEAST_GAIN:
            continue
        children = tree.split(node, f, b, float(cuts[f][b]), False, gain, (left_n, right_n))
        mean.update(zip(children, (left_g / left_n, right_g / right_n)))
        following += children
    return following


def _valued(tree: Tree, mean: dict[int, float], weight: float) -> Tree:
    # Log odds are twice the margin.
    tree.value = np.array([[2 * weight * mean[node] for node in range(len(tree.feature))]])
    return tree


def _grown(state, parts: int, d: int, cuts: list[np.ndarray], depth: int, least: int, weight: float) -> Tree:
    tree = Tree()
    nodes, mean = [tree.add()], {0: 0.0}
    for _ in range(depth):
        if not nodes:
            break
        sums = state.mapPartitions(_sums(tree, nodes))
        if len(nodes) * d * BINS * 16 * parts <= DRIVER_BYTES:
            met = sorted(sums.collect(), key=lambda p: p[0])
            found = {node: best_split(total, least) for node, total in zip(nodes, sum(s for _, s in met).swapaxes(0, 1))} if met else {}
        else:
            found = sums.flatMap(_by_node(nodes)).groupByKey(min(parts, len(nodes))).mapValues(_met(least)).collectAsMap()
        nodes = _following(tree, nodes, mean, found, cuts)
    return _valued(tree, mean, weight)


def _grown_here(bins: np.ndarray, copies: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, weight: float) -> Tree:
    """The same tree from all cells at once; each knows its open node."""
    tree, d = Tree(), len(bins)
    nodes, mean = [tree.add()], {0: 0.0}
    place = np.zeros(bins.shape[1], np.intp)
    for _ in range(depth):
        if not nodes:
            break
        sums, base = np.empty((2, len(nodes), d, BINS)), place * BINS
        for f in range(d):
            key = base + bins[f]
            for held, w in zip(sums, (copies, gradient)):
                held[:, f] = np.bincount(key, w, len(nodes) * BINS).reshape(len(nodes), BINS)
        found = {node: best_split(total, least) for node, total in zip(nodes, sums.swapaxes(0, 1))}
        open_before, nodes = nodes, _following(tree, nodes, mean, found, cuts)
        at = {node: i for i, node in enumerate(nodes)}
        child = np.array([[at.get(side[node], -1) for side in (tree.left, tree.right)] for node in open_before]).ravel()
        feature, cut = (np.array([max(0, values[node]) for node in open_before]) for values in (tree.feature, tree.bin))
        n = bins.shape[1]
        right = bins.ravel().take((feature * n).take(place) + np.arange(n)) > cut.take(place)
        place = child.take(2 * place + right)
        on = np.flatnonzero(place >= 0)
        if len(on) < n:
            bins, copies, gradient, place = bins.take(on, axis=1), copies.take(on), gradient.take(on), place.take(on)
    return _valued(tree, mean, weight)


def _boosted(cuts: list[np.ndarray], rounds: int, depth: int, rate: float, seed: int, least: int, step: float):
    """All trees from the entry of the only task."""

    def run(entries):
        for entry in entries:
            trees: list[Tree] = []
            for number in range(rounds):
                (entry,) = _stepped(trees[-1:], number, rate, seed)([entry])
                trees.append(_grown_here(entry[1], *entry[5:], cuts, depth, least, step if number else 1.0))
            yield trees

    return run


def train_gradient(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    maxIter: int = 100,
    maxDepth: int = 8,
    stepSize: float = 0.1,
    subsamplingRate: float = 1.0,
    minInstancesPerNode: int = 1,
    seed: int = 42,
    counted_rows: tuple | None = None,
) -> BoostedModel:
    """Fit ``maxIter`` trees on the labelled rows of ``df``; the names of the parameters are those of ``pyspark.ml``.

    ``counted_rows``: what ``cells.counted`` made of the rows, to share it between models.
    """
    if maxIter < 1 or not 0 <= maxDepth <= 30 or minInstancesPerNode < 1 or not (0 < stepSize <= 1 and 0 < subsamplingRate <= 1):
        raise ValueError("boosting needs a round, at most 30 levels, a row in a leaf, and a step size and a rate above 0, at most 1")
    d = len(features)
    blocks, cuts, classes = counted_rows or counted(df, target, features)
    if classes > 2:
        if counted_rows is None:
            blocks.unpersist()
        raise ValueError("boosting needs the labels 0 and 1")
    held = []
    try:
        cells = blocks.agg(F.sum(F.octet_length("labels"))).first()[0] // 4
        if cells * d <= WHOLE:
            grow = _boosted(cuts, maxIter, maxDepth, subsamplingRate, seed, minInstancesPerNode, stepSize)
            (trees,) = blocks.rdd.coalesce(1).mapPartitionsWithIndex(_joined(d)).mapPartitions(grow).collect()
            return BoostedModel(tuple(features), 0.0, trees)
        parts = min(blocks.rdd.getNumPartitions(), max(1, -(-cells // PART_CELLS)))
        entries = blocks.rdd.coalesce(parts).mapPartitionsWithIndex(_joined(d)).persist()
        state, trees = entries, []
        held = [entries]
        for number in range(maxIter):
            fresh = number % REFRESH == 0
            older, added = (entries, trees) if fresh else (state, trees[-1:])
            state = older.mapPartitions(_stepped(list(added), number, subsamplingRate, seed)).persist()
            trees.append(_grown(state, parts, d, cuts, maxDepth, minInstancesPerNode, stepSize if number else 1.0))
            for past in held[1:]:  # the first level read all of the newest
                past.unpersist()
            held = [entries, state]
    finally:
        for kept in held:
            kept.unpersist()
        if counted_rows is None:
            blocks.unpersist()
    return BoostedModel(tuple(features), 0.0, trees)


def probabilities(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """The probability of class 1 of each cell of bins, one row per feature."""
    margin = np.zeros(bins.shape[1])
    for tree in trees:
        margin += tree.value[-1][_ends(tree, bins)]
    return 1 / (1 + np.exp(-margin))
