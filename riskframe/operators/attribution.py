"""Path-dependent Shapley values of tree ensembles, in time linear in the nodes.

For one leaf the Shapley value of a feature is an integral over the multilinear
extension of the "which features are known" game (Owen, 1972): with o = does the row
satisfy all conditions on the feature along the path, z = share of training rows that
do, and v = the leaf's output,

    phi_i = v * (o_i - z_i) * integral_0^1 prod_{j != i} (t * o_j + (1 - t) * z_j) dt

The product over a path is a polynomial in t. It is kept as its values at Gauss-
Legendre points, enough of them that the integral is exact, and changed by one factor
per edge on the way down. On the way up the polynomials of a subtree's leaves are
added, so each edge is accounted for once for all leaves below it: its own feature's
factor is divided out of the sum, and if the feature stood on the path before, what
the older condition was given for these leaves is taken back. Work per row is nodes x
points, whatever the number of leaves that share a path; memory is depth x points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskframe.operators.boosting import BoostedModel
from riskframe.session import scratch_path

#: Rows that go through the trees together.
ROWS = 2_048
#: Share of a node's rows below which a child without training rows never counts.
LEAST_SHARE = 1e-12


@dataclass
class PathTree:
    """Nodes in arrays, the root first; ``feature`` is -1 in a leaf, ``value`` has one column per class."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def depth(self) -> int:
        level, nodes = 0, np.array([0])
        while True:
            nodes = nodes[self.feature[nodes] >= 0]
            if not len(nodes):
                return level
            level, nodes = level + 1, np.concatenate([self.left[nodes], self.right[nodes]])

    def shares(self) -> np.ndarray:
        """For every node the share of its parent's training rows."""
        out = np.ones(len(self.feature))
        inner = np.flatnonzero(self.feature >= 0)
        for side in (self.left, self.right):
            out[side[inner]] = self.cover[side[inner]] / np.maximum(self.cover[inner], 1e-300)
        return np.maximum(out, LEAST_SHARE)


def node_table(spark: SparkSession, model) -> list[dict]:
    """The node rows of each tree, read back from the saved model.

    The size is that of the model, not of the data.
    """
    path = scratch_path(spark, "trees")
    model.save(path)
    node = F.col("nodeData")
    rows = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            node["id"].alias("id"),
            node["prediction"].alias("prediction"),
            node["impurityStats"].alias("stats"),
            node["rawCount"].alias("n"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        )
        .collect()
    )
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return [trees[t] for t in sorted(trees)]


def path_trees(model, spark: SparkSession) -> tuple[list[PathTree], np.ndarray]:
    """The trees of an ensemble with their weighted outputs per class, and a constant beside them.

    Outputs are probabilities for a forest, log odds for boosting.
    """
    if isinstance(model, BoostedModel):
        trees = []
        for tree in model.trees:
            cover = np.array(tree.cover, float)
            # Symmetric trees know the rows of their leaves alone; children come behind their parents.
            for n in reversed(range(len(cover))):
                if tree.feature[n] >= 0:
                    cover[n] = cover[tree.left[n]] + cover[tree.right[n]]
            margin = tree.value[-1]
            arrays = [np.array(a) for a in (tree.feature, tree.threshold, tree.left, tree.right, tree.default_left)]
            trees.append(PathTree(*arrays, cover, np.stack([-margin, margin], axis=1)))
        return trees, np.array([-model.base, model.base])
    if isinstance(model, RandomForestClassificationModel):
        weights = [1.0 / model.getNumTrees] * model.getNumTrees

        def output(node):
            stats = np.array(node["stats"], dtype=float)
            return stats / stats.sum()
    elif isinstance(model, GBTClassificationModel):
        weights = list(model.treeWeights)

        def output(node):  # log odds of class 1 are twice the margin
            return np.array([-2.0 * node["prediction"], 2.0 * node["prediction"]])
    else:
        raise ValueError("not a tree ensemble")
    trees = []
    for weight, nodes in zip(weights, node_table(spark, model)):
        rows = [nodes[i] for i in range(len(nodes))]
        leaf = np.array([r["left"] < 0 for r in rows])
        trees.append(
            PathTree(
                np.where(leaf, -1, [r["feature"] for r in rows]),
                np.array([0.0 if r["threshold"] is None else r["threshold"] for r in rows]),
                np.array([r["left"] for r in rows]),
                np.array([r["right"] for r in rows]),
                np.zeros(len(rows), bool),
                np.array([r["n"] for r in rows], float),
                weight * np.array([output(r) for r in rows]),
            )
        )
    classes = trees[0].value.shape[1] if trees else 2
    return trees, np.zeros(classes)


def base_values(trees: list[PathTree], constant: np.ndarray) -> np.ndarray:
    """Mean output per class over the training rows that the trees' counts describe."""
    total = constant.astype(float).copy()
    for tree in trees:
        share = tree.shares()
        for n in range(len(share)):
            if tree.feature[n] >= 0:
                share[[tree.left[n], tree.right[n]]] *= share[n]
            else:
                total += share[n] * tree.value[n]
    return total


def _add_tree(tree: PathTree, x: np.ndarray, points: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Add one tree's contributions to ``out`` (features x classes but the first x rows)."""
    share = tree.shares()
    with np.errstate(invalid="ignore"):
        goes_left = {n: np.where(np.isnan(x[f]), tree.missing_left[n], x[f] <= tree.threshold[n]) for n, f in enumerate(tree.feature) if f >= 0}
    everything = np.ones(x.shape[1], bool)
    t, w = points[:, None], weights

    def factor(known: np.ndarray, z: float) -> np.ndarray:
        return np.where(known, t + (1 - t) * z, (1 - t) * z)

    def walk(node: int, product: np.ndarray, path: dict[int, tuple]) -> np.ndarray:
        if tree.feature[node] < 0:
            return tree.value[node, 1:, None, None] * product
        f = int(tree.feature[node])
        known, z, older = path.get(f) or (everything, 1.0, None)
        rest = product if older is None else product / older
        total = 0.0
        for child, side in ((tree.left[node], goes_left[node]), (tree.right[node], ~goes_left[node])):
            now, now_z = known & side, z * share[child]
            newer = factor(now, now_z)
            below = walk(int(child), rest * newer, {**path, f: (now, now_z, newer)})
            effect = np.einsum("k,ckr->cr", w, below / newer) * (now - now_z)
            if older is not None:
                effect -= np.einsum("k,ckr->cr", w, below / older) * (known - z)
            out[f] += effect
            total = total + below
        return total

    walk(0, np.ones((len(points), x.shape[1])), {})


def tree_shapley(x: np.ndarray, trees: list[PathTree]) -> np.ndarray:
    """(rows, classes, features) contributions of rows ``x``; NaN is missing.

    The classes' outputs of a leaf add up to the same number everywhere, so the first
    class mirrors the others.
    """
    rows, n_features = x.shape
    classes = trees[0].value.shape[1] if trees else 2
    result = np.zeros((rows, classes, n_features))
    for start in range(0, rows, ROWS):
        part = np.ascontiguousarray(x[start : start + ROWS].T)
        out = np.zeros((n_features, classes - 1, part.shape[1]))
        for tree in trees:
            # A path of d features gives polynomials of degree d - 1.
            degree = min(tree.depth(), n_features)
            points, weights = np.polynomial.legendre.leggauss(max(1, (degree + 1) // 2))
            _add_tree(tree, part, (points + 1) / 2, weights / 2, out)
        result[start : start + ROWS, 1:] = out.transpose(2, 1, 0)
    result[:, 0] = -result[:, 1:].sum(axis=1)
    return result
