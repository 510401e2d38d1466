"""Growing the symmetric trees of ordered boosting (see ``boosting`` for the method).

A row needs the scores of few models: of the one that gives its gradient, and of those it belongs to. All are prefixes
of one order, so they are the models from the row's own place on: two for the later half of the rows, three for the quarter
before it, three on average however many prefixes there are. The rows of a block stand in their order, and a block keeps
these scores alone, model by model.

Each task keeps its rows in two forms: bins, gradients and hessians, which a level reads, and bins, labels and scores,
which a finished tree reads twice, for its leaf values and to add them. All nodes of a level have one split, so a row's
node is the number made of its answers. While a level's sums are small they meet on the driver in one stage; else
they meet by feature and nodes, and only the summed gains reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from riskframe.operators import boosting
from riskframe.operators.boosting import MISSING, Limits, Tree, _derivatives, _drawn, _Ensemble, _numbers
from riskframe.session import discard, materialize

#: Rows of a task, about.
PART_ROWS = 1_000_000
#: Splits of the levels: (feature, bin, threshold, missing values to the left).
Levels = Sequence[tuple[int, int, float, bool]]


def levels_of(tree: Tree) -> Levels:
    """The splits of a symmetric tree; the leaf of a row with the number i is the i-th of the last nodes."""
    out, node = [], 0
    while tree.feature[node] >= 0:
        out.append((tree.feature[node], tree.bin[node], tree.threshold[node], tree.default_left[node]))
        node = tree.left[node]
    return out


def positions(levels: Levels, columns: np.ndarray, missing: int | None = None) -> np.ndarray:
    """The number of each row among the nodes of the level below; ``columns`` are bins, or values without ``missing``."""
    node = np.zeros(columns.shape[1], np.intp)
    for f, cut, threshold, default_left in levels:
        x = columns[f]
        right = ~(x <= threshold) if missing is None else x > cut
        if default_left:
            right &= ~np.isnan(x) if missing is None else x != missing
        node *= 2
        node += right
    return node


@dataclass
class OrderedEnsemble(_Ensemble):
    """Scores are lists: for each model that gives gradients, those of it and of all later models for its rows."""

    def bounds(self, place: np.ndarray) -> np.ndarray:
        """Where the rows of each model begin and end; ``place`` ascends."""
        return np.searchsorted(place, np.r_[0.0, self.prefixes, np.inf], side="left")

    def empty(self, place: np.ndarray) -> list[np.ndarray]:
        return [np.full((self.models() - k, n), self.base) for k, n in enumerate(np.diff(self.bounds(place)))]

    def stored(self, data: bytes, place: np.ndarray) -> list[np.ndarray]:
        out, at = self.empty(place), 0
        if len(data):
            values = np.frombuffer(data)
            for k, m in enumerate(out):
                out[k] = values[at : at + m.size].reshape(m.shape)
                at += m.size
        return out

    def scores(self, batch, i: int, columns: np.ndarray, binned: bool) -> list[np.ndarray]:
        margins = self.stored(batch.column("margin")[i].as_py(), _numbers(batch.column("place")[i]))
        for tree in self.recent:
            levels = levels_of(tree)
            margins = added(margins, leaf_values(tree, levels), positions(levels, columns))
        return margins

    def packed(self, margin: list[np.ndarray]) -> bytes:
        return b"".join(m.tobytes() for m in margin)

    def row_derivatives(self, margin: list[np.ndarray], place: np.ndarray, label: np.ndarray, weight: np.ndarray):
        return _derivatives(np.concatenate([m[0] for m in margin]), label, weight)


def leaf_values(tree: Tree, levels: Levels) -> np.ndarray:
    """Models x leaves."""
    return tree.value[:, 2 ** len(levels) - 1 :]


def added(margins: list[np.ndarray], values: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for k, m in enumerate(margins):
        out.append(m + values[k:].take(leaf[at : at + m.shape[1]], axis=1))
        at += m.shape[1]
    return out


def _joined(ensemble: OrderedEnsemble, missing: int, sampled: bool):
    """One entry per task: its name, and bins, labels, weights (one if all are 1), places if needed, and scores of its rows, by model."""

    def run(number, rows):
        rows = list(rows)
        if not rows:
            return
        place = [np.frombuffer(r["place"]) for r in rows]
        bounds = [ensemble.bounds(p) for p in place]
        margins = [ensemble.stored(r["margin"], p) for r, p in zip(rows, place)]

        def by_model(columns):
            return np.concatenate([c[..., b[k] : b[k + 1]] for k in range(ensemble.models() - 1) for c, b in zip(columns, bounds)], axis=-1)

        bins = by_model([np.frombuffer(r["bins"], np.uint16).reshape(ensemble.d, -1) for r in rows])
        bins[bins == MISSING] = missing
        label, weight = (by_model([np.frombuffer(r[c]) for r in rows]) for c in ("label", "weight"))
        # Every tree reads and writes these again, so nothing is kept that says nothing.
        small = label.astype(np.int8)
        label = small if (small == label).all() else label
        weight = weight if (weight != 1).any() else np.ones(1)
        yield number, bins, label, weight, by_model(place) if sampled else None, [np.concatenate(m, axis=1) for m in zip(*margins)]

    return run


def _with_tree(tree: Tree | None, missing: int):
    def run(entries):
        for name, bins, label, weight, place, margins in entries:
            if tree is not None:
                levels = levels_of(tree)
                margins = added(margins, leaf_values(tree, levels), positions(levels, bins, missing))
            yield name, bins, label, weight, place, margins

    return run


def _derived(entries):
    for name, bins, label, weight, place, margins in entries:
        g, h = _derivatives(np.concatenate([m[0] for m in margins]), label, weight)
        yield name, bins, g, h, place


def _histograms(levels: Levels, missing: int, rate: float, seed: int, chunk: int):
    """Per task the sums of gradient and hessian by node and bin, missing values last, for each feature and ``chunk`` of nodes."""

    def run(entries):
        nodes, width = 2 ** len(levels), missing + 1
        for name, bins, g, h, place in entries:
            base = positions(levels, bins, missing) * width
            if rate < 1:
                use = np.flatnonzero(_drawn(place, seed) < rate)
                base, g, h, bins = base[use], g[use], h[use], bins[:, use]
            sums = {}
            for f, b in enumerate(bins):
                key = base + b
                both = np.stack([np.bincount(key, x, nodes * width).reshape(nodes, width) for x in (g, h)])
                sums |= {(f, at): both[:, at : at + chunk] for at in range(0, nodes, chunk)}
            yield name, sums

    return run


def _leaf_sums(ensemble: OrderedEnsemble, levels: Levels, missing: int):
    """Per task and leaf the sums of gradient and hessian of every prefix model over its own rows."""

    def run(entries):
        leaves = 2 ** len(levels)
        for name, bins, label, weight, _, margins in entries:
            leaf, at = positions(levels, bins, missing), 0
            sums = np.zeros((ensemble.models(), 2, leaves))
            for k, m in enumerate(margins):
                mine = slice(at, at + m.shape[1])
                at += m.shape[1]
                for j, x in enumerate(m[1:], k + 1):
                    for i, v in enumerate(_derivatives(x, label[mine], weight[mine] if len(weight) > 1 else weight)):
                        sums[j, i] += np.bincount(leaf[mine], v, leaves)
            yield name, dict(enumerate(sums))

    return run


def level_gains(sums: np.ndarray, size: int, l2: float) -> np.ndarray:
    """For each cut, and missing values right or left: the gain, added up over the nodes; a node that a cut leaves whole gains nothing."""
    (g, h), none = sums, sums[1, :, -1:] > 0
    total_g, total_h = (x[:, :size].sum(1)[:, None] + x[:, -1:] for x in (g, h))
    gains = np.zeros((size, 2))
    for side in (0, 1):
        gl, hl = (np.cumsum(x[:, :size], axis=1) + side * x[:, -1:] for x in (g, h))
        gr, hr = total_g - gl, total_h - hl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
        allowed = (hl >= 1e-12) & (hr >= 1e-12) & np.isfinite(gain)
        if side:  # without missing values both ways are the same; a cut above all values parts nothing but missing values
            allowed &= none
            allowed[:, -1:] = False
        gains[:, side] = np.where(allowed, gain, 0.0).sum(0)
    return gains


def _met(sums, keys: int, bytes_: int, parts: int, finish: Callable) -> dict:
    """What ``finish`` makes of each key's sum over the tasks, added in their order."""

    def total(found):
        return sum(s for _, s in sorted(found, key=lambda p: p[0]))

    if bytes_ * parts <= boosting.GROUP_BYTES:
        met = sorted(sums.collect(), key=lambda p: p[0])
        return {key: finish(key, sum(s[key] for _, s in met)) for key in (met[0][1] if met else {})}
    apart = sums.flatMap(lambda p: [(key, (p[0], s)) for key, s in p[1].items()])
    return apart.groupByKey(min(parts, keys)).map(lambda p: (p[0], finish(p[0], total(p[1])))).collectAsMap()


def _grown(state, narrow, parts, ensemble, cuts, depth, limits: Limits, rate, seed, learning_rate, missing) -> Tree:
    tree, levels, sizes, d = Tree(), [], [len(c) for c in cuts], ensemble.d
    nodes = [tree.add()]
    for _ in range(depth):
        width = 16 * (missing + 1)
        chunk = max(1, boosting.GROUP_BYTES // width // parts)
        sums = narrow.mapPartitions(_histograms(tuple(levels), missing, rate, seed, chunk))
        found = _met(sums, d * -(-len(nodes) // chunk), d * len(nodes) * width, parts, lambda key, s: level_gains(s, sizes[key[0]], limits.l2))
        total: dict[int, np.ndarray] = {}
        for f, at in sorted(found):
            total[f] = total[f] + found[f, at] if f in total else found[f, at]
        best = min(((-gain.max(), f, int(gain.argmax())) for f, gain in total.items() if gain.size), default=None)
        if best is None or not -best[0] > limits.min_gain:
            break
        f, (cut, side) = best[1], divmod(best[2], 2)
        levels.append((f, cut, float(cuts[f][cut]), bool(side)))
        split = *levels[-1], -best[0] / len(nodes), (0.0, 0.0)
        nodes = [child for node in nodes for child in tree.split(node, *split)]
    models = ensemble.models()
    tree.value = np.zeros((models, len(tree.feature)))
    sums = state.mapPartitions(_leaf_sums(ensemble, tuple(levels), missing))
    for m, (g, h) in _met(sums, models, models * len(nodes) * 16, parts, lambda _, s: s).items():
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(h + limits.l2 > 0, -learning_rate * g / (h + limits.l2), 0.0)
        tree.value[m, nodes] = value if m else 0.0
        if m == models - 1:
            for node, cover in zip(nodes, h):
                tree.cover[node] = float(cover)
    return tree


def grow_ordered(blocks: DataFrame, rows: float, ensemble: OrderedEnsemble, rounds: int, depth: int, limits: Limits, rate: float, seed: int, learning_rate: float, bins: int) -> list[Tree]:
    """The trees on stored blocks, whose rows stand in their order; the blocks are removed."""
    trees: list[Tree] = []
    held: list = []
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, round(rows / (cores * PART_ROWS)))
    try:
        for number in range(rounds if rows else 0):
            if number % boosting.REFRESH == 0:
                older, cuts = blocks, boosting.find_cuts(blocks, ensemble, bins)
                blocks = materialize(older.mapInArrow(boosting._refreshed(ensemble, cuts), boosting._BLOCK), "blocks")
                discard(older)
                ensemble = OrderedEnsemble(ensemble.d, ensemble.base, ensemble.prefixes)
                missing = max(map(len, cuts))
                dealt = blocks.select("label", "weight", "place", "bins", "margin").repartition(parts)
                state = dealt.rdd.mapPartitionsWithIndex(_joined(ensemble, missing, rate < 1))
            else:
                state = state.mapPartitions(_with_tree(trees[-1], missing))
            past, held = held, []
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            narrow = state.mapPartitions(_derived).persist(StorageLevel.MEMORY_AND_DISK)
            held = [*past, state, narrow]
            tree = _grown(state, narrow, parts, ensemble, cuts, depth, limits, rate, seed + number, learning_rate, missing)
            for kept in past:  # the newer state holds all of it
                kept.unpersist()
            held = [state, narrow]
            trees.append(tree)
            ensemble.recent.append(tree)
    finally:
        for kept in held:
            kept.unpersist()
        discard(blocks)
    return trees
