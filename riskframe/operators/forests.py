"""Random forests for a class target on counted cells; several forests of the same rows are grown together.

The method is that of ``pyspark.ml``: a bootstrap draws Poisson(1) copies of each row, a node is split where the Gini
impurity falls most among about the root of the number of features drawn for it, a split leaves
``minInstancesPerNode`` copies on both sides, and siblings with the same prediction are joined at the end; a forest of one
tree draws no features, one without ``bootstrap`` takes all rows. Values are binned as in ``cells``, so Poisson(count) copies of a cell stand for its rows.

While all cells fit a task (``SHARED_BYTES``) they are sent to every worker once and the trees are dealt out; a bootstrap
serves the trees of that number of all forests. Else the large nodes are split level by level from the tasks' summed histograms, and
the cells of a node with at most ``LOCAL`` cells meet in one task, which grows the subtree; histograms and moved cells
of a pass are bounded. Features are drawn by a hash of tree and node, so both ways give the same trees. Ties go to the smaller
feature, then the lower cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.boosting import Tree
from riskframe.operators.cells import BINS, LEAST_GAIN

#: Bytes of cells that every worker may hold; else cells of a node that one task may grow.
SHARED_BYTES, LOCAL = 64 << 20, 100_000
#: Bytes of histograms held at once; bytes of cells that one pass may move to the tasks that grow them.
HISTOGRAM_BYTES, MOVED_BYTES = 64 << 20, 2 << 30
#: Cells that are worked on together.
STEP = 4_096


@dataclass(frozen=True)
class Setting:
    """Size of a forest; the names are those of ``pyspark.ml``."""

    numTrees: int = 100
    maxDepth: int = 8
    minInstancesPerNode: int = 1
    bootstrap: bool = True

    def __post_init__(self):
        if self.numTrees < 1 or not 0 <= self.maxDepth <= 30 or self.minInstancesPerNode < 1:
            raise ValueError("a forest needs a tree, at most 30 levels, and a row in a leaf")

    def tried(self, d: int) -> int:
        return d if self.numTrees == 1 else int(np.ceil(np.sqrt(d)))


#: Parameters of ``pyspark.ml`` that a Setting knows.
NAMES = frozenset(Setting.__dataclass_fields__)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _features(seed: int, tree: int, heap: np.ndarray, d: int, tried: int) -> np.ndarray:
    """The features that each node may use, in ascending order; ``heap``: 1 for the root, 2i and 2i + 1 below i."""
    if tried >= d:
        return np.tile(np.arange(d), (len(heap), 1))
    start = _mixed(np.array([(seed * 0x9E3779B97F4A7C15 + tree + 1) % 2**64], np.uint64))
    number = _mixed(_mixed(heap.astype(np.uint64) + start)[:, None] + np.arange(d, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(number.argsort(1, kind="stable")[:, :tried], axis=1)


def _copies(counts: np.ndarray, seed: int, tree: int, block: int, bootstrap: bool) -> np.ndarray:
    return counts if not bootstrap else np.random.default_rng([seed, tree, block]).poisson(counts)


def _histograms(codes, index, node, copies, taken, classes, out) -> None:
    """Add copies by node, drawn feature, bin and class; ``codes`` has bin * classes + label by cell and feature."""
    nodes, tried = taken.shape
    d, width, flat = codes.shape[1], BINS * classes, codes.ravel()
    base, first = node * width, index * d
    for j in range(tried):
        key = flat.take(first + np.ascontiguousarray(taken[:, j]).take(node)) + base
        out[:, j] += np.bincount(key, copies, nodes * width).reshape(nodes, BINS, classes)


def _best(sums: np.ndarray, taken: np.ndarray, least: int):
    """Feature, bin, fall of the summed impurity and the left classes of each node's best split."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1]
    right = total - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    gain = (left * left).sum(-1) / np.maximum(n_left, 1) + (right * right).sum(-1) / np.maximum(n_right, 1)
    gain -= (total * total).sum(-1) / np.maximum(total.sum(-1), 1)
    gain = np.where((n_left >= max(1, least)) & (n_right >= max(1, least)), gain, 0.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    each = np.arange(len(sums))
    place, cut = best // (BINS - 1), best % (BINS - 1)
    return taken[each, place], cut, gain[each, best], left[each, place, cut]


def _splittable(counts: np.ndarray, least: int) -> np.ndarray:
    return ((counts > 0).sum(1) > 1) & (counts.sum(1) >= 2 * max(1, least))


_PARTS = ["feature", "bin", "left", "counts"]


class _Nodes:
    """The nodes of a tree while it grows; the right child follows the left one."""

    def __init__(self, root: np.ndarray, depth: int, classes: int, least: int):
        self.depth, self.classes, self.least = depth, classes, least
        self.made, self.counts, self.splits = 1, [root], []

    def split(self, ids, heaps, levels, totals, best):
        """Note the best splits of open nodes; the children's places among the open ones (or -1), and these."""
        f, b, gain, on_left = best
        taken = np.flatnonzero(gain > LEAST_GAIN)
        low = self.made + 2 * np.arange(len(taken))
        self.splits.append((ids[taken], f[taken], b[taken], low))
        below = np.stack([on_left[taken], totals[taken] - on_left[taken]], axis=1).reshape(-1, self.classes)
        self.counts.append(below)
        self.made += len(below)
        level = np.repeat(levels[taken] + 1, 2)
        opened = np.flatnonzero(_splittable(below, self.least) & (level < self.depth))
        place = np.full(len(below), -1)
        place[opened] = np.arange(len(opened))
        child = np.full((len(ids), 2), -1)
        child[taken] = place.reshape(-1, 2)
        heap = np.repeat(heaps[taken], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(taken))
        return child, (self.made - len(below) + opened, heap[opened], level[opened], below[opened])

    def arrays(self) -> list[np.ndarray]:
        """(feature, bin, left child, class counts)."""
        feature, cut, left = np.full(self.made, -1), np.zeros(self.made, int), np.full(self.made, -1)
        for ids, f, b, low in self.splits:
            feature[ids], cut[ids], left[ids] = f, b, low
        return [feature, cut, left, np.concatenate(self.counts)]


def grown(codes: np.ndarray, copies: np.ndarray, depth: int, classes: int, tried: int, least: int, seed: int, tree: int, heap: int = 1):
    """(feature, bin, left child, class counts) of the nodes of a tree on the cells of ``codes``, a row per cell.

    The cells of a large node are kept together, so nothing is looked up by node; small nodes are split all at once.
    """
    d, width = codes.shape[1], BINS * classes
    held = np.flatnonzero(copies)
    if len(held) < len(copies):
        codes, copies = codes.take(held, axis=0), copies.take(held)
    copies = copies.astype(float)
    root = np.bincount(codes[:, 0] % classes, copies, classes)[None]
    nodes = _Nodes(root, depth, classes, least)
    large, small = [], []
    if depth and _splittable(root, least)[0]:
        (large if len(codes) > STEP else small).append((0, heap, 0, root[0], codes, copies))

    def opened(listed):
        ids, heaps, levels, totals = (np.array(x) for x in list(zip(*listed))[:4])
        return ids, heaps.astype(np.uint64), levels, totals

    while large:
        now = opened(large)
        taken = _features(seed, tree, now[1], d, tried)
        sums = np.stack([np.stack([np.bincount(x[4][:, f], x[5], width) for f in t]) for x, t in zip(large, taken)])
        best = _best(sums.reshape(len(large), tried, BINS, classes), taken, least)
        child, below = nodes.split(*now, best)
        following = []
        for i, (*_, mine, weight) in enumerate(large):
            if child[i].max() >= 0:
                right = mine[:, best[0][i]] >= (best[1][i] + 1) * classes
                for side, c in enumerate(child[i]):
                    if c >= 0:
                        on = np.flatnonzero(right if side else ~right)
                        (following if len(on) > STEP else small).append((*(x[c] for x in below), mine.take(on, axis=0), weight.take(on)))
        large = following
    if not small:
        return nodes.arrays()

    now = opened(small)
    codes, copies = (np.concatenate([x[i] for x in small]) for i in (4, 5))
    node = np.repeat(np.arange(len(small)), [len(x[4]) for x in small])
    index, flat, step = np.arange(len(codes)), codes.ravel(), max(1, HISTOGRAM_BYTES // (tried * width * 8))
    while len(index):
        m, found = len(now[0]), []
        taken = _features(seed, tree, now[1], d, tried)
        for at in range(0, m, step):
            end = min(m, at + step)
            mine = slice(None) if m <= step else np.flatnonzero((node >= at) & (node < end))
            sums = np.zeros((end - at, tried, BINS, classes))
            _histograms(codes, index[mine], node[mine] - at, copies[mine], taken[at:end], classes, sums)
            found.append(_best(sums, taken[at:end], least))
        best = [np.concatenate(x) for x in zip(*found)]
        child, below = nodes.split(*now, best)
        right = flat.take(index * d + best[0].take(node)) >= ((best[1] + 1) * classes).take(node)
        node = child.ravel().take(2 * node + right)
        on = np.flatnonzero(node >= 0)
        index, node, copies, now = index.take(on), node.take(on), copies.take(on), below
    return nodes.arrays()


def pruned(feature, cut, left, counts):
    """The same nodes, siblings that are leaves with the same prediction joined, and those no more reached left out."""
    feature, predicted = feature.copy(), counts.argmax(1)
    inner = np.flatnonzero(feature >= 0)
    while len(inner):
        low = left[inner]
        same = (feature[low] < 0) & (feature[low + 1] < 0) & (predicted[low] == predicted[low + 1])
        if not same.any():
            break
        # The counts of a joined node are its own, and so is the prediction: both sides' classes add up to it.
        feature[inner[same]] = -1
        predicted[inner[same]] = predicted[low[same]]
        inner = inner[~same]
    kept = np.zeros(len(feature), bool)
    level = np.zeros(1, int)
    while len(level):
        kept[level] = True
        low = left[level[feature[level] >= 0]]
        level = np.concatenate([low, low + 1])
    number = np.cumsum(kept) - 1
    feature, left = feature[kept], left[kept]
    return [feature, cut[kept], np.where(feature >= 0, number[left], -1), counts[kept]]


def _tree(parts, cuts: list[np.ndarray]) -> Tree:
    feature, cut, left, counts = parts
    total = counts.sum(1)
    share = np.divide(counts[:, 1], total, out=np.zeros(len(total)), where=total > 0)
    threshold = np.array([cuts[f][b] if f >= 0 and b < len(cuts[f]) else 0.0 for f, b in zip(feature, cut)])
    right = np.where(feature >= 0, left + 1, -1)
    none = np.zeros(len(feature), bool)
    return Tree(feature, threshold, cut, none, left, right, none, total, share[None])


def grow_forests(blocks: DataFrame, cuts: list[np.ndarray], classes: int, settings: Sequence[Setting], seed: int = 42) -> list[list[Tree]]:
    """The trees of each setting's forest on the cells of ``cells.counted``."""
    d, classes = len(cuts), max(2, classes)
    cells = (blocks.agg(F.sum(F.octet_length("labels"))).first()[0] or 0) // 4
    if cells * (d + 9) <= SHARED_BYTES:
        found = _grown_from_all(blocks, d, classes, settings, seed)
    else:
        found = [_grown_apart(blocks, d, classes, s, seed) for s in settings]
    return [[_tree(t, cuts) for t in forest] for forest in found]


def _kind(classes: int):
    return np.uint8 if BINS * classes <= 256 else np.int32


def _coded(bins: np.ndarray, labels: np.ndarray, classes: int) -> np.ndarray:
    """bin * classes + label by cell and feature."""
    kind = _kind(classes)
    return np.ascontiguousarray(bins.T).astype(kind) * kind(classes) + labels.astype(kind)[:, None]


def _grown_from_all(blocks: DataFrame, d: int, classes: int, settings: Sequence[Setting], seed: int) -> list[list]:
    sc = blocks.sparkSession.sparkContext
    held = sorted((r["block"], r["bins"], r["labels"], r["counts"]) for r in blocks.collect())  # at most SHARED_BYTES
    bins = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(d, -1) for r in held], axis=1)
    labels = np.concatenate([np.frombuffer(r[2], np.int32) for r in held])
    counts = [np.frombuffer(r[3], np.int64) for r in held]
    shared = sc.broadcast((_coded(bins, labels, classes), [(r[0], c) for r, c in zip(held, counts)]))
    del held, bins, labels, counts

    def trees(numbers):
        codes, parts = shared.value
        for tree in numbers:
            for bootstrap in (True, False):
                wanted = [i for i, s in enumerate(settings) if tree < s.numTrees and s.bootstrap == bootstrap]
                if wanted:
                    copies = np.concatenate([_copies(c, seed, tree, block, bootstrap) for block, c in parts])
                for i in wanted:
                    s = settings[i]
                    parts_of_tree = grown(codes, copies, s.maxDepth, classes, s.tried(d), s.minInstancesPerNode, seed, tree)
                    yield i, tree, pruned(*parts_of_tree)

    most = max(s.numTrees for s in settings)
    parts = min(most, 6 * sc.defaultParallelism)
    # Later numbers have fewer trees, so they are dealt in turn.
    dealt = sorted(range(most), key=lambda t: (t % parts, t))
    found = sc.parallelize(dealt, parts).mapPartitions(trees).collect()
    shared.destroy()
    out: list[list] = [[None] * s.numTrees for s in settings]
    for i, tree, parts_of_tree in found:
        out[i][tree] = parts_of_tree
    return out


_SUMS = "tree int, node int, cells long, sums binary"
_SPLIT = "tree int, node int, cells long, feature int, bin int, gain double, counts binary, left binary"
_CELLS = "tree int, node int, codes binary, copies binary"
_GROWN = "tree int, node int, feature binary, bin binary, left binary, counts binary"


def _record(schema: str, rows: list[tuple], table: bool = False):
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [p.split() for p in schema.split(", ")]
    arrays = [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)]
    return (pa.Table if table else pa.RecordBatch).from_arrays(arrays, [n for n, _ in fields])


def _ends(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray, classes: int) -> np.ndarray:
    """The node in which each cell ends; leaves lead to themselves."""
    inner = feature >= 0
    child = np.stack([np.where(inner, left + s, np.arange(len(left))) for s in (0, 1)], axis=1).ravel()
    n, d = codes.shape
    start, limit = np.where(inner, feature, 0), (cut + 1) * classes
    flat, rows, node = codes.ravel(), np.arange(n) * d, np.zeros(n, np.intp)
    while inner.take(node).any():
        node = child.take(2 * node + (flat.take(start.take(node) + rows) >= limit.take(node)))
    return node


def _grown_apart(blocks: DataFrame, d: int, classes: int, setting: Setting, seed: int) -> list[list]:
    """The trees of a forest whose cells no task can hold."""
    trees, depth, least, tried = setting.numTrees, setting.maxDepth, setting.minInstancesPerNode, setting.tried(d)
    size = BINS * classes * tried
    nodes = [[[-1, 0, -1, None]] for _ in range(trees)]  # feature, bin, left child, class counts
    heap = [{0: 1} for _ in range(trees)]
    large, small = [(t, 0) for t in range(trees)], []

    def cells_of(batches, shapes, wanted: dict[int, list[int]]):
        """(tree, place of each held cell's node in the tree's list, codes, copies) of the cells in the wanted nodes."""
        for batch in batches:
            for block, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bins, labels, counts = (np.frombuffer(p, k) for p, k in zip(parts, (np.uint8, np.int32, np.int64)))
                codes = _coded(bins.reshape(d, -1), labels, classes)
                for tree, mine in wanted.items():
                    copies = _copies(counts, seed, tree, block, setting.bootstrap)
                    place = np.full(len(shapes[tree][0]), -1)
                    place[mine] = np.arange(len(mine))
                    at = place[_ends(*shapes[tree], codes, classes)]
                    on = np.flatnonzero((at >= 0) & (copies > 0))
                    yield tree, at[on], codes[on], copies[on]

    def shapes_of(wanted):
        return {t: tuple(np.array([n[i] for n in nodes[t]]) for i in range(3)) for t in wanted}

    def by_tree(pairs):
        wanted: dict[int, list[int]] = {}
        for t, node in pairs:
            wanted.setdefault(t, []).append(node)
        return wanted

    def split_pass(pairs):
        wanted, heaps = by_tree(pairs), {t: heap[t] for t, _ in pairs}
        shapes = shapes_of(wanted)
        drawn = {t: _features(seed, t, np.array([heaps[t][x] for x in mine], np.uint64), d, tried) for t, mine in wanted.items()}

        def histograms(batches):
            sums = {t: np.zeros((len(mine), tried, BINS, classes)) for t, mine in wanted.items()}
            cells = {t: np.zeros(len(mine), np.int64) for t, mine in wanted.items()}
            for t, at, codes, copies in cells_of(batches, shapes, wanted):
                _histograms(codes, np.arange(len(at)), at, copies.astype(float), drawn[t], classes, sums[t])
                cells[t] += np.bincount(at, minlength=len(cells[t]))
            for t, mine in wanted.items():
                yield _record(_SUMS, [(t, x, int(c), s.tobytes()) for x, c, s in zip(mine, cells[t], sums[t]) if c])

        def split(table: pa.Table) -> pa.Table:
            t, x = (table.column(c)[0].as_py() for c in ("tree", "node"))
            sums = sum(np.frombuffer(s) for s in table.column("sums").to_pylist()).reshape(1, tried, BINS, classes)
            f, b, gain, on_left = _best(sums, drawn[t][[wanted[t].index(x)]], least)
            total = sums[0, 0].sum(0)
            return _record(_SPLIT, [(t, x, sum(table.column("cells").to_pylist()), int(f[0]), int(b[0]), float(gain[0]), total.tobytes(), on_left[0].tobytes())], True)

        return blocks.mapInArrow(histograms, _SUMS).groupBy("tree", "node").applyInArrow(split, _SPLIT).collect()

    def grow_pass(pairs):
        wanted, heaps = by_tree(pairs), {t: heap[t] for t, _ in pairs}
        shapes = shapes_of(wanted)

        def moved(batches):
            for t, at, codes, copies in cells_of(batches, shapes, wanted):
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(at) else []
                rows = [(t, wanted[t][at[o[0]]], codes[o].tobytes(), copies[o].tobytes()) for o in np.split(order, first[1:]) if len(o)]
                yield _record(_CELLS, rows)

        def rest(table: pa.Table) -> pa.Table:
            t, x = (table.column(c)[0].as_py() for c in ("tree", "node"))
            codes = np.concatenate([np.frombuffer(b, _kind(classes)) for b in table.column("codes").to_pylist()]).reshape(-1, d)
            copies = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("copies").to_pylist()])
            below = depth - (heaps[t][x].bit_length() - 1)
            made = pruned(*grown(codes, copies, below, classes, tried, least, seed, t, heaps[t][x]))
            return _record(_GROWN, [(t, x, *[a.astype(np.int64 if i < 3 else float).tobytes() for i, a in enumerate(made)])], True)

        return blocks.mapInArrow(moved, _CELLS).groupBy("tree", "node").applyInArrow(rest, _GROWN).collect()

    step = max(1, HISTOGRAM_BYTES // (size * 8))
    while large:
        following = []
        for at in range(0, len(large), step):
            for r in sorted(split_pass(large[at : at + step]), key=lambda r: (r["tree"], r["node"])):
                t, x = r["tree"], r["node"]
                total, on_left = np.frombuffer(r["counts"]), np.frombuffer(r["left"])
                nodes[t][x][3] = total
                below = depth - (heap[t][x].bit_length() - 1)
                if below == 0 or not _splittable(total[None], least)[0]:
                    continue
                if r["cells"] <= LOCAL:
                    small.append((t, x, r["cells"]))
                elif r["gain"] > LEAST_GAIN:
                    nodes[t][x][:3] = r["feature"], r["bin"], len(nodes[t])
                    for side, counts in enumerate((on_left, total - on_left)):
                        heap[t][len(nodes[t])] = 2 * heap[t][x] + side
                        if below > 1 and _splittable(counts[None], least)[0]:
                            following.append((t, len(nodes[t])))
                        nodes[t].append([-1, 0, -1, counts])
        large = sorted(following)
    small.sort()
    while small:
        bytes_ = np.cumsum([c * (d + 8) for _, _, c in small])
        taken = max(1, int(np.searchsorted(bytes_, MOVED_BYTES, side="right")))
        for r in sorted(grow_pass([p[:2] for p in small[:taken]]), key=lambda r: (r["tree"], r["node"])):
            t, x = r["tree"], r["node"]
            feature, cut, left = (np.frombuffer(r[c], np.int64) for c in _PARTS[:3])
            counts = np.frombuffer(r["counts"]).reshape(-1, classes)
            offset = len(nodes[t]) - 1  # the subtree's root takes the node's place
            made = [[int(f), int(b), int(l) + offset if f >= 0 else -1, c] for f, b, l, c in zip(feature, cut, left, counts)]
            nodes[t][x] = made[0]
            nodes[t] += made[1:]
        small = small[taken:]
    zero = np.zeros(classes)
    return [pruned(*[np.array([n[i] for n in tree]) for i in range(3)], np.array([zero if n[3] is None else n[3] for n in tree])) for tree in nodes]


# --------------------------------------------------------------------------
# Scores


def probabilities(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """The mean share of class 1 of each cell of bins, one row per feature."""
    d, n = bins.shape
    total, flat, every = np.zeros(n), np.ascontiguousarray(bins.T).ravel(), np.arange(n)
    for tree in trees:
        inner, value = tree.feature >= 0, tree.value[0]
        child = np.stack([tree.left, tree.right], axis=1).ravel()
        rows, node = every, np.zeros(n, np.intp)
        if not inner[0]:
            total += value[0]
            continue
        while len(rows):
            node = child.take(2 * node + (flat.take(rows * d + tree.feature.take(node)) > tree.bin.take(node)))
            on = inner.take(node)
            ended = np.flatnonzero(~on)
            total[rows.take(ended)] += value.take(node.take(ended))
            on = np.flatnonzero(on)
            rows, node = rows.take(on), node.take(on)
    return total / max(1, len(trees))


def reached_counts(blocks: DataFrame, d: int, forests: Sequence[Sequence[Tree]], thresholds: Sequence[float]) -> np.ndarray:
    """Counts of the rows in ``blocks``: an array of (negative, positive) x forests x thresholds reached."""
    sc = blocks.sparkSession.sparkContext
    shared, grid = sc.broadcast(forests), np.array(thresholds, float)

    def run(batches):
        counts = np.zeros((2, len(shared.value), len(grid) + 1), np.int64)
        for batch in batches:
            for _, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bins, labels, copies = (np.frombuffer(p, k) for p, k in zip(parts, (np.uint8, np.int32, np.int64)))
                for i, trees in enumerate(shared.value):
                    place = np.searchsorted(grid, probabilities(trees, bins.reshape(d, -1)), side="right")
                    for label in (0, 1):
                        on = labels == label
                        counts[label, i] += np.bincount(place[on], copies[on], len(grid) + 1).astype(np.int64)
        forest, reached = (i.ravel().astype(np.int32) for i in np.indices(counts.shape[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (forest, reached, counts[0].ravel(), counts[1].ravel())], ["forest", "reached", "neg", "pos"])

    try:
        summed = blocks.mapInArrow(run, "forest int, reached int, neg long, pos long").groupBy("forest", "reached").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).collect()
    finally:
        shared.destroy()
    out = np.zeros((2, len(forests), len(grid) + 1), np.int64)
    for r in summed:
        out[:, r["forest"], r["reached"]] = r["neg"], r["pos"]
    return out
