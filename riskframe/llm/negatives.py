"""Hard negatives by exact integer products of anchor and candidate tiles.

Vectors are whole numbers. Anchors are dealt into panels, candidates into slices,
both by a hash and of bounded size; each cell of panel and slice is one group of a
co-grouped shuffle. Within a cell tiles of int64 are multiplied by Strassen's
recursion (seven products of quarter tiles, zero padding to even sides). Its sums
and differences are exact: they are taken modulo 2^64, like those of a plain
product, so only scores that do not fit into 64 bits themselves would wrap around.

Every tile leaves a short heap per anchor: the first same-label rows, and in a
second pass the first different-label rows within each positive's window of
scores. Heaps are merged by rank, combined before the shuffle. No pair of rows is
written beyond those heaps, whatever the labels' shares.

Defined cases: rows without an id, a label or a vector, or with a null or
non-finite component take no part; rows that share an id count once, the smallest
by label, then vector; a shorter vector is padded with zeros (an empty one scores
0 with every other); components beyond 64 bits are clamped; ties go to the smaller
id; anchors without positives, and positives with an empty window (all of a
negative score), return no row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskframe.llm.store import small_batches, keep

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors of a panel and candidates of a slice, about.
PANEL, SLICE = 4096, 4096
#: Anchors of one tile; sides up to which a tile is multiplied plainly.
TILE, LEAF = 256, 32

_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, by Strassen's seven products; exact modulo 2^64."""
    m, k = a.shape
    n = len(b)
    if min(m, k, n) <= LEAF:
        return a @ b.T
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, n % 2), (0, k % 2))))[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    # Quarters of b are transposed by the leaf: b12 of the product is the lower left one here.
    b11, b21, b12, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), np.int64)
    np.add(p1, p4, out=out[:i, :j])
    out[:i, :j] += p7 - p5
    np.add(p3, p5, out=out[:i, j:])
    np.add(p2, p4, out=out[i:, :j])
    np.subtract(p1, p2, out=out[i:, j:])
    out[i:, j:] += p3 + p6
    return out


def whole_numbers(vectors: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, computed in doubles."""
    return F.transform(vectors.cast("array<double>"), lambda x: F.floor(x * float(factor)).cast("bigint"))


def participants(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    x = F.col("v").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = (
        rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .where(finite)
        .select("id", "label", whole_numbers(F.col("v")).alias("vector"))
    )
    one = usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector")


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    """The lists of a column as rows of an int64 matrix, padded with zeros."""
    lists = table.column(name).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _width(*tables: pa.Table) -> int:
    return max(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables)


def _tiles(anchors: pa.Table, candidates: pa.Table):
    """(ids, labels of the candidates by id), and per tile its anchors' rows, ids, labels and scores."""
    candidates = candidates.sort_by("id")
    width = _width(anchors, candidates)
    a, b = _matrix(anchors, "vector", width), _matrix(candidates, "vector", width)
    ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    known = candidates.column("id").to_numpy(), candidates.column("label").to_numpy()
    for at in range(0, len(a), TILE):
        part = slice(at, at + TILE)
        yield part, ids[part], labels[part], strassen(a[part], b), *known


def _first_of_rows(scores: np.ndarray, allowed: np.ndarray, count: int):
    """(rows, columns) of each row's ``count`` greatest allowed scores; the smaller column first of equals."""
    found = []
    masked = np.where(allowed, scores, _NONE)
    left = allowed.sum(axis=1)
    every = np.arange(len(scores))
    for i in range(count):
        rows = every[left > i]
        if not len(rows):
            break
        best = masked.argmax(axis=1)[rows]
        # Scores of the least value of all are told from what is masked by the place alone.
        low = masked[rows, best] == _NONE
        if low.any():
            best[low] = allowed[rows[low]].argmax(axis=1)
        found.append((rows, best))
        masked[rows, best] = _NONE
        allowed[rows, best] = False
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _batch(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.Table:
    arrays = [pa.array(np.concatenate([np.empty(0, np.int64), *parts]), pa.int64()) for parts in columns]
    return pa.Table.from_arrays(arrays, schema=schema)


_POSITIVE = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")])
_NEGATIVE = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def _positives(count: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(anchors) and len(candidates):
            for _, ids, labels, scores, other, other_labels in _tiles(anchors, candidates):
                allowed = (labels[:, None] == other_labels) & (ids[:, None] != other)
                rows, columns = _first_of_rows(scores, allowed, count)
                for part, values in zip(out, (ids[rows], other[columns], scores[rows, columns])):
                    part.append(values)
        return _batch(_POSITIVE, out)

    return cell


def _negatives(count: int, low: int, high: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if not (len(anchors) and len(candidates)):
            return _batch(_NEGATIVE, out)
        width = max(len(p) for p in anchors.column("positives").to_pylist())
        positive = _matrix(anchors, "positives", width)
        score = _matrix(anchors, "positive_scores", width)
        held = np.diff(anchors.column("positives").combine_chunks().offsets.to_numpy())
        # Python's whole numbers: percentages of scores can leave 64 bits.
        bounds = [[(-(-low * int(s) // 100), high * int(s) // 100) for s in row] for row in score]
        limit = np.array(bounds, object).reshape(len(score), width, 2).clip(_NONE, -(_NONE + 1)).astype(np.int64)
        for part, ids, labels, scores, other, other_labels in _tiles(anchors, candidates):
            places = np.arange(width) < held[part][:, None]
            floor = np.where(places, limit[part, :, 0], -(_NONE + 1)).min(axis=1)
            ceiling = np.where(places, limit[part, :, 1], _NONE).max(axis=1)
            near = (scores >= floor[:, None]) & (scores <= ceiling[:, None]) & (labels[:, None] != other_labels)
            rows, columns = np.nonzero(near)
            found = scores[rows, columns]
            # Stable: equal scores stay in the order of ids. ~s falls where s rises and never overflows.
            order = np.argsort(~found, kind="stable")
            order = order[np.argsort(rows[order], kind="stable")]
            rows, columns, found = rows[order], columns[order], found[order]
            for j in range(width):
                fits = places[rows, j] & (found >= limit[part, j, 0][rows]) & (found <= limit[part, j, 1][rows])
                r, c, s = rows[fits], columns[fits], found[fits]
                begins = np.searchsorted(r, np.arange(len(ids)))
                first = np.arange(len(r)) - begins[r] < count
                r, c, s = r[first], c[first], s[first]
                values = ids[r], positive[part][r, j], score[part][r, j], other[c], s
                for column, v in zip(out, values):
                    column.append(v)
        return _batch(_NEGATIVE, out)

    return cell


def _cells(anchors: DataFrame, candidates: DataFrame, panels: int, slices: int, cell, schema: pa.Schema) -> DataFrame:
    """``cell`` applied to every panel of anchors and slice of candidates."""
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = anchors.select("*", every(slices, "slice")).groupBy("panel", "slice")
    right = candidates.select("*", every(panels, "panel")).groupBy("panel", "slice")
    fields = T.StructType([T.StructField(n, T.LongType()) for n in schema.names])
    return left.cogroup(right).applyInArrow(cell, fields)


def _ranked(found: DataFrame, group: list[str], score: str, other: str, count: int) -> DataFrame:
    """Merged heaps: the first ``count`` rows of each group with their rank."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the bigint column ``id``. For each anchor and each
    of its first ``positives`` other rows of the same label come the first ``negatives``
    rows of another label with ``low`` % to ``high`` % of the positive's score.
    """
    small_batches(rows.sparkSession, 4096, 8)
    stored = keep(participants(rows, vec_id, vector, label), "participants")
    sizes = stored.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    panels, slices = math.ceil(sizes["anchors"] / PANEL) or 1, math.ceil(sizes["rows"] / SLICE) or 1
    dealt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    candidates = stored.withColumn("slice", dealt(1, slices))
    anchors = keep(stored.where(is_anchor).withColumn("panel", dealt(2, panels)), "anchors")

    near = _cells(anchors, candidates, panels, slices, _positives(positives), _POSITIVE)
    first = keep(_ranked(near, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    heaps = first.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("heap")
    )
    known = anchors.join(heaps, "id").select(
        "id", "label", "vector", "panel",
        F.col("heap.positive_id").alias("positives"), F.col("heap.positive_score").alias("positive_scores"),
    )
    hard = keep(_cells(known, candidates, panels, slices, _negatives(negatives, low, high), _NEGATIVE), "negatives")
    out = _ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
