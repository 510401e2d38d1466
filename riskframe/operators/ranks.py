"""Exact ranks, running counts and quantiles that never need one big task.

A plain window or ``percentile`` puts a whole class, feature or client into a
single task. The helpers here keep the exact result but bound the work of each
task:

* ``hash_rank`` numbers rows by md5 order with a two-level count: a small table
  of counts per hash prefix gives the offsets, and rows are numbered inside
  their prefix only.
* ``running_counts`` turns "rows below this value" into a sum over value ranges
  plus a sum inside one range; the ranges come from a quantile sketch.
* ``values_at`` finds order statistics by narrowing: it counts the values between
  cut points and goes on with the parts that hold a wanted position.
* ``exact_quantiles`` brackets the wanted order statistics of whole columns with a
  quantile sketch and looks only at the rows inside the bracket.

Every helper works in one way whatever the size of its input.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.expr import chunks, col, digest, nan_to_null
from riskframe.session import materialize

# Distinct values that one task puts in order.
CELL_LIMIT = 1_000_000
RANGE_ROWS = 1_000_000
# Rows of one group up to which its values are held as an array.
HOT_ROWS = 200_000
SKETCH_ACCURACY = 10_000
# Rank error of the sketch is at most 1/accuracy; the bracket is four times that.
BRACKET = 4.0 / SKETCH_ACCURACY
# Parts of one narrowing round, and slices of a group that is joined with its cut points.
PARTS = 32
SALTS = 32
# Labels whose tables are small enough to broadcast.
MAX_LABELS = 1_000


def bucket_count(counts: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """Value ranges for running counts over the rows of a stored table of counts."""
    return max(1, -(-counts.count() // range_rows))


# --------------------------------------------------------------------------
# Row numbers


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    strata: Sequence[str] = (),
    seed: int = 42,
    out: str = "hash_rank",
    digits: int = 4,
) -> DataFrame:
    """Number the rows of every stratum 1..n in the order of md5(key:seed).

    ``key`` must be unique; equal digests are ordered by the key itself. A row
    without a stratum gets no number.
    """
    order, prefix, base = "__digest", "__prefix", "__base"
    tagged = df.withColumn(order, digest([*[col(k) for k in key], seed])).withColumn(
        prefix, F.substring(F.col(order), 1, digits)
    )
    group = [*strata, prefix]
    before = Window.partitionBy(*[col(s) for s in strata]).orderBy(prefix).rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**digits rows per stratum.
    offsets = (
        tagged.groupBy(*[col(g) for g in group])
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *[col(s).alias(f"__s{i}") for i, s in enumerate(strata)],
            F.col(prefix).alias("__p"),
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base),
        )
    )
    inside = Window.partitionBy(*[col(g) for g in group]).orderBy(F.col(order), *[col(k) for k in key])
    numbered = tagged.withColumn("__row", F.row_number().over(inside))
    # Plain equality on the window's own keys, so the join needs no further shuffle of the rows.
    match = F.col(prefix) == F.col("__p")
    for i, s in enumerate(strata):
        match = (col(s) == F.col(f"__s{i}")) & match
    return (
        numbered.join(offsets, match, "left")
        .withColumn(out, (F.col("__row") + F.col(base)).cast("long"))
        .drop(order, prefix, base, "__row", "__p", *[f"__s{i}" for i in range(len(strata))])
    )


# --------------------------------------------------------------------------
# Running counts over values


def value_ranges(df: DataFrame, group: Sequence[str], value: str, buckets: int) -> DataFrame:
    """At most ``buckets - 1`` cut points per group, from a mergeable quantile sketch."""
    probs = [i / buckets for i in range(1, buckets)]
    return df.groupBy(*[col(g) for g in group]).agg(
        F.array_distinct(F.percentile_approx(col(value), probs, max(1000, 10 * buckets))).alias("__cuts")
    )


def range_of(value: Column, cuts: Column, buckets: int) -> Column:
    """Number of cut points below the value: first among every n-th one, then in between."""
    step = max(1, math.isqrt(buckets))
    coarse = F.filter(cuts, lambda c, i: i % step == step - 1)
    block = F.size(F.filter(coarse, lambda c: c < value))
    return block * step + F.size(F.filter(F.slice(cuts, block * step + 1, F.lit(step)), lambda c: c < value))


def running_counts(
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    measures: Sequence[str],
    buckets: int,
    next_value: str | None = None,
    few: bool = True,
) -> DataFrame:
    """Add ``<m>_below`` per measure: its sum over smaller values of the group.

    With ``next_value`` a column of that name holds the next larger value.

    ``counts`` has one row per (group, value). ``group`` is a label such as a
    feature name. The tables of cut points and offsets have at most
    ``groups x buckets`` rows; they are broadcast when the labels are ``few``
    (see ``few_labels``) and joined by shuffle otherwise.
    """
    rng = "__range"
    if buckets == 1:
        ranged = counts.withColumn(rng, F.lit(0))
    else:
        cuts = value_ranges(counts, group, value, buckets)
        ranged = _join_labels(counts, cuts, group, few).withColumn(
            rng, range_of(col(value), F.col("__cuts"), buckets)
        ).drop("__cuts")
    key = [*group, rng]
    ordered = Window.partitionBy(*[col(k) for k in key]).orderBy(col(value))
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    added = {f"{m}_below": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    if next_value:
        added[next_value] = F.lead(col(value)).over(ordered)
    result = ranged.withColumns(added)
    if buckets == 1:
        return result.drop(rng)
    by_range = Window.partitionBy(*[col(g) for g in group]).orderBy(rng)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*[col(k) for k in key])
        .agg(*[F.sum(m).alias(m) for m in measures], F.min(col(value)).alias("__first"))
        .select(
            *[col(k) for k in key],
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
            F.lead("__first").over(by_range).alias("__next_range"),
        )
    )
    joined = _join_labels(result, offsets, key, few)
    shifted = {f"{m}_below": F.col(f"{m}_below") + F.col(f"__o_{m}") for m in measures}
    if next_value:
        shifted[next_value] = F.coalesce(F.col(next_value), F.col("__next_range"))
    return joined.withColumns(shifted).drop(rng, "__next_range", *[f"__o_{m}" for m in measures])


def with_buckets(counts: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """The counts and their number of ranges; they are stored first when it has to be found out."""
    if buckets is not None:
        return counts, buckets
    counts = materialize(counts, "counts")
    return counts, bucket_count(counts)


def _join_labels(big: DataFrame, small: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    return big.join(F.broadcast(small) if few else small, list(keys), "left")


def few_labels(df: DataFrame, group: Sequence[str], limit: int = MAX_LABELS) -> bool:
    """Whether a table with one row per label is small enough to broadcast."""
    return df.select(*[col(g) for g in group]).distinct().limit(limit + 1).count() <= limit


def average_ranks(
    df: DataFrame, group: Sequence[str], value: str, buckets: int | None = None
) -> DataFrame:
    """(group, value, n, rank): average rank of every distinct value per group."""
    counts = df.groupBy(*[col(g) for g in group], col(value)).agg(F.count(F.lit(1)).alias("n"))
    counts, buckets = with_buckets(counts, buckets)
    return running_counts(counts, group, value, ["n"], buckets).withColumn(
        "rank", F.col("n_below") + (F.col("n") + 1) / 2
    )


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with one row per non-missing cell."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*[col(k) for k in keep], F.explode(cells).alias("__cell"))
        .select(*[col(k) for k in keep], F.col("__cell.feature"), F.col("__cell.value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def ranked_cells(df: DataFrame, key: str, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """(key, feature, value, n, n_below): every cell with its place among all rows.

    The places are stored, so the join back to the cells has plain shuffles on
    both sides and adaptive execution can split a frequent value.
    """
    cells = to_long(df, columns, [key])
    places = average_ranks(cells, ["feature"], "value", buckets).select("feature", "value", "n", "n_below")
    return cells.join(materialize(places, "places"), ["feature", "value"])


def label_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """(group..., n, q0, q1, ...): interpolated quantiles per label."""
    counts = (
        df.where(col(value).isNotNull())
        .groupBy(*[col(g) for g in group], col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counts, buckets = with_buckets(counts, buckets)
    few = few_labels(counts, group)
    placed = running_counts(counts, group, "__v", ["c"], buckets, few=few)
    sizes = placed.groupBy(*[col(g) for g in group]).agg(F.sum("c").alias("n"))  # one row per label
    placed = _join_labels(placed, sizes, group, few)

    def at(position: Column) -> Column:
        inside = (F.col("c_below") <= position) & (position < F.col("c_below") + F.col("c"))
        return F.max(F.when(inside, F.col("__v")))

    columns = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        columns += [at(F.floor(position)).alias(f"__lo{i}"), at(F.ceil(position)).alias(f"__hi{i}")]
    picked = placed.groupBy(*[col(g) for g in group]).agg(F.first("n").alias("n"), *columns)
    result = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        share = position - F.floor(position)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        result.append(F.when(share == 0, lo).otherwise(lo * (1 - share) + hi * share).alias(f"q{i}"))
    return picked.select(*[col(g) for g in group], "n", *result)


# --------------------------------------------------------------------------
# Order statistics


def values_at(counts: DataFrame, group: Sequence[str], wanted: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """(group..., pos, v): the value at each wanted position of each group, counted from 0.

    ``counts`` has one row (group..., v, c) per distinct value, ``wanted`` one
    row (group..., pos) per position. While a group, or what is left of it, has
    more than ``limit`` distinct values, its values between cut points are
    counted and only the parts with a wanted position stay. Joins with the few
    cut points and parts of a group are dealt over ``SALTS`` slices.
    """
    group = list(group)
    key = [*group, "__part"]
    live = counts.select(*[col(g) for g in group], "v", "c", F.lit(0).cast("long").alias("__part"))
    goals = wanted.select(
        *[col(g) for g in group], "pos", F.lit(0).cast("long").alias("__part"), F.lit(0).cast("long").alias("__base")
    )
    live, goals = materialize(live, "values"), materialize(goals, "goals")
    slices = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("__salt")
    while True:
        size = live.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if size is None or size <= limit:
            break
        live = live.withColumn("__salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        cuts = value_ranges(live, key, "v", PARTS).select("*", slices)
        dealt = live.join(cuts, [*key, "__salt"]).withColumn("__next", range_of(F.col("v"), F.col("__cuts"), PARTS)).drop("__cuts")
        sums = dealt.groupBy(*[col(k) for k in key], "__next").agg(F.sum("c").alias("__c"))
        before = Window.partitionBy(*[col(k) for k in key]).orderBy("__next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__below", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        place = F.col("pos") - F.col("__base")
        goals = materialize(
            goals.join(sums, key)
            .where((F.col("__below") <= place) & (place < F.col("__below") + F.col("__c")))
            .select(
                *[col(g) for g in group], "pos",
                (F.col("__part") * (PARTS + 1) + F.col("__next")).alias("__part"),
                (F.col("__base") + F.col("__below")).alias("__base"),
            ),
            "goals",
        )
        parts = goals.select(*[col(k) for k in key]).distinct().select("*", slices)
        dealt = dealt.withColumn("__part", F.col("__part") * (PARTS + 1) + F.col("__next")).drop("__next")
        live = materialize(dealt.join(parts, [*key, "__salt"], "left_semi").drop("__salt"), "values")
    upto = Window.partitionBy(*[col(k) for k in key]).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = live.withColumn("__upto", F.sum("c").over(upto))
    place = F.col("pos") - F.col("__base")
    return (
        placed.join(goals, key)
        .where((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("c")))
        .select(*[col(g) for g in group], "pos", "v")
    )


# --------------------------------------------------------------------------
# Quantiles of whole columns


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    cell_limit: int = CELL_LIMIT,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, missing values skipped.

    Three scans for up to 200 columns. ``cell_limit``: distinct values inside a
    bracket that one task puts in order.
    """
    result: dict[str, list[float | None]] = {}
    for part in chunks(list(columns), 200):
        result.update(_bracketed_quantiles(df, part, probs, cell_limit))
    return result


def _bracketed_quantiles(df, columns, probs, cell_limit, pad=BRACKET):
    """Quantiles by a sketch bracket and an exact count inside it."""
    ends = [max(0.0, p - pad) for p in probs] + [min(1.0, p + pad) for p in probs]
    row = df.agg(
        *[
            F.percentile_approx(col(c).cast("double"), [float(e) for e in ends], SKETCH_ACCURACY).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    result: dict[str, list] = {c: [None] * len(probs) for c in columns if not sizes[c]}
    sketch = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    wanted = [(c, j) for c in columns if sizes[c] for j in range(len(probs))]
    if not wanted:
        return result
    low = [-math.inf if probs[j] - pad <= 0 else sketch[c][j] for c, j in wanted]
    high = [math.inf if probs[j] + pad >= 1 else sketch[c][len(probs) + j] for c, j in wanted]
    below = df.agg(
        *[F.sum(F.when(col(c) < F.lit(low[i]), 1).otherwise(0)).alias(str(i)) for i, (c, j) in enumerate(wanted)]
    ).first()
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when((col(c) >= F.lit(low[i])) & (col(c) <= F.lit(high[i])), col(c).cast("double")).alias("v"),
            )
            for i, (c, j) in enumerate(wanted)
        ]
    )
    inside = (
        df.select(F.explode(F.filter(cells, lambda s: s["v"].isNotNull())).alias("s"))
        .groupBy("s.i", "s.v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    goals = []
    for i, (c, j) in enumerate(wanted):
        position = probs[j] * (sizes[c] - 1)
        goals += [(i, p - below[i]) for p in {math.floor(position), math.ceil(position)}]
    goals = df.sparkSession.createDataFrame(goals, "i int, pos long")
    # At most two rows per wanted quantile.
    found = {(r["i"], r["pos"]): r["v"] for r in values_at(inside, ["i"], goals, cell_limit).collect()}
    missed = []
    for i, (c, j) in enumerate(wanted):
        position = probs[j] * (sizes[c] - 1)
        lo, hi = found.get((i, math.floor(position) - below[i])), found.get((i, math.ceil(position) - below[i]))
        if lo is None or hi is None:
            missed.append(c)
            continue
        share = position - math.floor(position)
        result.setdefault(c, [None] * len(probs))[j] = lo if share == 0 else lo * (1 - share) + hi * share
    if missed:  # the sketch missed a bracket: widen it for these columns
        result.update(_bracketed_quantiles(df, list(dict.fromkeys(missed)), probs, cell_limit, pad * 5))
    return result


# --------------------------------------------------------------------------
# Quantiles per group


def hot_groups(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Groups with more than ``hot_rows`` rows, or None when there are none.

    The result has at most ``rows / hot_rows`` rows.
    """
    hot = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    hot = hot.select(col(key))
    return None if hot.isEmpty() else hot


def group_median(c: Column) -> Column:
    """Interpolated median as an aggregate, for groups of bounded size.

    A sorted array per group is faster than the value-count map of the built-in
    ``median`` when a pass has dozens of medians over small groups.
    """
    values = F.sort_array(F.collect_list(c.cast("double")))
    last = F.size(values) - 1
    middle = (F.get(values, F.floor(last / 2).cast("int")) + F.get(values, F.ceil(last / 2).cast("int"))) / 2
    return nan_to_null(middle)


def hot_group_medians(df: DataFrame, key: str, columns: Mapping[str, Column], limit: int = CELL_LIMIT) -> DataFrame:
    """(key, one column per entry) with exact medians of very large groups, NULL where ``group_median`` gives NULL."""
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(n).alias("name"), columns[n].cast("double").alias("v")) for n in names])
    counts = (
        df.select(col(key).alias("__k"), F.explode(cells).alias("s"))
        .select("__k", F.col("s.name").alias("name"), F.col("s.v").alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("__k", "name", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counts = materialize(counts, "group-values")
    sizes = counts.groupBy("__k", "name").agg(F.sum("c").alias("n"))
    middle = (F.col("n") - 1) / 2
    goals = sizes.select("__k", "name", F.explode(F.array_distinct(F.array(F.floor(middle), F.ceil(middle)))).alias("pos"))
    medians = values_at(counts, ["__k", "name"], goals, limit).groupBy("__k", "name").agg(nan_to_null(F.avg("v")).alias("m"))
    return medians.groupBy(F.col("__k").alias(key)).agg(
        *[F.max(F.when(F.col("name") == n, F.col("m"))).alias(n) for n in names]
    )
