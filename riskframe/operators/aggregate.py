"""Grouped aggregates from a dictionary spec.

A spec maps a column to aggregate names; the output column is called
``<prefix><column>_<AGG>``. Category shares are averages of an equality test,
so one-hot columns are never built, and slices ("the same spec over the active
rows only") are conditional aggregates in the same pass, so no slice is
aggregated and joined back on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import col, is_numeric, nan_to_null
from riskframe.operators.encode import categories, dummy_columns
from riskframe.operators.ranks import HOT_ROWS, group_median, hot_group_medians, hot_groups

AGGREGATES = ("min", "max", "mean", "sum", "var", "median", "size", "nunique")


@dataclass
class Plan:
    """The aggregate columns of one grouped pass."""

    simple: dict[str, Column] = field(default_factory=dict)
    medians: dict[str, Column] = field(default_factory=dict)  # name -> value expression
    distinct: dict[str, tuple[Column, Column | None]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def add(self, name: str, how: str, value: Column, when: Column | None = None) -> None:
        if how not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {how}")
        self.order.append(name)
        v = value if when is None else F.when(when, value)
        if how == "median":
            self.medians[name] = v
        elif how == "nunique":
            self.distinct[name] = (v, when)
        elif how == "size":
            rows = F.count(F.lit(1)) if when is None else F.nullif(F.count(F.when(when, 1)), F.lit(0))
            self.simple[name] = rows
        elif how == "sum":
            # A group without any value sums to 0; a group without a slice row is missing.
            total = nan_to_null(F.coalesce(F.sum(v), F.lit(0)).cast("double"))
            self.simple[name] = total if when is None else F.when(F.count(F.when(when, 1)) > 0, total)
        elif how == "mean":
            self.simple[name] = nan_to_null(F.avg(v))
        elif how == "var":
            self.simple[name] = nan_to_null(F.var_samp(v))
        else:
            self.simple[name] = F.min(v) if how == "min" else F.max(v)


def distinct_count(v: Column, when: Column | None, exact_shuffle: bool) -> Column:
    n = F.count_distinct(v) if exact_shuffle else F.size(F.array_distinct(F.collect_set(v))).cast("long")
    return n if when is None else F.when(F.count(F.when(when, 1)) > 0, n)


def aggregate(
    df: DataFrame,
    key: str,
    spec: Mapping[str, Sequence[str]],
    prefix: str = "",
    shares: Sequence[str] | Mapping[str, Sequence[str]] = (),
    slices: Mapping[str, Column] | None = None,
    count_name: str | None = None,
    null_category: bool = True,
    more: Mapping[str, Sequence[str]] | None = None,
    hot_rows: int = HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """One row per key with all aggregates of ``spec``.

    ``shares``: string columns (or fitted categories) whose value shares are
    added under ``prefix``. ``slices``: output prefix -> row condition, the
    spec repeated over those rows. ``more``: further specs under ``prefix``
    that the slices do not repeat. ``count_name``: row count per key.
    ``sizes_from``: a cheaper frame with the same rows per key, for the check
    of group sizes.
    """
    plan = Plan()
    for name, hows in spec.items():
        for how in hows:
            plan.add(f"{prefix}{name}_{how.upper()}", how, col(name))
    cats = shares if isinstance(shares, Mapping) else (categories(df, shares) if shares else {})
    for name, indicator in dummy_columns(cats, null_category).items():
        plan.add(f"{prefix}{name}_MEAN", "mean", indicator)
    for name, hows in (more or {}).items():
        for how in hows:
            plan.add(f"{prefix}{name}_{how.upper()}", how, col(name))
    for slice_prefix, condition in (slices or {}).items():
        for name, hows in spec.items():
            for how in hows:
                plan.add(f"{slice_prefix}{name}_{how.upper()}", how, col(name), condition)
    if count_name:
        plan.add(count_name, "size", F.lit(1))
    return run_plan(df, key, plan, hot_rows, sizes_from)


def run_plan(
    df: DataFrame, key: str, plan: Plan, hot_rows: int = HOT_ROWS, sizes_from: DataFrame | None = None
) -> DataFrame:
    order = [col(key), *[col(n) for n in plan.order]]
    df = df.where(col(key).isNotNull())  # rows without a key belong to no group

    def grouped(frame: DataFrame, exact_shuffle: bool, medians: bool) -> DataFrame:
        columns = [c.alias(n) for n, c in plan.simple.items()]
        if medians:
            columns += [group_median(c).alias(n) for n, c in plan.medians.items()]
        columns += [distinct_count(v, w, exact_shuffle).alias(n) for n, (v, w) in plan.distinct.items()]
        if medians and plan.medians:
            # Medians keep all values, so partial aggregates would be larger than the
            # rows themselves. Shuffle the rows once; groups are of bounded size here.
            frame = frame.repartition(col(key))
        # A spec of medians alone leaves no column for the large groups' plain pass.
        return frame.groupBy(col(key)).agg(*columns) if columns else frame.select(col(key)).distinct()

    needs_values = bool(plan.medians or plan.distinct)
    hot = hot_groups(df if sizes_from is None else sizes_from, key, hot_rows) if needs_values else None
    if hot is None:
        return grouped(df, exact_shuffle=False, medians=True).select(*order)
    light = grouped(df.join(hot, key, "left_anti"), exact_shuffle=False, medians=True)
    hot_frame = df.join(hot, key, "left_semi")
    heavy = grouped(hot_frame, exact_shuffle=True, medians=False)
    if plan.medians:
        heavy = heavy.join(hot_group_medians(hot_frame, key, plan.medians), key, "left")
    return light.select(*order).unionByName(heavy.select(*order))


def aggregate_all(
    df: DataFrame,
    key: str,
    prefix: str,
    hows: Sequence[str] = ("min", "max", "mean", "sum", "var", "median"),
    count_name: str | None = None,
    null_category: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every aggregate of every column but the key; string columns as dummies."""
    plan = Plan()
    for f in df.schema.fields:
        if f.name != key and is_numeric(f.dataType):
            for how in hows:
                plan.add(f"{prefix}{f.name}_{how.upper()}", how, col(f.name))
    for name, indicator in dummy_columns(categories(df), null_category).items():
        for how in hows:
            plan.add(f"{prefix}{name}_{how.upper()}", how, indicator)
    if count_name:
        plan.add(count_name, "size", F.lit(1))
    return run_plan(df, key, plan, hot_rows)


def left_join_aggregate(fact: DataFrame, aggregated: DataFrame, key: str) -> DataFrame:
    """Fact rows with the columns of a table that is unique on ``key``."""
    return fact.join(aggregated, key, "left")


def star_join(main: DataFrame, children: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join tables that are unique on ``key``; one hash partitioning serves all."""
    for child in children:
        main = main.join(child, key, "left")
    return main
