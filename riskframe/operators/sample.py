"""Exact, reproducible splits, samples, folds and class balances.

Every choice follows the md5 order of the row key, so reruns, retries and
other partitionings give the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import INF, col, digest, unit_interval
from riskframe.operators.neighbors import MANY_COLUMNS, nearest_neighbors
from riskframe.operators.ranks import MAX_LABELS, hash_rank
from riskframe.session import materialize

RANK = "__hash_rank"


def class_sizes(df: DataFrame, target: str, limit: int = MAX_LABELS) -> dict:
    """Rows per class on the driver; a column with very many values is no class label."""
    rows = (
        df.where(col(target).isNotNull())
        .groupBy(col(target))
        .agg(F.count(F.lit(1)).alias("n"))
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"column {target!r} has more than {limit} classes")
    return {r[0]: r["n"] for r in rows}


def labelled_sizes(df: DataFrame, target: str) -> dict:
    """Class sizes of a frame whose rows all have a label; rows without one belong to no class and are refused."""
    sizes = class_sizes(df, target)
    if not df.where(col(target).isNull()).isEmpty():
        raise ValueError(f"rows without a value in {target!r} can't be dealt by class; leave them out first")
    return sizes


def _per_class(values: dict, target: str):
    """The class's entry as a column."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col(target)) if pairs else F.lit(None).cast("long")


def assign_split(
    df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Add 1 for test rows and 0 for train rows, in class proportion."""
    cuts = {c: math.floor(test_share * n + 0.5) for c, n in labelled_sizes(df, target).items()}
    ranked = hash_rank(df, [key], [target], seed, RANK)
    return ranked.withColumn(out, (F.col(RANK) <= _per_class(cuts, target)).cast("int")).drop(RANK)


def stratified_split(
    df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    marked = assign_split(df, key, target, test_share, seed, "__test")
    return (
        marked.where(F.col("__test") == 0).drop("__test"),
        marked.where(F.col("__test") == 1).drop("__test"),
    )


def stratified_sample(df: DataFrame, key: str, target: str, n: int = 500, seed: int = 42) -> DataFrame:
    """``n`` rows (all rows when there are fewer) in class proportion by largest remainder."""
    sizes = labelled_sizes(df, target)
    total = sum(sizes.values())
    wanted = min(n, total)
    ideal = {c: size * wanted / total for c, size in sizes.items()} if total else {}
    quotas = {c: math.floor(v) for c, v in ideal.items()}
    by_remainder = sorted(ideal, key=lambda c: (-(ideal[c] - quotas[c]), c))
    for c in by_remainder[: wanted - sum(quotas.values())]:
        quotas[c] += 1
    ranked = hash_rank(df, [key], [target], seed, RANK)
    return ranked.where(F.col(RANK) <= _per_class(quotas, target)).drop(RANK)


def stratified_folds(
    df: DataFrame, key: str, target: str, k: int = 3, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1 dealt in turn within each class."""
    labelled_sizes(df, target)
    return hash_rank(df, [key], [target], seed, RANK).withColumn(
        out, ((F.col(RANK) - 1) % k).cast("int")
    ).drop(RANK)


def sampling_ratio(share: float) -> float:
    """Minority / majority ratio that makes the minority ``share`` of all rows."""
    return INF if share == 1.0 else share / (1 - share)


def minority_class(sizes: dict[int, int]) -> int:
    """The smaller class; on equal sizes the larger label (the event)."""
    return min(sizes, key=lambda c: (sizes[c], -c))


def _kept_rows(minority_rows: int, majority: int, share: float) -> int:
    """Majority rows that leave the minority ``share`` of all rows."""
    wanted = int(minority_rows / sampling_ratio(share))
    if wanted > majority:
        raise ValueError("the requested ratio needs fewer minority rows than there are")
    return wanted


def _made_rows(minority_rows: int, majority: int, ratio: float) -> int:
    """Synthetic rows that lift minority / majority to ``ratio``."""
    wanted = int(ratio * majority) - minority_rows
    if wanted < 0:
        raise ValueError("the requested ratio needs fewer minority rows than there are")
    return wanted


def undersample(
    df: DataFrame, key: str, target: str, share: float, seed: int = 42, sizes: dict[int, int] | None = None, ranked: DataFrame | None = None
) -> DataFrame:
    """All minority rows and the majority rows with the lowest hash ranks.

    ``ranked``: the rows with their hash rank by class in the column RANK, to share it between calls.
    """
    sizes = class_sizes(df, target) if sizes is None else sizes
    minority = minority_class(sizes)
    wanted = _kept_rows(sizes[minority], sum(n for c, n in sizes.items() if c != minority), share)
    ranked = hash_rank(df, [key], [target], seed, RANK) if ranked is None else ranked
    return ranked.where((col(target) == minority) | (F.col(RANK) <= wanted)).drop(RANK)


def smote(
    df: DataFrame,
    key: str,
    target: str,
    features: list[str],
    ratio: float,
    k: int = 5,
    seed: int = 42,
    sizes: dict[int, int] | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Add synthetic minority rows until minority / majority reaches ``ratio``.

    Base rows are taken in turn by hash rank. Each synthetic row lies on the
    segment from its base to one of the base's ``k`` nearest minority rows.
    Synthetic rows have a NULL key and only the columns ``key, target, features``.
    ``near``: neighbours from ``minority_neighbors``, to share them between calls.
    """
    sizes = class_sizes(df, target) if sizes is None else sizes
    minority = minority_class(sizes)
    majority = sum(n for c, n in sizes.items() if c != minority)
    wanted = _made_rows(sizes[minority], majority, ratio)
    plain = df.select(col(key), col(target), *[col(f).cast("double").alias(f) for f in features])
    if wanted == 0:
        return plain
    return plain.unionByName(
        synthetic_rows(
            plain.where(col(target) == minority), key, target, features, wanted, sizes[minority], minority, k, seed,
            near=near,
        )
    )


def minority_neighbors(
    minority: DataFrame, key: str, features: list[str], k: int = 5, approximate: bool | None = None
) -> DataFrame:
    """(base, pick, neighbor, vec, neighbor_vec): the k nearest rows of every row.

    ``approximate``: by a refined graph; unless said, from ten features on (see ``neighbors``).
    """
    if approximate is None:
        approximate = len(features) >= MANY_COLUMNS
    point = F.array(*[col(f).cast("double") for f in features])
    points = minority.select(col(key).alias("id"), point.alias("vec"))
    return nearest_neighbors(points, k, approximate=approximate).select(
        F.col("id").alias("base"), F.col("rank").alias("pick"), "neighbor", "vec", "neighbor_vec"
    )


def synthetic_rows(
    minority: DataFrame,
    key: str,
    target: str,
    features: list[str],
    wanted: int,
    available: int,
    label: int = 1,
    k: int = 5,
    seed: int = 42,
    keep_origin: bool = False,
    near: DataFrame | None = None,
    number: str | None = None,
) -> DataFrame:
    """``wanted`` interpolated rows of the minority frame.

    ``number``: a column of that name counts them from 1; fewer wanted rows are the ones with the first numbers.
    """
    k_used = min(k, available - 1)
    if k_used < 1:
        raise ValueError("synthetic rows need at least two minority rows")
    # Base rows in use: all of them, or the first ``wanted`` by rank.
    rank = hash_rank(minority.select(col(key)), [key], [], seed, RANK)
    turns = F.lit(wanted // available) + (F.col(RANK) <= F.lit(wanted % available)).cast("int")
    bases = rank.withColumn("__turns", turns.cast("int")).where(F.col("__turns") > 0)
    emitted = bases.select(
        col(key).alias("base"), RANK, F.explode(F.sequence(F.lit(0), F.col("__turns") - 1)).alias("turn")
    ).withColumns(
        {
            "pick": (F.floor(unit_interval(digest([F.col("base"), F.col("turn"), seed, "n"])) * k_used) + 1).cast("int"),
            "u": unit_interval(digest([F.col("base"), F.col("turn"), seed, "u"])),
        }
    )
    if near is None:
        near = minority_neighbors(minority, key, features, k_used)
    placed = emitted.join(near, ["base", "pick"])
    return placed.select(
        *([F.col("base"), F.col("turn"), F.col("neighbor")] if keep_origin else []),
        *([(F.col("turn") * F.lit(available).cast("long") + F.col(RANK)).alias(number)] if number else []),
        F.lit(None).cast(minority.schema[key].dataType).alias(key),
        F.lit(label).cast(minority.schema[target].dataType).alias(target),
        *[
            (F.col("vec")[i] + F.col("u") * (F.col("neighbor_vec")[i] - F.col("vec")[i])).alias(f)
            for i, f in enumerate(features)
        ],
    )


def hybrid_balance(
    df: DataFrame,
    key: str,
    target: str,
    features: list[str],
    share: float,
    k: int = 5,
    seed: int = 42,
    sizes: dict[int, int] | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """SMOTE to the midpoint of present and wanted share, then undersample to the wanted share.

    As in the plain oversampler, the midpoint is handed over as a ratio.
    """
    sizes = class_sizes(df, target) if sizes is None else sizes
    minority = minority_class(sizes)
    total = sum(sizes.values())
    midpoint = (sizes[minority] / total + share) / 2
    majority = total - sizes[minority]
    over = smote(df, key, target, features, midpoint, k, seed, sizes, near)
    wanted = _kept_rows(int(midpoint * majority), majority, share)
    # Only majority rows are thinned out, and those all carry a key.
    ranked = hash_rank(over.where(col(target) != minority), [key], [target], seed, RANK)
    kept = ranked.where(F.col(RANK) <= wanted).drop(RANK)
    return over.where(col(target) == minority).unionByName(kept)


def rebalance(
    df: DataFrame,
    key: str,
    target: str,
    features: list[str],
    technique: str,
    share: float,
    seed: int = 42,
    sizes: dict[int, int] | None = None,
    near: DataFrame | None = None,
) -> DataFrame | None:
    """Apply a technique by name; None when it does not apply to this balance."""
    sizes = class_sizes(df, target) if sizes is None else sizes
    initial = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if technique == "oversample":
        return None if share <= initial else smote(df, key, target, features, share, seed=seed, sizes=sizes, near=near)
    if technique == "undersample":
        return None if share == 1.0 else undersample(df, key, target, share, seed, sizes)
    if technique == "hybrid":
        if share <= initial:
            return None
        return hybrid_balance(df, key, target, features, share, seed=seed, sizes=sizes, near=near)
    raise ValueError(f"no balancing named {technique!r}")


def balance_cuts(sizes: dict[int, int], technique: str, share: float) -> tuple[int | None, int] | None:
    """What a technique takes: majority rows (None: all) and synthetic rows; None when it does not apply.

    The rows are those of ``rebalance``: the first by hash rank, and the first synthetic ones.
    """
    minority = minority_class(sizes)
    total = sum(sizes.values())
    majority = total - sizes[minority]
    initial = sizes.get(1, 0) / max(1, total)
    if technique not in ("oversample", "undersample", "hybrid"):
        raise ValueError(f"no balancing named {technique!r}")
    if technique == "undersample":
        return None if share == 1.0 else (_kept_rows(sizes[minority], majority, share), 0)
    if share <= initial:
        return None
    midpoint = (sizes[minority] / total + share) / 2
    made = _made_rows(sizes[minority], majority, share if technique == "oversample" else midpoint)
    if made and sizes[minority] < 2:
        raise ValueError("synthetic rows need at least two minority rows")
    return (None, made) if technique == "oversample" else (_kept_rows(int(midpoint * majority), majority, share), made)


def nested_balances(
    df: DataFrame,
    key: str,
    target: str,
    features: list[str],
    cuts: list[tuple[int | None, int]],
    sizes: dict[int, int],
    seed: int = 42,
    part: str = "part",
) -> tuple[DataFrame, list[list[int]]]:
    """The rows of all balances, each once: (``part``, target, features), and the parts that make up each balance.

    Every balance of ``balance_cuts`` takes a prefix of the ranked majority rows and a prefix of the synthetic rows, so
    the rows between two neighbouring cuts belong to the same balances.
    """
    minority = minority_class(sizes)
    ranked = materialize(hash_rank(df.select(col(key), col(target), *[col(f).cast("double").alias(f) for f in features]), [key], [target], seed, RANK), "ranked")
    majority = max((n for c, n in sizes.items() if c != minority), default=0)
    kept = sorted({majority if k is None else k for k, _ in cuts})
    made = sorted({m for _, m in cuts if m})

    def between(place, ends: list[int], first: int):
        return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < place)) + first

    # Part 0: the minority; then the majority by cuts, then the synthetic rows by cuts.
    old = F.when(col(target) == minority, 0).otherwise(between(F.col(RANK), kept, 1)).cast("int").alias(part)
    rows = ranked.where((col(target) == minority) | (F.col(RANK) <= kept[-1])).select(old, col(target), *[col(f) for f in features])
    if made:
        few = ranked.where(col(target) == minority).drop(RANK)
        # The same neighbours serve every balance.
        near = materialize(minority_neighbors(few, key, features, min(5, sizes[minority] - 1)), "neighbors")
        new = synthetic_rows(few, key, target, features, made[-1], sizes[minority], minority, seed=seed, near=near, number="__number")
        new = new.select(between(F.col("__number"), made, 1 + len(kept)).cast("int").alias(part), col(target), *[col(f) for f in features])
        rows = rows.unionByName(new)
    members = [
        [0, *range(1, 2 + kept.index(majority if k is None else k)), *(range(1 + len(kept), 2 + len(kept) + made.index(m)) if m else [])]
        for k, m in cuts
    ]
    return rows, members
