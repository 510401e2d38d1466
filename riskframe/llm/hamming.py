"""Exact nearest binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments of about log2(number of codes) - 2 bits,
so that a segment value has some four codes and probing costs no more than
verifying. The index holds every code under each of its segments. A round lets the segment
radius grow by one: each open query probes all segment values at that distance
and verifies what it finds. After radius a on all m segments every code within
m * (a + 1) - 1 bits is known, as a farther code differs by more than a bits in
each segment. A query ends when its k-th verified distance is within that bound;
in its last round it probes only the segments that this distance still needs.

Equal codes are one entry with their k smallest ids, and a code found over
several segments counts at the first, so no candidates repeat.

Defined cases: null, empty and longer vectors than 64 have no code and are
neither queries nor found; missing and non-finite components are bits 0; repeated
rows of an id and code count once; equal distances are ordered by id; with fewer
than k codes all are returned; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.store import keep

BITS = 64
K = 10


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code): bit i is set where component i is positive."""
    positive = lambda v, i: F.when((v > 0) & (v < F.lit(float("inf"))), _bit(i)).otherwise(F.lit(0).cast("bigint"))
    code = F.aggregate(F.transform(embedding, positive), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    usable = F.col(vec_id).isNotNull() & F.size(embedding).between(1, BITS)
    return vectors.where(usable).select(F.col(vec_id).cast("bigint").alias("id"), code.alias("code"))


def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment, for n codes."""
    m = max(1, min(BITS // 2, round(BITS / max(1.0, math.log2(max(n, 2)) - 2))))
    cuts = [s * BITS // m for s in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(code: Column, low: Column, width: Column) -> Column:
    mask = F.when(width >= BITS, F.lit(-1).cast("bigint")).otherwise(_bit(width) - 1)
    return F.call_function("shiftrightunsigned", code, low.cast("int")).bitwiseAND(mask)


def _by_segment(rows: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """One row per segment, with ``seg``, ``low`` and ``width``."""
    parts = [F.struct(F.lit(s).alias("seg"), F.lit(a).alias("low"), F.lit(w).alias("width")) for s, (a, w) in enumerate(segments)]
    return rows.select("*", F.inline(F.array(*parts)))


def _probes(queries: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """All segment values at exactly ``radius`` bits from each query's own."""
    m = len(segments)
    out = _by_segment(queries, segments).where(m * radius + F.col("seg") <= F.col("limit")).where(F.col("width") >= radius)
    out = out.select("query_id", "query", "seg", "width", _value(F.col("query"), F.col("low"), F.col("width")).alias("value"), F.lit(-1).alias("high"))
    for step in range(radius):
        last = F.col("width") - (radius - step)
        out = out.where(F.col("high") + 1 <= last).select(
            "query_id", "query", "seg", "width", "value", F.explode(F.sequence(F.col("high") + 1, last)).alias("high")
        ).withColumn("value", F.col("value").bitwiseXOR(_bit(F.col("high"))))
    return out.select("query_id", "query", "seg", "value")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of ``codes`` for every row of ``queries``; both are (id, code).

    Returns query_id, rank (from 1), id, distance.
    """
    few = Window.partitionBy("code").orderBy("id")
    entries = codes.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k).drop("r")
    entries = keep(entries, "codes")
    segments = _segments(entries.count())
    m = len(segments)
    indexed = _by_segment(entries, segments)
    index = keep(indexed.select("seg", _value(F.col("code"), F.col("low"), F.col("width")).alias("value"), "code", "id"), "index")
    asked = queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    best = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    open_queries = keep(asked.withColumn("limit", F.lit(BITS)), "queries")
    found = None
    done = []
    for radius in range(max(w for _, w in segments) + 1):
        # The planner takes the probes for as few as the queries and would broadcast them.
        hits = _probes(open_queries, segments, radius).hint("merge").join(index, ["seg", "value"])
        differ = F.col("query").bitwiseXOR(F.col("code"))
        # New unless an earlier segment has this radius too, or a later one a smaller radius.
        new = F.lit(True)
        for s, (low, width) in enumerate(segments):
            mask = -1 if width >= BITS else ((1 << width) - 1) << low
            mask = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
            away = F.bit_count(differ.bitwiseAND(F.lit(mask).cast("bigint")))
            enough = F.when(F.col("seg") == s, True).when(F.col("seg") > s, away > radius).otherwise(away >= radius)
            new = new & enough
        hits = hits.where(new).select("query_id", "query", "id", F.bit_count(differ).cast("int").alias("distance"))
        if found is not None:
            hits = hits.unionByName(found.drop("rank").join(open_queries.select("query_id", "query"), ["query_id", "query"]))
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = keep(ranked, "found")
        covered = m * (radius + 1) - 1
        kth = found.where(F.col("rank") == k).select("query_id", "query", F.col("distance").alias("kth"))
        state = open_queries.drop("limit").join(kth, ["query_id", "query"], "left")
        still = keep(
            state.where(F.coalesce("kth", F.lit(BITS)) > covered).select("query_id", "query", F.coalesce("kth", F.lit(BITS)).alias("limit")),
            "queries",
        )
        ended = found.join(still.select("query_id", "query"), ["query_id", "query"], "left_anti")
        done.append(ended)
        open_queries = still
        if still.isEmpty():
            break
    else:
        done.append(found.join(open_queries.select("query_id", "query"), ["query_id", "query"]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "id", "distance")
