"""Connected components by contraction to local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import drop, keep


def _roots(live: DataFrame) -> DataFrame:
    """For every vertex the local minimum that it reaches over smallest neighbours."""
    both = live.select(F.col("a").alias("n"), F.col("b").alias("m")).union(live.select("b", "a"))
    parents = keep(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "parents")
    while True:
        above = parents.select(F.col("n").alias("p"), F.col("p").alias("q"))
        jumped = keep(parents.join(above, "p").select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "jumped")
        moved = not jumped.where("moved").isEmpty()
        drop(parents)
        parents = jumped.select("n", "p")
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge in ``edges`` (two integer columns).

    ``component`` is the smallest node of the component. Every round joins each
    vertex to the local minimum it reaches, then goes on with the minima alone,
    so at least half of the vertices with an edge disappear. Minima combine
    before the shuffle, and the joins have no aggregate on their key, so hubs
    are split like any skewed join. Null ends and loops are ignored.
    """
    u, v = edges.columns
    live = keep(
        edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct(),
        "edges",
    )
    labels = None
    while True:
        if live.isEmpty() and labels is not None:
            return labels.select("node", "component")
        roots = _roots(live)
        if labels is None:
            labels = roots.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            step = roots.select(F.col("n").alias("component"), F.col("p").alias("root"))
            older = labels
            labels = keep(
                labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
                "labels",
            )
            drop(older)
        ra = roots.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        rb = roots.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        older = live
        live = keep(
            live.join(ra, "a")
            .join(rb, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        drop(older)
