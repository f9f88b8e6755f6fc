"""Connected components by contraction, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id with an edge in (a, b); component is the smallest id reachable.

    In each round a vertex points to the least of itself and its neighbours; pointers are followed to their roots, in
    steps that double; vertices give way to their roots, and edges are drawn anew between those, each once. A star or a
    chain of falling ids is gone after a round, and of vertices in any order a share stays that falls by a third or
    more. So all rounds together move about as many rows as the first ones. The rounds are then put together from the
    last to the first. Null ends and loops are ignored; an empty input gives no rows.
    """
    # With one end null, least and greatest are the other end, so the edge counts as a loop.
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    left = scratch.write(pairs.distinct(), f"{name}-edges-0")
    rounds: list[tuple[DataFrame, int]] = []
    k = 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("id", "near")
        roots = scratch.write(both.groupBy("id").agg(F.least("id", F.min("near")).alias("root")), f"{name}-roots-{k}-0")
        n, jump = roots.count(), 0
        while True:
            jump += 1
            near = sized_broadcast(roots, n, 16).toDF("root", "next")
            moved = roots.join(near, "root").select("id", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            moved = scratch.write(moved, f"{name}-roots-{k}-{jump}")
            scratch.drop(f"{name}-roots-{k}-{jump - 1}")
            roots = moved.select("id", "root")
            if moved.where("moved").isEmpty():
                break
        rounds.append((roots, n))
        small = sized_broadcast(roots, n, 16)
        ends = left.join(small.toDF("a", "root_a"), "a").join(small.toDF("b", "root_b"), "b")
        ends = ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b").distinct()
        left = scratch.write(ends, f"{name}-edges-{k + 1}")
        k += 1
    if not rounds:
        return left.toDF("id", "component")
    found = rounds[-1][0]
    for i in range(len(rounds) - 2, -1, -1):
        later = sized_broadcast(found, rounds[i + 1][1], 16).toDF("root", "later")
        found = scratch.write(rounds[i][0].join(later, "root", "left").select("id", F.coalesce("later", "root").alias("root")), f"{name}-found-{i}")
    return found.toDF("id", "component")
