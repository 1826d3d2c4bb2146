"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, maybe_broadcast, staged


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and label (smallest id of its component) of every node of an edge.

    The graph is contracted.  In each round every node points to the least node
    among its neighbours and itself, by id in even rounds (a star around its
    smallest id is gone in one) and by a salted hash in odd ones (which breaks
    long paths, whatever their ids).  Pointers fall, so they form trees; pointer
    jumping brings nodes up to eight steps nearer to their root, and edges go on
    between what their ends point to.  Edges get fewer with every round and no
    round reads the full list again.  Rounds end when no edge is left; then the
    rounds' pointers are followed backwards, and each tree takes its smallest id.
    Aggregates are summed up before each shuffle; pointers are broadcast where
    the nodes are counted to be few.
    """
    now = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    now = staged(now.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cc-edges")
    rounds = []
    while now.head(1):
        order = (lambda c: F.struct(F.col(c).alias("o"), F.col(c).alias("id"))) if len(rounds) % 2 == 0 else \
            (lambda c, r=len(rounds): F.struct(F.xxhash64(F.lit(r), c).alias("o"), F.col(c).alias("id")))
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = staged(both.groupBy("x").agg(F.min(order("y")).alias("best"))
                    .select("x", F.least("best", order("x"))["id"].alias("up")), "cc-up")
        nodes = up.count()
        jumped = up
        for _ in range(3):
            jumped = jumped.join(maybe_broadcast(jumped.select(F.col("x").alias("up"), F.col("up").alias("far")), nodes), "up").select("x", F.col("far").alias("up"))
        jumped = staged(jumped, "cc-jumped")
        drop_staged(up)
        side = lambda c: maybe_broadcast(jumped.select(F.col("x").alias(c), F.col("up").alias(f"{c}_up")), nodes)
        new = (now.join(side("x"), "x").join(side("y"), "y").where("x_up <> y_up")
               .select(F.least("x_up", "y_up").alias("x"), F.greatest("x_up", "y_up").alias("y")).distinct())
        new = staged(new, "cc-edges")
        drop_staged(now)
        now = new
        rounds.append((jumped, nodes))
    if not rounds:
        return now.select(F.col("x").alias("id"), F.col("y").alias("label"))
    roots, size = rounds[-1]
    for earlier, nodes in reversed(rounds[:-1]):
        later = maybe_broadcast(roots.select(F.col("x").alias("up"), F.col("up").alias("root")), size)
        found = staged(earlier.join(later, "up", "left").select("x", F.coalesce("root", "up").alias("up")), "cc-roots")
        drop_staged(earlier)
        drop_staged(roots)
        roots, size = found, nodes
    least = roots.groupBy("up").agg(F.min("x").alias("label"))
    return roots.join(least, "up").select(F.col("x").alias("id"), "label")
