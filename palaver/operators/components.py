"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation over the edges and keeps at most as many edges as
there are; a star of any size is merged by min() map-side, so no task gathers
the neighbours of a node.  Steps end when the edges no longer change, after
about log(n) rounds.  Every round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.sources.materialize import free, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst")
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every node of undirected ``edges(src, dst)``; component is the smallest node id.

    Loops and repeated edges change nothing; edges with a null end are ignored.
    Raises if ``max_rounds`` do not suffice, rather than return parts.
    """
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    now = materialize(known.where("src <> dst").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "components")
        free(now)
        now = after
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = known.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
