"""Shortest-path scores: closeness, harmonic and betweenness centrality.

These need the whole adjacency beside every source.  As in the usual practice
they run on a graph of a bounded number of nodes - the whole graph up to
``expensive_max_nodes``, beyond that the subgraph of the top ``expensive_top_n``
by PageRank - and of a bounded number of edges, so what is broadcast is at most
240 MB; more edges raise.  Sources are spread over all
tasks, partial scores are merged by aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.graph.build import induced, nodes

CONFIG = GraphConfig()


def bounded(edges: DataFrame, ranks: DataFrame, cfg: GraphConfig = CONFIG) -> DataFrame:
    """``edges``, or those among the nodes of highest rank where the graph is too large."""
    if nodes(edges).count() <= cfg.expensive_max_nodes:
        return edges
    return induced(edges, ranks.orderBy(F.desc("rank"), "id").limit(cfg.expensive_top_n))


def _adjacency(edges: DataFrame, cfg: GraphConfig = CONFIG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, targets) of the bounded graph in compressed rows."""
    pairs = edges.select("src", "dst").distinct()
    if (n := pairs.count()) > cfg.expensive_max_edges:
        raise ValueError(f"{n} edges are more than the {cfg.expensive_max_edges} that path scores take")
    e = pairs.toPandas()
    ids = np.unique(np.r_[e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)])
    s, t = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
    order = np.argsort(s, kind="stable")
    return ids, np.r_[0, np.cumsum(np.bincount(s, minlength=len(ids)))], t[order]


def _levels(offsets: np.ndarray, targets: np.ndarray, source: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Breadth-first levels: (frontier, edge starts repeated, edge ends) per step; ends include nodes already seen."""
    front = np.array([source])
    seen = np.zeros(len(offsets) - 1, bool)
    seen[source] = True
    while len(front):
        n = offsets[front + 1] - offsets[front]
        at = np.repeat(offsets[front] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        ends = targets[at]
        yield front, np.repeat(front, n), ends
        front = np.unique(ends[~seen[ends]])
        seen[front] = True


def distances(edges: DataFrame) -> DataFrame:
    """(id, closeness, harmonic) over incoming shortest paths, unweighted.

    closeness = (r / (n - 1)) * (r / sum of distances) with r reaching nodes of
    n; harmonic = sum of 1 / distance; 0 for a node that none reaches.
    """
    spark = edges.sparkSession
    ids, offsets, targets = _adjacency(edges)
    if not len(ids):
        return nodes(edges).select("id", F.lit(0.0).alias("closeness"), F.lit(0.0).alias("harmonic"))
    shared = spark.sparkContext.broadcast((offsets, targets))
    sources = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(ids)), "id": ids})).repartition(spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, targets = shared.value
        n = len(offsets) - 1
        reach, total, inverse = np.zeros(n), np.zeros(n), np.zeros(n)
        for batch in batches:
            for s in batch["at"]:
                for depth, (front, _, _) in enumerate(_levels(offsets, targets, s)):
                    if depth:
                        reach[front] += 1
                        total[front] += depth
                        inverse[front] += 1 / depth
        yield pd.DataFrame({"at": np.arange(n), "r": reach, "d": total, "h": inverse})

    part = sources.mapInPandas(run, "at long, r double, d double, h double").groupBy("at").agg(F.sum("r").alias("r"), F.sum("d").alias("d"), F.sum("h").alias("h"))
    n = len(ids)
    close = F.when((F.col("d") > 0) & F.lit(n > 1), (F.col("r") / F.lit(max(n - 1, 1))) * (F.col("r") / F.col("d"))).otherwise(0.0)
    return sources.join(part, "at").select("id", close.alias("closeness"), F.col("h").alias("harmonic"))


def betweenness(edges: DataFrame, cfg: GraphConfig = CONFIG) -> DataFrame:
    """(id, score): Brandes betweenness, unweighted and normalised; with more nodes than ``betweenness_sample``, from that many sources, by hash."""
    spark = edges.sparkSession
    ids, offsets, targets = _adjacency(edges, cfg)
    n = len(ids)
    if n < 3:
        return nodes(edges).select("id", F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((offsets, targets))
    everyone = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "id": ids}))
    k = min(n, cfg.betweenness_sample)
    sources = everyone.orderBy(F.md5(F.col("id").cast("string"))).limit(k).repartition(spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, targets = shared.value
        n = len(offsets) - 1
        total = np.zeros(n)
        for batch in batches:
            for s in batch["at"]:
                depth, paths = np.full(n, -1), np.zeros(n)
                depth[s], paths[s] = 0, 1
                steps = []
                for level, (_, a, b) in enumerate(_levels(offsets, targets, s)):
                    new = depth[b] < 0
                    depth[b[new]] = level + 1
                    on = depth[b] == level + 1
                    np.add.at(paths, b[on], paths[a[on]])
                    steps.append((a[on], b[on]))
                share = np.zeros(n)
                for a, b in reversed(steps):
                    np.add.at(share, a, paths[a] / paths[b] * (1 + share[b]))
                share[s] = 0
                total += share
        yield pd.DataFrame({"at": np.arange(n), "b": total})

    part = sources.mapInPandas(run, "at long, b double").groupBy("at").agg(F.sum("b").alias("b"))
    return everyone.join(part, "at").select("id", (F.col("b") * F.lit(n / k / ((n - 1) * (n - 2)))).alias("score"))
