"""Communities: Louvain local moving and contraction as DataFrame rounds, and modularity in closed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.graph.build import undirected
from palaver.sources.materialize import free, materialize

CONFIG = GraphConfig()
MAX_ROUNDS = 400
MAX_LEVELS = 60
ONE_TASK = 500_000  # links that one task holds


def modularity(links: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity, communities) of ``partition(id, community)`` on undirected ``links(a, b, weight)``.

    Sum over communities of inner weight / m - resolution * (degree / 2m)^2; a
    loop counts twice in the degree.  Nodes without a community take no part.
    """
    of = lambda e: partition.select(F.col("id").alias(e), F.col("community").alias(f"c{e}"))
    known = links.join(of("a"), "a").join(of("b"), "b")
    ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("weight").alias("d"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0).alias("i")), F.struct(F.col("cb").alias("c"), F.col("weight").alias("d"), F.lit(0).cast("bigint").alias("i"))))
    per = known.select(ends.alias("x")).groupBy("x.c").agg(F.sum("x.d").alias("d"), F.sum("x.i").alias("i"))
    m2 = F.sum("d")  # twice the weight
    return per.agg(
        (2 * F.sum("i") / m2 - F.lit(resolution) * F.sum(F.col("d").cast("double") * F.col("d")) / (m2.cast("double") * m2)).alias("modularity"),
        F.count(F.lit(1)).alias("communities"),
    )


def _move(links: DataFrame, state: DataFrame, m2: float, resolution: float, turn: int) -> DataFrame:
    """One round in which nodes of one hash class move to the neighbouring community of the largest gain."""
    both = links.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(links.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    volume = state.groupBy("community").agg(F.sum("degree").alias("volume"))
    to = both.join(state.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.sum("weight").alias("w"))
    own = state.select("id", "community").join(to, ["id", "community"], "left_anti").withColumn("w", F.lit(0).cast("bigint"))
    options = to.unionByName(own).join(volume, "community").join(state.select("id", "degree", F.col("community").alias("now")), "id")
    rest = F.col("volume") - F.when(F.col("community") == F.col("now"), F.col("degree")).otherwise(0)
    gain = F.col("w") - F.lit(resolution / m2) * F.col("degree") * rest
    stay = F.max(F.when(F.col("community") == F.col("now"), F.col("gain")))
    best = options.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", (-F.col("community")).alias("c"))).alias("best"), stay.alias("stay"))
    gains = F.coalesce(F.col("best")["gain"] > F.col("stay") + 1e-9, F.lit(False))
    goes = gains & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
    return state.join(best, "id", "left").select("id", "degree", F.when(goes, -F.col("best")["c"]).otherwise(F.col("community")).alias("community"), gains.alias("gains"))


def _rounds(links: DataFrame, m2: float, resolution: float, level: int, max_rounds: int) -> DataFrame:
    """(id, community, ...) when no node gains any more, one written table a round."""
    # both ends of every edge, so a loop counts twice in its node's degree
    state = links.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("degree")).withColumn("community", F.col("id"))
    for turn in range(max_rounds):
        after = materialize(_move(links, state, m2, resolution, level * max_rounds + turn), "louvain")
        free(state)
        state = after
        if not state.where("gains").take(1):  # so none has moved in this round either
            return state
    raise RuntimeError(f"communities did not settle in {max_rounds} rounds of level {level}")


def _settle(links: DataFrame, m2: float, resolution: float, level: int, max_rounds: int) -> DataFrame:
    """(id, community) when no node gains any more: the rounds of :func:`_move`, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        ids, ends = np.unique(np.r_[rows["a"], rows["b"]], return_inverse=True)
        n, (a, b), w = len(ids), ends.reshape(2, -1), rows["weight"].to_numpy(np.float64)
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        apart = a != b
        src, dst, weight = np.r_[a[apart], b[apart]], np.r_[b[apart], a[apart]], np.r_[w[apart], w[apart]]
        now, me, rng = np.arange(n), np.arange(n), np.random.default_rng(level)
        for _ in range(max_rounds):
            volume = np.bincount(now, degree, n)
            options, at = np.unique(np.r_[src * n + now[dst], me * n + now], return_inverse=True)
            i, c = options // n, options % n
            own = c == now[i]
            gain = np.bincount(at, np.r_[weight, np.zeros(n)]) - resolution / m2 * degree[i] * (volume[c] - np.where(own, degree[i], 0))
            order = np.lexsort((c, -gain, i))
            best = order[np.r_[True, np.diff(i[order]) > 0]]
            gains = gain[best] > gain[own] + 1e-9  # both hold one option per node, in order
            if not gains.any():
                yield pd.DataFrame({"id": ids, "community": ids[now]})
                return
            now = np.where(gains & (rng.random(n) < 0.5), c[best], now)
        raise RuntimeError(f"communities did not settle in {max_rounds} rounds of level {level}")

    return links.select("a", "b", "weight").repartition(1).mapInPandas(run, "id bigint, community bigint")


def louvain(edges: DataFrame, *, max_rounds: int = MAX_ROUNDS, max_levels: int = MAX_LEVELS, one_task: int = ONE_TASK, cfg: GraphConfig = CONFIG) -> DataFrame:
    """(id, community) of every node of directed weighted ``edges``; the community is named by its smallest node.

    Moves are simultaneous, so in each round only one half of the nodes, by
    hash, may move.  A level ends when no node of either half gains by moving, and
    is kept only if modularity rises; the first that is not ends the run.  Raises
    if ``max_rounds`` or ``max_levels`` do not suffice, rather than stop early.
    A level of at most ``one_task`` links runs its many short rounds in one task.
    """
    links = materialize(undirected(edges), "links")
    whole = links
    known = materialize(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("community", F.col("id")), "community")
    score = modularity(whole, known, cfg.louvain_resolution).first()["modularity"]
    if score is None:
        return known
    for level in range(max_levels):
        m2 = float(links.agg(2 * F.sum("weight")).first()[0])
        if links.count() <= one_task:
            state = materialize(_settle(links, m2, cfg.louvain_resolution, level, max_rounds), "louvain")
        else:
            state = _rounds(links, m2, cfg.louvain_resolution, level, max_rounds)
        merged = known.join(state.select(F.col("id").alias("community"), F.col("community").alias("up")), "community").select("id", F.col("up").alias("community"))
        merged = materialize(merged, "community")
        new = modularity(whole, merged, cfg.louvain_resolution).first()["modularity"]
        if new <= score + 1e-9:
            break
        known, score = merged, new
        up = lambda e: state.select(F.col("id").alias(e), F.col("community").alias(f"c{e}"))
        links = materialize(links.join(up("a"), "a").join(up("b"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")), "links")
    else:
        raise RuntimeError(f"modularity still rises after {max_levels} levels")
    names = known.groupBy("community").agg(F.min("id").alias("name"))
    return known.join(names, "community").select("id", F.col("name").alias("community"))
