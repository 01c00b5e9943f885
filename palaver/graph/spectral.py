"""Iterative scores: PageRank (whole graph or per period), HITS, eigenvector, Katz; all run until they no longer change.

A graph of more than ``one_task`` edges is iterated as DataFrames: a step is one
join of the edges with the state and one aggregation by target, merged map-side,
so a node with any number of edges is safe.  Edges are written once and the
state after every step, the table before it is deleted.  Periods are columns of
the state, never a loop.  A smaller graph runs its many short steps in one task
on arrays, by the same rule.

Scores settle when the largest change of a node in one step is below the
tolerance; a run that does not within its steps raises :class:`NotSettled`
instead of returning what it has.  ``log`` takes one note per run: method, steps
and last change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.graph.build import nodes
from palaver.sources.materialize import free, materialize

CUT = 4  # steps between two tests for convergence
CONFIG = GraphConfig()


class NotSettled(RuntimeError):
    """The scores still change after the allowed steps."""


def _note(log: list | None, method: str, steps: int, change: float, settled: bool) -> None:
    if log is not None:
        log.append({"method": method, "steps": steps, "change": change})
    if not settled:
        raise NotSettled(f"{method} still changes by {change:.3g} after {steps} steps")


def _in_one_task(edges: DataFrame, solve: Callable, values: Sequence[str], method: str, log: list | None, by: Sequence[str] = ()) -> DataFrame:
    """``solve(group, src, dst, weight, n)`` -> (columns, steps, change, settled), on arrays of a bounded graph."""
    kinds = {c: edges.schema[c].dataType.simpleString() for c in by}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        ends = pd.concat([rows[[*by, "src"]].rename(columns={"src": "id"}), rows[[*by, "dst"]].rename(columns={"dst": "id"})])
        at = ends.groupby([*by, "id"], sort=True).ngroup().to_numpy()
        held = ends.drop_duplicates().sort_values([*by, "id"]).reset_index(drop=True)
        group = held.groupby(list(by)).ngroup().to_numpy() if by else np.zeros(len(held), np.int64)
        got, steps, change, settled = solve(group, at[: len(rows)], at[len(rows) :], rows["weight"].to_numpy(np.float64), len(held))
        yield held.assign(**got, _steps=steps, _change=change, _settled=settled)

    columns = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "id bigint", *(f"{v} double" for v in values)])
    out = materialize(edges.select(*by, "src", "dst", "weight").repartition(1).mapInPandas(run, columns + ", _steps int, _change double, _settled boolean"), method)
    first = out.select("_steps", "_change", "_settled").first()
    _note(log, method, first["_steps"], first["_change"], first["_settled"])
    return out.drop("_steps", "_change", "_settled")


def _power(x: tuple, step: Callable, most: int, tol: float) -> tuple[tuple, int, float, bool]:
    change = np.inf
    for i in range(1, most + 1):
        y = step(*x)
        change = max(float(np.abs(a - b).max()) for a, b in zip(x, y))
        x = y
        if change < tol:
            return x, i, change, True
    return x, most, change, False


def _top(x: np.ndarray) -> np.ndarray:
    return x / x.max() if x.max() > 0 else x


def _state_loop(state: DataFrame, step: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], float], most: int, tol: float, method: str, log: list | None, scale: Callable | None = None) -> DataFrame:
    """Written states until ``change`` of one that also holds the values before is below ``tol``."""
    for i in range(1, most + 1):
        after = materialize(step(state), method)
        free(state)
        state = after
        if i % CUT == 0 or i == most:
            moved = change(state)
            if moved < tol:
                _note(log, method, i, moved, True)
                return state
            if scale is not None:
                after = materialize(scale(state), method)
                free(state)
                state = after
    _note(log, method, most, moved, False)
    return state


def pagerank(edges: DataFrame, *, by: Sequence[str] = (), steps: int | None = None, cfg: GraphConfig = CONFIG, log: list | None = None) -> DataFrame:
    """(by..., id, rank) with edge weights; ranks sum to 1 per period.

    Nodes without outgoing edges spread their rank evenly.  Runs until the summed
    change is below nodes * tolerance in every period, or exactly ``steps`` steps.
    """
    if not edges.take(1):
        return nodes(edges, by).withColumn("rank", F.lit(0.0))
    by = list(by)
    alpha, tol, most = cfg.pagerank_alpha, cfg.pagerank_tol, steps or cfg.pagerank_max_iter
    if edges.count() <= cfg.one_task:

        def solve(group, src, dst, w, n):
            size = np.bincount(group)[group]
            out = np.bincount(src, w, n)
            p, sink = w / out[src], out == 0
            rank, settled, i = 1 / size, False, 0
            while i < most and not settled:
                lost = np.bincount(group, rank * sink)[group]
                new = alpha * (np.bincount(dst, rank[src] * p, n) + lost / size) + (1 - alpha) / size
                moved = np.bincount(group, np.abs(new - rank)) / np.bincount(group)
                rank, i, settled = new, i + 1, steps is None and bool((moved < tol).all())
            return {"rank": rank}, i, float(moved.max()), settled or steps is not None

        return _in_one_task(edges, solve, ["rank"], "pagerank", log, by)
    group = by or ["_g"]
    e = edges if by else edges.withColumn("_g", F.lit(0))
    out = e.groupBy(*group, "src").agg(F.sum("weight").alias("_out"))
    e = materialize(e.join(out, [*group, "src"]).select(*group, "src", "dst", (F.col("weight") / F.col("_out")).alias("p")), "edges")
    count = nodes(e, group).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))  # one row per period
    sink = e.select(*group, F.col("src").alias("id"), F.lit(False).alias("sink")).distinct()
    start = nodes(e, group).join(sink, [*group, "id"], "left").join(F.broadcast(count), group)
    start = start.select(*group, "id", "n", F.coalesce("sink", F.lit(True)).alias("sink"), (F.lit(1.0) / F.col("n")).alias("rank"))

    def step(state: DataFrame) -> DataFrame:
        flow = e.join(state.select(*group, F.col("id").alias("src"), "rank"), [*group, "src"]).groupBy(*group, F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        lost = state.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        nxt = state.drop("before").withColumnRenamed("rank", "before").join(flow, [*group, "id"], "left").join(F.broadcast(lost), group)  # one row per period
        rank = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("n")) + F.lit(1 - alpha) / F.col("n")
        return nxt.withColumn("rank", rank).select(*group, "id", "n", "sink", "rank", "before")

    def change(state: DataFrame) -> float:
        if steps is not None:
            return np.inf
        moved = state.groupBy(*group).agg((F.sum(F.abs(F.col("rank") - F.col("before"))) / F.first("n")).alias("m"))
        return moved.agg(F.max("m")).first()[0]

    try:
        state = _state_loop(materialize(start, "rank"), step, change, most, tol, "pagerank", log)
    except NotSettled:
        if steps is None:
            raise
        state = _state_loop(materialize(start, "rank"), step, lambda _: 0.0, most, tol, "pagerank", None)
    return state.select(*by, "id", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) by weight; 0 where there is no such edge."""
    ends = F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("weight").alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.col("weight").alias("o"))))
    return edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def _step(edges: DataFrame, state: DataFrame, x: str, *, forward: bool = True) -> DataFrame:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.join(state.select(F.col("id").alias(a), F.col(x).alias("_x")), a).groupBy(F.col(b).alias("id")).agg(F.sum(F.col("_x") * F.col("weight")).alias("_y"))


def _scaled(state: DataFrame, *columns: str) -> DataFrame:
    tops = state.agg(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
    held = state.withColumn("_t", tops)
    return held.withColumns({c: F.when(F.col("_t")[c] > 0, F.col(c) / F.col("_t")[c]).otherwise(F.col(c)) for c in columns}).drop("_t")


def _scaled_change(state: DataFrame, *columns: str) -> float:
    """The largest change of a value that is scaled to a maximum of 1; ``before_`` columns hold the values before."""
    names = [*columns, *(f"before_{c}" for c in columns)]
    x = _scaled(state.select(*names), *names)
    return x.agg(F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"before_{c}"))) for c in columns], F.lit(0.0))).first()[0]


def hits(edges: DataFrame, *, cfg: GraphConfig = CONFIG, log: list | None = None) -> DataFrame:
    """(id, authority, hub), each scaled to a maximum of 1 (min-max scaling later makes any positive scale equal)."""
    if edges.count() <= cfg.one_task:

        def solve(_, src, dst, w, n):
            def step(auth, hub):
                auth = _top(np.bincount(dst, hub[src] * w, n))
                return auth, _top(np.bincount(src, auth[dst] * w, n))

            (auth, hub), i, change, settled = _power((np.ones(n), np.ones(n)), step, cfg.hits_max_iter, cfg.hits_tol)
            return {"authority": auth, "hub": hub}, i, change, settled

        return _in_one_task(edges, solve, ["authority", "hub"], "hits", log)
    e = materialize(edges.select("src", "dst", "weight"), "edges")
    keep = ["before_authority", "before_hub"]

    def step(state: DataFrame) -> DataFrame:
        held = state.select("id", F.col("authority").alias(keep[0]), F.col("hub").alias(keep[1]))
        auth = held.join(_step(e, state, "hub"), "id", "left").select("id", *keep, F.coalesce("_y", F.lit(0.0)).alias("authority"))
        auth = materialize(auth, "hits")
        return auth.join(_step(e, auth, "authority", forward=False), "id", "left").select("id", *keep, "authority", F.coalesce("_y", F.lit(0.0)).alias("hub"))

    start = materialize(nodes(e).select("id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub")), "hits")
    state = _state_loop(start, step, lambda s: _scaled_change(s, "authority", "hub"), cfg.hits_max_iter, cfg.hits_tol, "hits", log, lambda s: _scaled(s, "authority", "hub"))
    return _scaled(state, "authority", "hub").select("id", "authority", "hub")


def eigenvector(edges: DataFrame, *, cfg: GraphConfig = CONFIG, log: list | None = None) -> DataFrame:
    """(id, score): left eigenvector by power iteration on (A + I), which cannot oscillate on near-bipartite graphs; maximum 1."""
    if edges.count() <= cfg.one_task:

        def solve(_, src, dst, w, n):
            (x,), i, change, settled = _power((np.ones(n),), lambda x: (_top(x + np.bincount(dst, x[src] * w, n)),), cfg.eigenvector_max_iter, cfg.eigenvector_tol)
            return {"score": x}, i, change, settled

        return _in_one_task(edges, solve, ["score"], "eigenvector", log)
    e = materialize(edges.select("src", "dst", "weight"), "edges")
    step = lambda s: s.select("id", F.col("score").alias("before_score")).join(_step(e, s, "score"), "id", "left").select("id", "before_score", (F.col("before_score") + F.coalesce("_y", F.lit(0.0))).alias("score"))
    start = materialize(nodes(e).select("id", F.lit(1.0).alias("score")), "eigenvector")
    state = _state_loop(start, step, lambda s: _scaled_change(s, "score"), cfg.eigenvector_max_iter, cfg.eigenvector_tol, "eigenvector", log, lambda s: _scaled(s, "score"))
    return _scaled(state, "score").select("id", "score")


def katz(edges: DataFrame, *, cfg: GraphConfig = CONFIG, tries: int = 5, log: list | None = None) -> DataFrame:
    """(id, score): x = alpha * A'x + beta.  If it does not settle, alpha is halved, ``tries`` times in all; then it raises."""
    e = edges if edges.count() <= cfg.one_task else materialize(edges.select("src", "dst", "weight"), "edges")
    for left in reversed(range(tries)):
        alpha = cfg.katz_alpha / 2 ** (tries - 1 - left)
        try:
            return _katz(e, alpha, cfg, log)
        except NotSettled:
            if not left:
                raise
    raise ValueError("tries must be at least 1")


def _katz(edges: DataFrame, alpha: float, cfg: GraphConfig, log: list | None) -> DataFrame:
    if edges.count() <= cfg.one_task:

        def solve(_, src, dst, w, n):
            with np.errstate(over="ignore", invalid="ignore"):  # a series that diverges
                (x,), i, change, settled = _power((np.zeros(n),), lambda x: (alpha * np.bincount(dst, x[src] * w, n) + cfg.katz_beta,), cfg.katz_max_iter, cfg.katz_tol)
            return {"score": x}, i, change, settled

        return _in_one_task(edges, solve, ["score"], "katz", log)
    new = F.lit(alpha) * F.coalesce("_y", F.lit(0.0)) + F.lit(cfg.katz_beta)
    step = lambda s: s.select("id", F.col("score").alias("before")).join(_step(edges, s, "score"), "id", "left").select("id", "before", new.alias("score"))
    start = materialize(nodes(edges).select("id", F.lit(0.0).alias("score")), "katz")
    change = lambda s: s.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0]
    return _state_loop(start, step, change, cfg.katz_max_iter, cfg.katz_tol, "katz", log).select("id", "score")
