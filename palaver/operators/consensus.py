"""Consensus clustering of repeated labellings, per group."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.components import connected_components
from palaver.sources.materialize import materialize

MOST_SUBSETS = 256  # sets of agreeing runs that every item may be listed under
BLOCK = 1024  # items of equal labels in a block
CELL = 256  # blocks of a label in a cell
SIDE_BY_SIDE = 40  # circles of a cluster that is packed beside others
TILE = 16_384  # places tried at once


def labels(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group_id, run, idx, label) for every idx of 0 .. n-1: the last cluster (by position) that lists it, -1 if none.

    ``clusters(group_id, run, pos, members)``, ``sizes(group_id, n)``; indices out of range are ignored.
    """
    listed = clusters.select("group_id", "run", "pos", F.explode("members").alias("idx")).groupBy("group_id", "run", "idx").agg(F.max("pos").alias("label"))
    runs = clusters.select("group_id", "run").distinct().join(sizes, "group_id")
    every = runs.where("n > 0").select("group_id", "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("idx"))
    return every.join(listed.withColumn("idx", F.col("idx").cast("bigint")), ["group_id", "run", "idx"], "left").select("group_id", "run", "idx", F.coalesce("label", F.lit(-1)).alias("label"))


def co_votes(labelled: DataFrame) -> DataFrame:
    """(group_id, i, j, votes), i < j: in how many runs both have the same label; -1 never pairs.  Pairs arise only within a label of a run.

    Items of equal labels come in blocks.  Two blocks that share labels meet under
    each of them, and their pairs are made under the first, with all their votes:
    no pair is shuffled.  A label of many blocks is spread over cells.
    """
    sets = materialize(_label_sets(labelled), "label-sets")
    chunks = sets.groupBy("group_id", "v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k"))
    dealt = sets.join(chunks, ["group_id", "v"]).withColumn("chunk", F.pmod(F.xxhash64("idx"), "k"))
    blocks = materialize(dealt.groupBy("group_id", "v", "chunk").agg(F.collect_list("idx").alias("members"), F.min("idx").alias("block")), "blocks")
    under = blocks.withColumn("at", F.explode("v"))
    cells = under.groupBy("group_id", "at").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    under = under.join(cells, ["group_id", "at"]).withColumn("cell", F.pmod(F.xxhash64("block", F.lit(1)), "cells"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))
    side = lambda n, own, other: under.withColumn("other", every).select("group_id", "at", F.col("cell").alias(own), F.col("other").alias(other), F.col("block").alias(f"block{n}"), F.col("v").alias(f"v{n}"), F.col("members").alias(f"members{n}"))
    both = side("a", "ca", "cb").join(side("b", "cb", "ca"), ["group_id", "at", "ca", "cb"]).where("blocka <= blockb").withColumn("shared", F.array_intersect("va", "vb"))
    first = both.where(F.col("at") == F.array_min("shared")).withColumn("votes", F.size(F.array_distinct("shared.run")).cast("bigint"))
    pairs = first.select("group_id", "blocka", "blockb", "membersb", "votes", F.explode("membersa").alias("a")).select("group_id", "blocka", "blockb", "votes", "a", F.explode("membersb").alias("b"))
    return pairs.where("blocka < blockb OR a < b").select("group_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "votes")


def majority_clusters(votes: DataFrame, items: DataFrame, runs: int) -> DataFrame:
    """(group_id, idx, cluster): components of pairs that a majority (runs // 2 + 1) puts together; cluster is the smallest idx.

    ``items(group_id, idx)`` lists everything, so singletons are clusters too.
    """
    at = lambda c: F.concat_ws(":", "group_id", F.col(c).cast("string"))
    linked = votes.where(F.col("votes") >= runs // 2 + 1)
    # components need one number per node; a group and index make one by order
    ids = items.select("group_id", "idx").distinct().withColumn("node", F.xxhash64(at("idx")))
    edges = linked.select(F.xxhash64(at("i")).alias("src"), F.xxhash64(at("j")).alias("dst"))
    part = ids.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = part.groupBy("group_id", "component").agg(F.min("idx").alias("cluster"))
    return part.join(named, ["group_id", "component"]).select("group_id", "idx", "cluster")


def _label_sets(labelled: DataFrame) -> DataFrame:
    """(group_id, idx, v): the (run, label) pairs of every item that has a label, in order."""
    real = labelled.where("label >= 0 AND group_id IS NOT NULL AND run IS NOT NULL AND idx IS NOT NULL")
    return real.groupBy("group_id", "idx").agg(F.array_sort(F.collect_set(F.struct("run", "label"))).alias("v"))


def _run_subsets(v: Column, need: int) -> Column:
    """All sets of ``need`` pairs of ``v`` that are of as many runs."""
    grown = lambda done, x: F.concat(
        done, F.transform(F.filter(done, lambda s: (F.size(s) < need) & ~F.exists(s, lambda y: y["run"] == x["run"])), lambda s: F.concat(s, F.array(x)))
    )
    return F.filter(F.aggregate(v, F.array(F.slice(v, 1, 0)), grown), lambda s: F.size(s) == need)


def _majority_links(classes: DataFrame, runs: int, need: int) -> DataFrame:
    """(group_id, i, j): links that join the same classes as all pairs agreeing in ``need`` runs, of ``classes(group_id, idx, v)``.

    Classes under one set of ``need`` labels all agree, so each is linked to the
    first of them.  With very many such sets, pairs are compared instead.
    """
    if comb(runs, need) <= MOST_SUBSETS:
        under = classes.select("group_id", "idx", F.explode(_run_subsets(F.col("v"), need)).alias("s"))
        first = under.groupBy("group_id", "s").agg(F.min("idx").alias("i"))
        return under.join(first, ["group_id", "s"]).where("i < idx").select("group_id", "i", F.col("idx").alias("j"))
    side = lambda n: classes.select("group_id", F.explode("v").alias("at"), F.col("idx").alias(n), F.col("v").alias(f"v{n}"))
    both = side("i").join(side("j"), ["group_id", "at"]).where("i < j").withColumn("shared", F.array_intersect("vi", "vj"))
    return both.where((F.col("at") == F.array_min("shared")) & (F.size(F.array_distinct("shared.run")) >= need)).select("group_id", "i", "j")


def majority_of_labels(labelled: DataFrame, items: DataFrame, runs: int) -> DataFrame:
    """:func:`majority_clusters` of the votes of ``labelled(group_id, run, idx, label)``, without their pairs.

    Items of equal labels are one class, named by its smallest idx, and only
    classes are linked.
    """
    need = runs // 2 + 1
    sets = materialize(_label_sets(labelled).where(F.size(F.array_distinct("v.run")) >= need), "label-sets")  # others agree with nothing in so many runs
    classes = materialize(sets.groupBy("group_id", "v").agg(F.min("idx").alias("idx")), "classes")
    links = _majority_links(classes, runs, need)
    node = lambda c: F.struct("group_id", F.col(c).alias("idx"))
    joined = connected_components(links.select(node("i").alias("src"), node("j").alias("dst")))
    joined = joined.select(F.col("node.group_id").alias("group_id"), F.col("node.idx").alias("idx"), F.col("component.idx").alias("cluster"))
    named = classes.join(joined, ["group_id", "idx"], "left").select("group_id", "v", F.coalesce("cluster", "idx").alias("cluster"))
    found = sets.join(named, ["group_id", "v"]).select("group_id", "idx", "cluster")
    return items.select("group_id", "idx").distinct().join(found, ["group_id", "idx"], "left").select("group_id", "idx", F.coalesce("cluster", "idx").alias("cluster"))


def agreement(clusters: DataFrame, votes: DataFrame, runs: int) -> DataFrame:
    """(group_id, cluster, size, agreement): mean share of runs that put a pair of members together; 1.0 for one member."""
    of = lambda c, n: clusters.select("group_id", F.col("idx").alias(c), F.col("cluster").alias(n))
    inner = votes.join(of("i", "ci"), ["group_id", "i"]).join(of("j", "cj"), ["group_id", "j"]).where("ci = cj").groupBy("group_id", F.col("ci").alias("cluster")).agg(F.sum("votes").alias("v"))
    return _mean_share(clusters, inner, runs)


def agreement_of_labels(clusters: DataFrame, labelled: DataFrame, runs: int) -> DataFrame:
    """:func:`agreement` of the votes of ``labelled(group_id, run, idx, label)``, without their pairs.

    The pairs that a run puts together are counted from the sizes of its labels in
    the cluster; where items have several labels in one run, by inclusion and
    exclusion over the sets of labels they share.
    """
    sets = _label_sets(labelled).select("group_id", "idx", F.explode("v").alias("at")).groupBy("group_id", "idx", "at.run").agg(F.collect_set("at.label").alias("ls"))
    grown = lambda done, x: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(x))))
    ls = F.array_sort("ls")
    shared = sets.select("group_id", "idx", "run", F.explode(F.filter(F.aggregate(ls, F.array(F.slice(ls, 1, 0)), grown), lambda s: F.size(s) > 0)).alias("s"))
    n = shared.join(clusters, ["group_id", "idx"]).groupBy("group_id", "cluster", "run", "s").agg(F.count(F.lit(1)).alias("n"))
    inner = n.groupBy("group_id", "cluster").agg(F.sum(F.expr("n * (n - 1) div 2 * if(size(s) % 2 = 1, 1, -1)")).alias("v"))
    return _mean_share(clusters, inner, runs)


def _mean_share(clusters: DataFrame, inner: DataFrame, runs: int) -> DataFrame:
    size = clusters.groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    value = F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("v", F.lit(0)) / F.lit(runs) / F.nullif(pairs, F.lit(0.0)))
    return size.join(inner, ["group_id", "cluster"], "left").select("group_id", "cluster", "size", value.alias("agreement"))


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clustering into ``k`` clusters by Lance-Williams updates; labels follow the smallest member."""
    n = len(x)
    squares = (x**2).sum(1)
    d = np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - max(1, min(k, n))):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        other = alive.copy()
        other[[i, j]] = False
        s = size[other]
        new = ((size[i] + s) * d[i, other] + (size[j] + s) * d[j, other] - s * d[i, j]) / (size[i] + size[j] + s)
        d[i, other] = d[other, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def ward_companion(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(group_id, idx, companion): Ward labels of unit vectors, as many clusters as ``counts(group_id, k)``.

    ``items(group_id, idx, embedding)``.  A group here is the practices of one
    problem, tens to hundreds; each is clustered in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({"group_id": rows["group_id"], "idx": rows["idx"], "companion": ward_labels(x / np.where(norm == 0, 1, norm), int(rows["k"].iloc[0]))})

    kind = items.schema["group_id"].dataType.simpleString()
    return items.select("group_id", "idx", "embedding").join(counts.select("group_id", "k"), "group_id").groupBy("group_id").applyInPandas(run, f"group_id {kind}, idx bigint, companion bigint")


def _spots(xa, ya, da, xb, yb, db):
    """The places (x, y, reached) at ``da`` from one and ``db`` from another centre, on the one side and on the other."""
    gx, gy = xb - xa, yb - ya
    d = np.sqrt(gx * gx + gy * gy)
    along = (da**2 - db**2 + d**2) / (2 * d)
    up = np.sqrt(np.maximum(da**2 - along**2, 0))
    gx, gy = gx / d, gy / d
    bx, by = xa + gx * along, ya + gy * along
    gx, gy = gx * up, gy * up
    return np.concatenate([bx - gy, bx + gy], -1), np.concatenate([by + gx, by - gx], -1), np.concatenate([d <= da + db] * 2, -1)


def pack_circles(radii: np.ndarray) -> np.ndarray:
    """Centres (x, y) of circles that do not overlap, packed around the origin in the given order.

    Each circle is put at the place nearest the origin that touches two placed
    circles and overlaps none.  Of pairs, those stay listed that a circle still to
    come is large enough to touch.
    """
    n = len(radii)
    at = np.zeros((n, 2))
    if n > 1:
        at[1] = (radii[0] + radii[1], 0)
    widest = np.maximum.accumulate(radii[::-1])[::-1]  # of the circles from each on
    a, b = np.array([0]), np.array([1])
    for i in range(2, n):
        r = radii[i]
        x, y, found = _spots(*at[a].T, radii[a] + r, *at[b].T, radii[b] + r)
        code = np.concatenate([a * n + b, n * n + a * n + b])[found]
        x, y = x[found], y[found]
        order = np.lexsort((code, x * x + y * y))
        least = (radii[:i] + r - 1e-9) ** 2
        for k in range(0, len(order), 256):
            some = order[k : k + 256]
            far = (x[some, None] - at[None, :i, 0]) ** 2 + (y[some, None] - at[None, :i, 1]) ** 2
            free = np.flatnonzero((far >= least).all(1))
            if len(free):
                at[i] = x[some[free[0]]], y[some[free[0]]]
                break
        if i + 1 < n:
            near = np.flatnonzero(np.hypot(*(at[:i] - at[i]).T) <= (radii[:i] + r + 2 * widest[i + 1]) * (1 + 1e-12))
            a, b = np.concatenate([a, near]), np.concatenate([b, np.full(len(near), i)])
    return at


def _pack_side_by_side(radii: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`pack_circles` of each row of ``radii``, of which the first ``sizes`` count, longest rows first."""
    x, y = np.zeros_like(radii), np.zeros_like(radii)
    x[:, 1:2] = np.where(sizes[:, None] > 1, radii[:, :1] + radii[:, 1:2], 0)
    for i in range(2, radii.shape[1]):
        rows = int((sizes > i).sum())
        a, b = np.triu_indices(i, 1)
        step = max(1, TILE // (2 * len(a)))
        for at in range(0, rows, step):
            s = slice(at, min(rows, at + step))
            xs, ys, q, r = x[s, :i], y[s, :i], radii[s, :i], radii[s, i : i + 1]
            px, py, found = _spots(xs[:, a], ys[:, a], q[:, a] + r, xs[:, b], ys[:, b], q[:, b] + r)
            least = (q + r - 1e-9) ** 2
            for k in range(i):
                gx, gy = px - xs[:, k : k + 1], py - ys[:, k : k + 1]
                gx *= gx
                gy *= gy
                gx += gy
                found &= gx >= least[:, k : k + 1]
            best = np.where(found, px * px + py * py, np.inf).argmin(1)[:, None]
            x[s, i : i + 1], y[s, i : i + 1] = np.take_along_axis(px, best, 1), np.take_along_axis(py, best, 1)
    return x, y


def pack_each(radii: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`pack_circles` of each run of ``radii`` from one of ``starts`` to the next; short runs are packed side by side."""
    sizes = np.diff(np.append(starts, len(radii)))
    out = np.zeros((len(radii), 2))
    for k in np.flatnonzero(sizes > SIDE_BY_SIDE):
        out[starts[k] : starts[k] + sizes[k]] = pack_circles(radii[starts[k] : starts[k] + sizes[k]])
    short = np.flatnonzero(sizes <= SIDE_BY_SIDE)
    if len(short):
        short = short[np.argsort(-sizes[short], kind="stable")]
        there = np.arange(sizes[short[0]]) < sizes[short, None]
        at = np.where(there, starts[short, None] + np.arange(sizes[short[0]]), 0)
        x, y = _pack_side_by_side(radii[at], sizes[short])
        out[at[there]] = np.c_[x[there], y[there]]
    return out


def _layout(rows: pa.Table) -> pa.Table:
    """The circles of whole groups, whose rows are in order of group, place, cluster and idx."""
    n = len(rows)
    group = _changes(rows, ["group_id"])
    first = np.flatnonzero(_changes(rows, ["place", "cluster"]) | group)  # of each cluster
    of = np.cumsum(np.isin(np.arange(n), first)) - 1
    heads = np.flatnonzero(group[first])  # of each group, among the clusters
    weight = rows["weight"].cast(pa.float64()).fill_null(0).to_numpy()
    r = np.sqrt(np.maximum(np.nan_to_num(weight), 1e-6))
    at = pack_each(r, first)
    at -= (np.add.reduceat(at * (r**2)[:, None], first) / np.add.reduceat(r**2, first)[:, None])[of]
    hulls = np.maximum.reduceat(np.hypot(*at.T) + r, first)
    centres = pack_each(hulls, heads)
    whole = np.repeat(np.maximum.reduceat(np.hypot(*centres.T) + hulls, heads), np.diff(np.append(heads, len(first))))
    at = (at + centres[of]) / whole[of, None]
    centres, hulls, r = centres / whole[:, None], hulls / whole, r / whole[of]
    take = np.concatenate([first, np.arange(n)])
    level = np.repeat(np.array([1, 2], "int32"), [len(first), n])
    idx = pa.chunked_array([pa.nulls(len(first), pa.int64()), *rows["idx"].cast(pa.int64()).chunks])
    x, y = np.concatenate([centres, at]).T
    return pa.table({"group_id": rows["group_id"].take(take), "level": level, "cluster": rows["cluster"].take(take), "idx": idx, "x": x, "y": y, "r": np.concatenate([hulls, r])})


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs in ``columns`` from the one before; the first does."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for c in columns:
        code = rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= code[1:] != code[:-1]
    return out


def circle_layout(points: DataFrame) -> DataFrame:
    """(group_id, level, cluster, idx, x, y, r) of ``points(group_id, cluster, place, idx, weight)``: circles within circles in a unit circle.

    Level 1 holds one circle per cluster, in the order of ``place``, with a null
    idx; level 2 the points in theirs, in the order of idx.  The area of points is
    in proportion to weight; a null weight or one below 1e-6 counts as that.  A
    group is one document and is packed in one task, beside others of its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the group that may go on
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            last = int(np.flatnonzero(_changes(rows, ["group_id"]))[-1])
            if last or held and held[-1]["group_id"][-1].as_py() != rows["group_id"][0].as_py():
                goes = pa.concat_tables([*held, rows.slice(0, last)])
                if len(goes):
                    yield from _layout(goes).to_batches()
                held = []
            held.append(rows.slice(last))
        if held:
            yield from _layout(pa.concat_tables(held)).to_batches()

    g, c = (points.schema[x].dataType.simpleString() for x in ("group_id", "cluster"))
    order = [F.col(x).asc_nulls_last() for x in ("group_id", "place", "cluster", "idx")]
    rows = points.select("group_id", "cluster", "place", "idx", "weight").repartition("group_id").sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"group_id {g}, level int, cluster {c}, idx bigint, x double, y double, r double")
