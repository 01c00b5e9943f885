"""Vector retrieval over arrays: unit vectors, cosine top-k, gate, reuse of groups, medoid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.config import RetrievalConfig

CONFIG = RetrievalConfig()


def unit(v: Column) -> Column:
    """L2-normalised array of doubles; a zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


BLOCK = 4096  # queries that one task holds
PART = 65_536  # rows of the corpus that a block of queries meets in one task


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float = 0.0, *, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(query_id, id, score, rank) with rank from 0: the ``k`` most similar of ``corpus(id, embedding)`` for each of ``queries(id, embedding)``.

    A stated query set is compared with every corpus row.  Up to ``block`` queries
    are broadcast; more are dealt into blocks, the corpus into parts, and each
    block meets each part in a task of its own, which keeps its own top k: only
    those are shuffled again.  With a threshold above 0 only scores of at least it
    count.  Ties go to the smaller id, whatever the batches.
    """
    out = "query_id bigint, id bigint, score double"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    sent = queries.select("id", "embedding").limit(block + 1).toPandas()  # one block and a row, never more
    if len(sent) <= block:
        q = queries.sparkSession.sparkContext.broadcast((sent["id"].to_numpy(), _matrix(sent["embedding"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for rows in batches:
                best = _better(best, *q.value, rows, k, threshold)
            if best is not None:
                yield best

        found = corpus.select("id", "embedding").mapInPandas(scan, out)
    else:
        blocks, parts = -(-queries.count() // block), max(1, -(-corpus.count() // part))
        number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = queries.select(number(blocks).alias("b"), every(parts).alias("p"), F.lit(0).alias("tag"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
        held = corpus.select(every(blocks).alias("b"), number(parts).alias("p"), F.lit(1).alias("tag"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
        met = asked.unionByName(held).withColumn("cell", F.col("b") * parts + F.col("p"))

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, mine, ready, best = None, [], None, None
            for whole in batches:
                for (c, tag), rows in whole.groupby(["cell", "tag"], sort=True):
                    if c != cell:
                        if best is not None:
                            yield best
                        cell, mine, ready, best = c, [], None, None
                    if tag == 0:
                        mine.append(rows)
                        continue
                    if ready is None and mine:
                        one = pd.concat(mine)
                        ready = one["id"].to_numpy(), _matrix(one["embedding"])
                    if ready is not None:
                        best = _better(best, *ready, rows, k, threshold)
            if best is not None:
                yield best

        cells = blocks * parts
        tasks = min(cells, 20_000)
        found = met.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "tag").select("cell", "tag", "id", "embedding").mapInPandas(meet, out)
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _better(best: pd.DataFrame | None, ids: np.ndarray, x: np.ndarray, rows: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame | None:
    """The k best so far of each query after some more ``rows``; all that tie at the k-th place are sorted."""
    if not len(ids) or not len(rows):
        return best
    s = _matrix(rows["embedding"]) @ x.T
    keep = min(k, len(rows))
    least = np.partition(s, len(rows) - keep, axis=0)[len(rows) - keep]
    if threshold > 0:
        least = np.maximum(least, threshold)
    at, of = np.nonzero(s >= least)
    got = pd.DataFrame({"query_id": ids[of], "id": rows["id"].to_numpy()[at], "score": s[at, of]})
    both = got if best is None else pd.concat([best, got])
    return both.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _matrix(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    x = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def gate_decision(equivalent: Column, confidence: Column, cfg: RetrievalConfig = CONFIG) -> Column:
    """equivalent with enough confidence, borderline without, else not_equivalent."""
    return F.when(equivalent & (confidence >= cfg.accept_confidence), "equivalent").when(equivalent, "borderline").otherwise("not_equivalent")


def token_gate(a: Column, b: Column) -> Column:
    """Deterministic stand-in for the equivalence judgement: Jaccard similarity of the two texts' word sets, 0 for two empty ones."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def best_overlap(new: DataFrame, existing: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """(new_id, group_id, jaccard): the known group whose members overlap most, if at least ``dedup_threshold``; the smaller id on ties.

    ``new(new_id, member)`` and ``existing(group_id, member)`` are sets; only groups that share a member are compared.
    """
    n, g = new.distinct(), existing.distinct()
    shared = n.join(g, "member").groupBy("new_id", "group_id").agg(F.count(F.lit(1)).alias("m"))
    sizes = shared.join(n.groupBy("new_id").agg(F.count(F.lit(1)).alias("a")), "new_id").join(g.groupBy("group_id").agg(F.count(F.lit(1)).alias("b")), "group_id")
    j = F.col("m") / (F.col("a") + F.col("b") - F.col("m"))
    w = Window.partitionBy("new_id").orderBy(F.desc("jaccard"), "group_id")
    return sizes.withColumn("jaccard", j).withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("jaccard") >= cfg.dedup_threshold)).select("new_id", "group_id", "jaccard")


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(group_id, medoid): the member with the largest summed cosine to all indexed members, the first on ties.

    The sum over members of v.u equals v.(sum of u), so one aggregation of
    vectors per group replaces all pairs.  With fewer than two indexed members:
    the one there is, else the first.  ``members(group_id, id, pos)``.
    """
    # indexed members hold unit vectors
    known = members.join(vectors.select("id", "embedding"), "id").select("group_id", "id", "pos", "embedding")
    kind = members.schema["group_id"].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One sum per group and task; put out early if there are many groups."""
        sums: dict = {}
        for rows in batches:
            x = _matrix(rows["embedding"])
            for g, at in rows.reset_index(drop=True).groupby("group_id").groups.items():
                part = x[at].sum(0)
                sums[g] = sums[g] + part if g in sums else part
            if len(sums) > 4096:
                yield pd.DataFrame({"group_id": list(sums), "total": [v.tobytes() for v in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({"group_id": list(sums), "total": [v.tobytes() for v in sums.values()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(t, np.float64) for t in rows["total"]], axis=0)
        return pd.DataFrame({"group_id": rows["group_id"].iloc[:1], "total": [total.tobytes()]})

    # as many partial sums of a group as tasks
    total = known.select("group_id", "embedding").mapInPandas(add, f"group_id {kind}, total binary").groupBy("group_id").applyInPandas(merge, f"group_id {kind}, total binary")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                t = np.frombuffer(b"".join(rows["total"]), np.float64).reshape(len(rows), -1)
                yield rows[["group_id", "id", "pos"]].assign(s=np.round(np.einsum("nd,nd->n", _matrix(rows["embedding"]), t), 9))

    pos = members.schema["pos"].dataType.simpleString()
    scored = known.join(total, "group_id").mapInPandas(score, f"group_id {kind}, id bigint, pos {pos}, s double")
    best = scored.groupBy("group_id").agg(F.max_by("id", F.struct("s", (-F.col("pos")).alias("p"))).alias("best"))
    first = members.groupBy("group_id").agg(F.min_by("id", "pos").alias("first"))
    return first.join(best, "group_id", "left").select("group_id", F.coalesce("best", "first").alias("medoid"))
