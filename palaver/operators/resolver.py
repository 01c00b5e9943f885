"""Free questions to groups: embed, search, judge, decide, reuse a known group or found one at the medoid, and keep all candidates.

All queries of a batch go through each step at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.config import RetrievalConfig
from palaver.functions.text import query_text
from palaver.operators.retrieval import best_overlap, cosine_topk, gate_decision, medoids, token_gate
from palaver.sources.materialize import materialize
from palaver.sources.writers import undone

CONFIG = RetrievalConfig()


def hashed_embedding(dim: int = 256):
    """A column function text -> array<float>: signed word hashes, of unit length; stands in for an embedding model.  Texts without words give zeros."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            v = np.zeros(dim, np.float32)
            for w in (text or "").lower().split():
                h = xxhash.xxh32_intdigest(w)
                v[h % dim] += 1 if h & 0x80000000 else -1
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed


def index_text(title: Column, body: Column) -> Column:
    """What is embedded of a question: its title, an empty line and its text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def extend_index(questions: DataFrame, path: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Embed the questions that the index at ``path`` lacks, append them, and return the whole index (id, embedding).

    ``questions(question_id, title, body_text)`` are first rows.  Appended files
    are complete when they appear, so a run that broke off goes on where it ended.
    """
    spark = questions.sparkSession
    todo = questions.select(F.col("question_id").alias("id"), "title", "body_text")
    try:
        todo = undone(todo, spark.read.parquet(path), ["id"])
    except Exception as e:  # no index yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    todo.select("id", embed(index_text(F.col("title"), F.col("body_text"))).alias("embedding")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Resolution:
    """``answers(query_id, group_id, reused)`` - no group where nothing was judged equivalent - and ``rows``, all candidates of the new groups."""

    answers: DataFrame
    rows: DataFrame


def resolve(queries: DataFrame, index: DataFrame, judge: Callable[[DataFrame], DataFrame], existing: DataFrame, cfg: RetrievalConfig = CONFIG) -> Resolution:
    """Groups of ``queries(query_id, embedding)`` over ``index(id, embedding)``.

    ``judge`` adds ``equivalent`` and ``confidence`` to (query_id, id, score, rank);
    ``existing(group_id, member)`` are the known groups before the batch.  A query
    whose members overlap a known group enough gets that group; otherwise its
    group is named after the medoid of its members.  Of several queries of a
    batch that found the same group the candidates of the last are kept.
    """
    hits = materialize(cosine_topk(queries.select(F.col("query_id").alias("id"), "embedding"), index, cfg.top_k, cfg.threshold), "hits")
    said = judge(hits).select("query_id", "id", "score", "rank", "equivalent", "confidence")
    judged = materialize(said.withColumn("gate_decision", gate_decision(F.coalesce("equivalent", F.lit(False)), F.coalesce("confidence", F.lit(0.0)), cfg)), "judged")
    members = judged.where("gate_decision = 'equivalent'")
    reuse = best_overlap(members.select(F.col("query_id").alias("new_id"), F.col("id").alias("member")), existing, cfg).select(F.col("new_id").alias("query_id"), "group_id")
    reuse = materialize(reuse, "reuse")
    fresh = members.join(reuse, "query_id", "left_anti")
    named = medoids(fresh.select(F.col("query_id").alias("group_id"), "id", F.col("rank").alias("pos")), index)
    new = materialize(named.select(F.col("group_id").alias("query_id"), F.concat(F.lit("q"), F.col("medoid").cast("string")).alias("group_id")), "new")
    found = reuse.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
    last = new.groupBy("group_id").agg(F.max("query_id").alias("query_id"))
    rows = judged.join(last, "query_id").select(
        "group_id", F.col("id").alias("question_id"), F.col("rank").alias("retrieval_rank"), F.col("score").alias("retrieval_score"), "gate_decision", F.col("confidence").alias("gate_confidence")
    )
    return Resolution(queries.select("query_id").join(found, "query_id", "left").select("query_id", "group_id", F.coalesce("reused", F.lit(False)).alias("reused")), rows)


class TextResolver:
    """Resolves texts over an index of questions by a judgement of texts; see :class:`palaver.contract.Resolver`."""

    def __init__(self, index: DataFrame, questions: DataFrame, existing: DataFrame, embed: Callable[[Column], Column] | None = None, cfg: RetrievalConfig = CONFIG) -> None:
        """``questions(question_id, title, body_text)`` give the texts that are judged by the words they share."""
        self.index, self.existing, self.cfg = index, existing, cfg
        self.embed = hashed_embedding() if embed is None else embed
        self.texts = questions.select(F.col("question_id").alias("id"), index_text(F.col("title"), F.col("body_text")).alias("text"))

    def resolve(self, queries: DataFrame) -> Resolution:
        """Groups of ``queries(query_id, text)``; blank texts have none."""
        asked = materialize(queries.select("query_id", query_text(F.col("text")).alias("asked")), "asked")

        def judge(hits: DataFrame) -> DataFrame:
            both = hits.join(asked, "query_id").join(self.texts, "id", "left")
            share = token_gate(F.col("asked"), F.col("text"))
            return both.withColumns({"equivalent": share > 0, "confidence": share})

        known = asked.where("asked IS NOT NULL").withColumn("embedding", self.embed(F.col("asked")))
        got = resolve(known, self.index, judge, self.existing, self.cfg)
        answers = asked.select("query_id").join(got.answers, "query_id", "left").select("query_id", "group_id", F.coalesce("reused", F.lit(False)).alias("reused"))
        return Resolution(answers, got.rows)
