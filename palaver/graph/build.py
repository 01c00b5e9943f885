"""The user graph: edges from answers, first-failing-rule counters, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.functions.text import year_of

CONFIG = GraphConfig()


def judged(pairs: DataFrame, cfg: GraphConfig = CONFIG) -> DataFrame:
    """``pairs(asker, answerer, creation_date)`` with year and the first rule each row fails: missing, excluded, self, year - or 'kept'."""
    excluded: Column = F.col("asker").isin(*cfg.exclude_user_ids) | F.col("answerer").isin(*cfg.exclude_user_ids)
    year = year_of(F.col("creation_date"))
    reason = (
        F.when(F.col("asker").isNull() | F.col("answerer").isNull(), "missing")
        .when(excluded, "excluded")
        .when((F.col("asker") == F.col("answerer")) & F.lit(cfg.drop_self_answers), "self")
        .when(year.isNull() | ~year.between(cfg.valid_year_min, cfg.valid_year_max), "year")
        .otherwise("kept")
    )
    return pairs.withColumn("year", year).withColumn("reason", reason)


def answer_pairs(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per answer: asker (null if the question is not there), answerer and time."""
    asked = questions.select("question_id", F.col("owner_user_id").alias("asker"))
    return answers.select("question_id", F.col("owner_user_id").alias("answerer"), "creation_date").join(asked, "question_id", "left")


def weigh(kept: DataFrame, by: Sequence[str] = (), cfg: GraphConfig = CONFIG) -> DataFrame:
    """(by..., src, dst, weight): parallel edges merged, oriented as configured."""
    src, dst = ("asker", "answerer") if cfg.edge_direction == "asker_to_answerer" else ("answerer", "asker")
    return kept.groupBy(*by, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a <= b: both directions of an edge summed."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def nodes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., id) of every node that has an edge."""
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose both ends are in ``keep(id)``."""
    k = keep.select("id").distinct()
    return edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
