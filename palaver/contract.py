"""Seams for what a deployment supplies: strategies take and return DataFrames, whole sets at a time."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from palaver.operators.resolver import Resolution


class GroupProvider(Protocol):
    """Answers pooled per group."""

    def fetch(self, group_ids: DataFrame) -> DataFrame:
        """(group_id) -> (group_id, answer_id, author_id, vote, is_accepted, creation_date, reputation)."""


class AuthorityProvider(Protocol):
    """Authority of answer authors."""

    def score(self, answers: DataFrame) -> DataFrame:
        """(answer_id, author_id, ...) -> the same with ``authority`` in [0, 1], null where unknown."""


class Resolver(Protocol):
    """Free-text questions to groups."""

    def resolve(self, queries: DataFrame) -> Resolution:
        """(query_id, text) -> answers (query_id, group_id, reused) and the candidate rows of new groups.

        :class:`palaver.operators.resolver.TextResolver` is one.
        """


class Labeller(Protocol):
    """Practices to labels, several runs."""

    def label(self, practices: DataFrame) -> DataFrame:
        """(group_id, idx, sentence) -> (group_id, run, idx, label)."""


class HashedLabeller:
    """Three labellings by plain rules, in place of a model asked three times: the words of a sentence, those of six letters or more, and its first three."""

    def label(self, practices: DataFrame) -> DataFrame:
        """(group_id, idx, sentence) -> (group_id, run, idx, label)."""
        from pyspark.sql import functions as F

        from palaver.operators.practices import words

        said = words(F.col("sentence"))
        keys = F.array(F.array_sort(F.array_distinct(said)), F.array_sort(F.array_distinct(F.filter(said, lambda w: F.length(w) >= 6))), F.slice(said, 1, 3))
        each = practices.select("group_id", "idx", F.posexplode(keys).alias("run", "key"))
        return each.select("group_id", "run", "idx", F.when(F.size("key") > 0, F.abs(F.xxhash64("key").cast("decimal(20,0)")).cast("bigint")).otherwise(-1).alias("label"))


class PercentileAuthority:
    """Authority by percentile of a score over all users with a positive one."""

    def __init__(self, scores: DataFrame) -> None:
        """``scores(user_id, score)``."""
        self.scores = scores

    def score(self, answers: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        from palaver.functions.rank import global_percentile

        known = global_percentile(self.scores.where("score > 0"), "score", "user_id", "authority")
        return answers.join(known.select(F.col("user_id").alias("author_id"), "authority"), "author_id", "left")


class VoteAuthority:
    """Authority by votes alone, for want of a graph."""

    def score(self, answers: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        from palaver.functions.rank import vote_authority

        return answers.withColumn("authority", vote_authority(F.col("vote"), F.col("is_accepted")))
