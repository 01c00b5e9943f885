"""User statistics, joined authority score and the wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.config import AuthorityConfig
from palaver.functions.rank import minmax
from palaver.functions.text import year_of

CONFIG = AuthorityConfig()


def user_stats(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per user that owns a question or an answer: counts, score sums, first and last year, accept rates.

    A question counts as accepted once, whatever the number of accepted answers,
    and only answers with an owner accept it.  Rates are 0 without a denominator.
    """
    zero = F.lit(0).cast("bigint")
    q = questions.where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("user_id"), F.lit("q").alias("kind"), "score", year_of(F.col("creation_date")).alias("year"), F.lit(0).alias("accepted"))
    a = answers.where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("user_id"), F.lit("a").alias("kind"), "score", year_of(F.col("creation_date")).alias("year"), (F.coalesce("is_accepted", F.lit(0)) == 1).cast("int").alias("accepted"))
    solved = answers.where("owner_user_id IS NOT NULL AND is_accepted = 1").select("question_id").distinct()
    credit = questions.where("owner_user_id IS NOT NULL").join(solved, "question_id", "left_semi").select(F.col("owner_user_id").alias("user_id"), F.lit("s").alias("kind"), zero.alias("score"), F.lit(None).cast("int").alias("year"), F.lit(0).alias("accepted"))
    is_ = lambda k: F.col("kind") == k
    per = q.unionByName(a).unionByName(credit).groupBy("user_id").agg(
        F.count(F.when(is_("q"), 1)).alias("question_count"),
        F.count(F.when(is_("a"), 1)).alias("answer_count"),
        F.coalesce(F.sum(F.when(is_("a"), F.col("accepted"))), zero).cast("bigint").alias("accepted_answer_count"),
        F.count(F.when(is_("s"), 1)).alias("question_with_accepted_count"),
        F.coalesce(F.sum(F.when(is_("q"), F.col("score"))), zero).alias("total_question_score"),
        F.coalesce(F.sum(F.when(is_("a"), F.col("score"))), zero).alias("total_answer_score"),
        F.min("year").alias("first_activity_year"),
        F.max("year").alias("last_activity_year"),
    )
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return per.withColumns({"answerer_accept_rate": rate("accepted_answer_count", "answer_count"), "asker_accept_rate": rate("question_with_accepted_count", "question_count")})


def _rho(top: DataFrame, y: str) -> DataFrame:
    """One row: rank correlation of pagerank and ``y`` in the bounded table ``top``."""
    from palaver.functions.rank import spearman

    return spearman(top.where(F.col(y).isNotNull()), "pagerank", y).select("rho")


def synthesize(pagerank: DataFrame, reputation: DataFrame, accept_rate: DataFrame, cfg: AuthorityConfig = CONFIG) -> DataFrame:
    """(user_id, authority_score, authority_scheme, components) of every user with a PageRank.

    All inputs are (id, value).  Components are min-max scaled over their whole
    inputs; a missing one is 0.  The scheme follows from the rank correlation of
    PageRank and reputation among the top users, in the plan, not on the driver:
    none or above ``overlap_high``: pagerank_only; below ``overlap_low``:
    dual_track; between: weighted.  Only 'weighted' mixes the components.
    """
    named = lambda df, c: minmax(df.select("id", F.col("value").alias(c)), c)
    parts = named(pagerank, "pagerank").join(named(reputation, "reputation"), "id", "left").join(named(accept_rate, "accept_rate"), "id", "left")
    top = parts.orderBy(F.desc("pagerank"), "id").limit(cfg.calibration_top_n)
    rho: Column = _rho(top, "reputation").scalar()
    scheme = F.when(F.col("_rho").isNull() | (F.col("_rho") > cfg.overlap_high), "pagerank_only").when(F.col("_rho") < cfg.overlap_low, "dual_track").otherwise("weighted")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mixed = cfg.pagerank_weight * F.col("pagerank") + cfg.reputation_weight * zero("reputation") + cfg.accept_rate_weight * zero("accept_rate")
    return parts.withColumn("_rho", rho).withColumn("authority_scheme", scheme).select(
        F.col("id").alias("user_id"),
        F.when(F.col("authority_scheme") == "weighted", mixed).otherwise(F.col("pagerank")).alias("authority_score"),
        "authority_scheme",
        F.col("pagerank").alias("comp_pagerank"),
        zero("reputation").alias("comp_tag_reputation"),
        zero("accept_rate").alias("comp_accept_rate"),
    )


def wide_table(users: DataFrame, stats: DataFrame, score: DataFrame, communities: DataFrame, centralities: DataFrame, methods: list[str]) -> DataFrame:
    """One row per user of any input: statistics, score, community (null if none) and one ``cent_`` column per method (0.0 if none).

    ``centralities(id, method, score)`` is pivoted over the given methods only.
    """
    wide = centralities.groupBy(F.col("id").alias("user_id")).pivot("method", methods).agg(F.first("score"))
    wide = wide.select("user_id", *[F.coalesce(m, F.lit(0.0)).alias(f"cent_{m}") for m in methods])
    ids = stats.select("user_id").union(score.select("user_id")).distinct()
    names = users.select("user_id", "display_name", "reputation")
    out = ids.join(names, "user_id", "left").join(stats, "user_id", "left").join(score, "user_id", "left")
    out = out.join(communities.select(F.col("id").alias("user_id"), F.col("community").alias("community_id")), "user_id", "left").join(wide, "user_id", "left")
    return out.na.fill(0.0, [f"cent_{m}" for m in methods]).na.fill(0, ["question_count", "answer_count", "accepted_answer_count", "total_question_score", "total_answer_score"])
