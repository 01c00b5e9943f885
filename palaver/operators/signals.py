"""Consensus signals of all groups at once: camps, shares, shape, authority overlay.

Input is one row per kept practice: (group_id, ext_id, answer_id, camp_id, vote,
author_id, agreement, sentence), where camp_id is null in the long tail and
``agreement`` is the camp's; authority is (author_id, pr, name).  Vote ties go to
the smaller ext_id, then id, so that results do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.config import ShapeConfig

CONFIG = ShapeConfig()


def shape_label(top1: Column, top2: Column, cfg: ShapeConfig = CONFIG) -> Column:
    """consensus, polarization or fragmentation from the two largest shares."""
    return (
        F.when((top1 >= cfg.top1_consensus) & (top1 - top2 >= cfg.gap_consensus), "consensus")
        .when(top1 + top2 >= cfg.top2_polarization, "polarization")
        .otherwise("fragmentation")
    )


def merge_flips(shares: Column, cfg: ShapeConfig = CONFIG) -> Column:
    """Whether merging the two largest of descending ``shares`` changes the label; never with one camp."""
    first, second, third = (F.coalesce(F.get(shares, F.lit(i)), F.lit(0.0)) for i in range(3))
    merged = first + second  # the largest again, the third share is next
    return (F.size(shares) >= 2) & (shape_label(merged, third, cfg) != shape_label(first, second, cfg))


def camp_votes(practices: DataFrame) -> DataFrame:
    """(group_id, camp_id, first_ext, prevalence_n, vote_sum, vote_share, agreement): each answer counts once per camp, its vote floored at 0."""
    head = practices.where("camp_id IS NOT NULL")
    answers = head.groupBy("group_id", "camp_id", "answer_id").agg(F.max(F.greatest("vote", F.lit(0))).alias("v"), F.min("ext_id").alias("e"), F.max("agreement").alias("g"))
    camps = answers.groupBy("group_id", "camp_id").agg(F.min("e").alias("first_ext"), F.count(F.lit(1)).alias("prevalence_n"), F.sum("v").alias("vote_sum"), F.coalesce(F.max("g"), F.lit(0.0)).alias("agreement"))
    total = F.sum("vote_sum").over(Window.partitionBy("group_id"))
    return camps.withColumn("vote_share", F.coalesce(F.col("vote_sum") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def exemplars(practices: DataFrame) -> DataFrame:
    """(group_id, camp_id, exemplar): the sentence of the highest vote, the first on ties."""
    best = F.max_by("sentence", F.struct(F.greatest("vote", F.lit(0)).alias("v"), (-F.col("ext_id")).alias("e")))
    return practices.where("camp_id IS NOT NULL").groupBy("group_id", "camp_id").agg(best.alias("exemplar"))


def primary_camps(practices: DataFrame) -> DataFrame:
    """(group_id, author_id, camp_id): an author's camp of the highest vote, then of the most practices, then the first."""
    own = practices.where("camp_id IS NOT NULL AND author_id IS NOT NULL")
    per = own.groupBy("group_id", "author_id", "camp_id").agg(F.count(F.lit(1)).alias("f"))
    top = own.groupBy("group_id", "author_id", "camp_id").agg(F.max(F.struct(F.greatest("vote", F.lit(0)).alias("v"), (-F.col("ext_id")).alias("e"))).alias("b"))
    ranked = per.join(top, ["group_id", "author_id", "camp_id"])
    return ranked.groupBy("group_id", "author_id").agg(F.max_by("camp_id", F.struct("b.v", "f", "b.e")).alias("camp_id"))


def camp_signals(practices: DataFrame, authority: DataFrame) -> DataFrame:
    """One row per (group, camp): votes, prevalence, and where the central authors stand."""
    camps = camp_votes(practices).join(exemplars(practices), ["group_id", "camp_id"])
    answers = practices.groupBy("group_id").agg(F.count_distinct("answer_id").alias("n_answers"))
    known = authority.where("pr > 0").select("author_id", "pr", "name")
    primary = primary_camps(practices).join(known, "author_id", "left")
    group = Window.partitionBy("group_id")
    ranked = _ranked_authors(practices, known).where("place <= 3").select("group_id", "author_id", F.lit(1).alias("top3"))
    primary = primary.join(ranked, ["group_id", "author_id"], "left").withColumn("pr_total", F.coalesce(F.sum("pr").over(group), F.lit(0.0)))
    pr0 = F.coalesce("pr", F.lit(0.0))
    overlay = primary.groupBy("group_id", "camp_id").agg(
        F.sum(pr0).alias("camp_pr"),
        F.max(pr0).alias("top_pr"),
        F.max_by("author_id", F.struct(pr0, (-F.col("author_id")))).alias("top_author_id"),
        F.max("pr_total").alias("pr_total"),
        F.count("top3").alias("n_top3_authors"),
    )
    names = authority.select(F.col("author_id").alias("top_author_id"), F.col("name").alias("top_author"))
    covered = (
        practices.where("camp_id IS NOT NULL").select("group_id", "camp_id", "answer_id", "author_id").distinct()
        .join(known.select("author_id"), "author_id", "left_semi").groupBy("group_id", "camp_id").agg(F.count_distinct("answer_id").alias("known"))
    )
    share = lambda c: F.round(F.coalesce(F.col(c) / F.nullif("pr_total", F.lit(0.0)), F.lit(0.0)), 4)
    keys = ["group_id", "camp_id"]
    return camps.join(answers, "group_id").join(overlay, keys, "left").join(names, "top_author_id", "left").join(covered, keys, "left").select(
        *keys, "exemplar", "prevalence_n", "first_ext",
        F.round(F.col("prevalence_n") / F.col("n_answers"), 4).alias("prevalence_share"),
        "vote_sum", F.round("vote_share", 4).alias("vote_share"),
        share("camp_pr").alias("author_pr_share"), "top_author", share("top_pr").alias("top_author_pr_share"),
        F.coalesce("n_top3_authors", F.lit(0)).alias("n_top3_authors"),
        F.round(F.coalesce("known", F.lit(0)) / F.col("prevalence_n"), 4).alias("authority_coverage"),
        F.round("agreement", 4).alias("voting_agreement"),
    )


def _ranked_authors(practices: DataFrame, known: DataFrame) -> DataFrame:
    """Authors of all kept practices - the long tail included - by raw PageRank within the group."""
    of = practices.where("author_id IS NOT NULL").select("group_id", "author_id").distinct().join(known, "author_id")
    return of.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("pr"), "author_id")))


def group_signals(practices: DataFrame, authority: DataFrame, cfg: ShapeConfig = CONFIG) -> DataFrame:
    """One row per group: shape, fragility, leaders and authority overlay.

    The share of the top author may exceed 1: authors are ranked over all kept
    practices, the total is over authors with a camp.
    """
    camps = camp_votes(practices)
    lead = Window.partitionBy("group_id").orderBy(F.desc("vote_share"), "first_ext", "camp_id")
    prev = Window.partitionBy("group_id").orderBy(F.desc("prevalence_n"), "first_ext", "camp_id")
    placed = camps.withColumns({"rn": F.row_number().over(lead), "pn": F.row_number().over(prev)})
    at = lambda n, c, col="rn": F.max(F.when(F.col(col) == n, F.col(c)))
    squares = F.sum(F.col("vote_share") * F.col("vote_share"))
    head = placed.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_head_camps"),
        at(1, "vote_share").alias("top1"),
        F.coalesce(at(2, "vote_share"), F.lit(0.0)).alias("top2"),
        F.coalesce(at(3, "vote_share"), F.lit(0.0)).alias("top3"),
        F.coalesce(F.lit(1.0) / F.nullif(squares, F.lit(0.0)), F.lit(0.0)).alias("effective_camps"),
        (F.sum(F.col("agreement") * F.col("prevalence_n")) / F.sum("prevalence_n")).alias("mean_agreement"),
        at(1, "camp_id").alias("vote_leader"),
        at(1, "camp_id", "pn").alias("prevalence_leader"),
    )
    votes = practices.groupBy("group_id", "answer_id").agg(F.max(F.greatest("vote", F.lit(0))).alias("v"), F.bool_or(F.col("camp_id").isNotNull()).alias("head"), F.max("author_id").alias("author_id"))
    known = authority.where("pr > 0").select("author_id", "pr", "name")
    votes = votes.join(known.select("author_id", F.lit(1).alias("known")), "author_id", "left")
    all_ = votes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_answers"), F.sum("v").alias("grand"), F.coalesce(F.sum(F.when(F.col("head"), F.col("v"))), F.lit(0)).alias("head_vote"), F.count("known").alias("covered")
    )
    size = practices.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_practices"), F.count(F.when(F.col("camp_id").isNull(), 1)).alias("n_longtail"))
    primary = primary_camps(practices)
    total = primary.join(known, "author_id").groupBy("group_id").agg(F.sum("pr").alias("pr_total"))
    ranks = _ranked_authors(practices, known).join(primary.withColumnRenamed("camp_id", "own"), ["group_id", "author_id"], "left").where("place <= 3")
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    tops = ranks.groupBy("group_id").agg(
        first("name").alias("top1_author"), first("pr").alias("pr1"), first("own").alias("top1_author_cluster"), F.sum("pr").alias("pr3"), F.collect_list("own").alias("owns")
    )
    t1, t2, t3 = (F.coalesce(c, F.lit(0.0)) for c in ("top1", "top2", "top3"))
    n_head = F.coalesce("n_head_camps", F.lit(0))
    label = F.when(n_head == 0, "fragmentation").otherwise(shape_label(t1, t2, cfg))
    flips = (n_head >= 2) & (shape_label(t1 + t2, t3, cfg) != label)
    fragile = (n_head == 0) | (F.coalesce("mean_agreement", F.lit(1.0)) < cfg.agree_fragile) | flips
    ok = F.col("pr_total") > 0
    in_leader = F.size(F.filter(F.coalesce("owns", F.array().cast("array<bigint>")), lambda c: c == F.col("vote_leader")))
    j = size.join(all_, "group_id").join(head, "group_id", "left").join(total, "group_id", "left").join(tops, "group_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.select(
        "group_id", "n_answers", "n_practices", n_head.alias("n_head_camps"), "n_longtail",
        F.round(F.coalesce((F.col("grand") - F.col("head_vote")) / F.nullif("grand", F.lit(0)), F.lit(0.0)), 4).alias("longtail_vote_share"),
        F.round(F.coalesce("effective_camps", F.lit(0.0)), 4).alias("effective_camps"),
        F.round(t1, 4).alias("top1_share"), F.round(t2, 4).alias("top2_share"), F.round(t1 - t2, 4).alias("gap"),
        label.alias("shape_label"), fragile.cast("int").alias("shape_fragile"), F.col("vote_leader").alias("vote_leader_cluster"),
        F.when(ok, F.col("top1_author")).alias("top1_author"), F.when(ok, F.round(F.col("pr1") / F.col("pr_total"), 4)).alias("top1_pr_share"),
        F.coalesce(F.when(ok, F.round(F.col("pr3") / F.col("pr_total"), 4)), F.lit(0.0)).alias("top3_pr_share"),
        flag(ok & (F.col("pr1") / F.col("pr_total") > cfg.single_voice)).alias("single_voice_dominated"),
        F.when(ok, F.col("top1_author_cluster")).alias("top1_author_cluster"),
        flag(ok & (F.col("top1_author_cluster") != F.col("vote_leader"))).alias("authority_diverges"),
        in_leader.alias("top3_in_vote_leader"),
        F.round(F.col("covered") / F.col("n_answers"), 4).alias("authority_coverage_overall"),
        F.col("prevalence_leader").alias("prevalence_leader_cluster"), flag(F.col("prevalence_leader") != F.col("vote_leader")).alias("prevalence_diverges"),
    )


def runners_up(camps: DataFrame) -> DataFrame:
    """(group_id, leader, runner_up): the camp of the largest share and the best other one, null if there is none."""
    w = Window.partitionBy("group_id").orderBy(F.desc("vote_share"), "first_ext", "camp_id")
    at = lambda n: F.max(F.when(F.col("rn") == n, F.col("camp_id")))
    return camps.withColumn("rn", F.row_number().over(w)).groupBy("group_id").agg(at(1).alias("leader"), at(2).alias("runner_up"))


def signal_text(camps: DataFrame) -> DataFrame:
    """(group_id, table): a fixed-width text of the camps by share, one line each."""
    line = F.format_string("%-8s %5d %6s", F.col("camp_id").cast("string"), "prevalence_n", F.concat(F.round(100 * F.col("vote_share"), 0).cast("int").cast("string"), F.lit("%")))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("vote_share")).alias("s"), "first_ext", line.alias("line"))))
    return camps.groupBy("group_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("table"))


def narrative(groups: DataFrame) -> DataFrame:
    """(group_id, headline): a sentence that describes the signals and adds nothing to them; stands in for a written narrative."""
    percent = F.concat(F.round(100 * F.col("top1_share"), 0).cast("int").cast("string"), F.lit("%"))
    return groups.select(
        "group_id",
        F.concat(
            F.initcap("shape_label"), F.lit(" over "), F.col("n_head_camps").cast("string"), F.lit(" camps; the largest holds "), percent,
            F.when(F.col("authority_diverges") == 1, F.lit("; the most central author stands elsewhere")).otherwise(F.lit("")),
        ).alias("headline"),
    )
