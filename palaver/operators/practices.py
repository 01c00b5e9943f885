"""Practices of answers: pooling a group's answers, extraction with flags, matching, names, companions and renames.

Where a deployment would ask a language model, the functions here are
deterministic stand-ins by plain rules; what they take and give is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import SENTENCE_END, evidence_type

# fixed values
MAX_CONDITIONS = 3
CONDITION = r"(?i)\b((?:if|when|unless) [^,.;!?]+)"
NOT_A_WORD = "[^a-z0-9]+"
LEAST_WORDS = 3  # of a sentence that states a practice
SUBSTANTIVE_WORDS = 6
TITLE_WORD = 4  # letters of a word that ties a sentence to its question


def is_member(decision: Column) -> Column:
    """Whether a candidate belongs to its group: judged equivalent, or seeded without a judgement."""
    return decision.isNull() | (decision == "equivalent")


def is_kept(relevant: Column, substantive: Column) -> Column:
    """Whether a practice counts: relevant and substantive; a null flag does not."""
    return F.coalesce((relevant == 1) & (substantive == 1), F.lit(False))


def pooled_answers(groups: DataFrame, answers: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """(group_id, answer_id, question_id, parent_title, body_text, vote, is_accepted, author_id, reputation) of the answers to each group's members.

    ``groups(group_id, question_id, gate_decision)``; the other tables are first
    rows.  A question in several groups gives its answers to each.  Answers to a
    question that is gone are left out, unknown authors have no reputation.
    """
    members = groups.where(is_member(F.col("gate_decision"))).select("group_id", "question_id").distinct()
    titled = answers.join(questions.select("question_id", F.col("title").alias("parent_title")), "question_id")
    pooled = titled.join(members, "question_id").join(users.select(F.col("user_id").alias("owner_user_id"), "reputation"), "owner_user_id", "left")
    return pooled.select("group_id", "answer_id", "question_id", "parent_title", F.coalesce("body_text", F.lit("")).alias("body_text"), F.col("score").alias("vote"), "is_accepted", F.col("owner_user_id").alias("author_id"), "reputation")


def words(c: Column) -> Column:
    """Words of lower-case letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def extract(answers: DataFrame) -> DataFrame:
    """(answer_id, practice_rank, practice_sentence, conditions, evidence_type, relevant, substantive) of ``answers(answer_id, parent_title, body_text)``.

    Sentences of at least three words are candidates, ranked from 0 in their
    order; at most three conditions are kept of each.  One that shares a longer
    word with the question's title is relevant, one of six words substantive.
    Answers without such a sentence have no rows.
    """
    said = F.filter(F.split(F.coalesce("body_text", F.lit("")), SENTENCE_END), lambda s: F.size(words(s)) >= LEAST_WORDS)
    each = answers.select("answer_id", "parent_title", evidence_type(F.col("body_text")).alias("evidence_type"), F.posexplode(said).alias("practice_rank", "practice_sentence"))
    long = lambda c: F.filter(words(F.col(c)), lambda w: F.length(w) >= TITLE_WORD)
    found = F.regexp_extract_all("practice_sentence", F.lit(CONDITION), 1)
    return each.select(
        "answer_id", "practice_rank", "practice_sentence", F.slice(found, 1, MAX_CONDITIONS).alias("conditions"), "evidence_type",
        F.arrays_overlap(long("practice_sentence"), long("parent_title")).cast("int").alias("relevant"),
        (F.size(words(F.col("practice_sentence"))) >= SUBSTANTIVE_WORDS).cast("int").alias("substantive"),
    )


def matched(practices: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(practices of known answers, one row with the number of those without)."""
    known = answers.select("answer_id").distinct()
    return practices.join(known, "answer_id", "left_semi"), practices.join(known, "answer_id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


def cluster_names(members: DataFrame, most: int = 3) -> DataFrame:
    """(group_id, cluster, name, description): the ``most`` words that tell a cluster from the others of its group, and its first sentence.

    ``members(group_id, cluster, sentence)``.  Words are ordered by the number of
    the cluster's sentences with them less the share of the group's clusters that
    have them; clusters whose words are the same are told apart by a number.
    """
    per = members.select("group_id", "cluster", F.explode(F.array_distinct(words(F.col("sentence")))).alias("word")).groupBy("group_id", "cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    wide = per.groupBy("group_id", "word").agg(F.count(F.lit(1)).alias("clusters"))
    order = Window.partitionBy("group_id", "cluster").orderBy("clusters", F.desc("n"), "word")
    top = per.join(wide, ["group_id", "word"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")  # at most ``most`` words
    named = top.groupBy("group_id", "cluster").agg(label.alias("label"))
    again = F.row_number().over(Window.partitionBy("group_id", "label").orderBy("cluster"))
    first = members.groupBy("group_id", "cluster").agg(F.min("sentence").alias("description"))
    named = named.withColumn("name", F.when(again == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ·"), again.cast("string"))))
    return first.join(named.drop("label"), ["group_id", "cluster"], "left").select("group_id", "cluster", F.coalesce("name", F.lit("")).alias("name"), "description")


def assign(clusters: DataFrame, companions: DataFrame, least: int = 2) -> DataFrame:
    """(group_id, idx, cluster, companion): clusters under ``least`` members are the long tail - no cluster - but keep their companion label.

    ``clusters(group_id, idx, cluster)``, ``companions(group_id, idx, companion)``.
    """
    size = clusters.groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    head = F.when(F.col("size") >= least, F.col("cluster"))
    return clusters.join(size, ["group_id", "cluster"]).select("group_id", "idx", head.alias("cluster")).join(companions, ["group_id", "idx"], "left")


def renamed(clusters: DataFrame, renames: DataFrame) -> DataFrame:
    """``clusters(group_id, cluster, members, name)`` with the names of ``renames(members, name)`` that lists the same members in any order.

    Of several renames of one member set the first name holds.
    """
    key = F.array_sort("members")
    new = renames.select(key.alias("_key"), F.col("name").alias("_new")).groupBy("_key").agg(F.min("_new").alias("_new"))
    joined = clusters.withColumn("_key", key).join(new, "_key", "left")
    return joined.withColumns({"name": F.coalesce("_new", "name"), "renamed": F.col("_new").isNotNull()}).drop("_key", "_new")


def flat_index(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``flat``, the position within the group from 0."""
    return rows.withColumn("flat", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def first_seen(rows: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """(group, key, place): each key once, in the order in which it is first seen."""
    once = rows.groupBy(group, key).agg(F.min(position).alias("_at"))
    return once.select(group, key, (F.row_number().over(Window.partitionBy(group).orderBy("_at", key)) - 1).alias("place"))


def known_group(text: Column, known: dict[str, str]) -> Column:
    """The group of the first known text that contains ``text`` or is contained in it, in lower case; null for blank texts and where none does.

    ``known`` is a short list of a deployment, one expression each.
    """
    asked = F.nullif(F.lower(F.trim(text)), F.lit(""))
    hits = [F.when(asked.contains(k) | F.lit(k).contains(asked), F.lit(g)) for k, g in ((t.strip().lower(), g) for t, g in known.items())]
    return F.coalesce(*hits, F.lit(None).cast("string"))
