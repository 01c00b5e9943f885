"""Queries of the relational core: edges, statistics, summaries, audits, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.rank import average_rank_percentile, fused_weight, global_percentile, vote_authority
from palaver.functions.text import month_of, one_hot, sentences, year_of
from palaver.graph.authority import user_stats
from palaver.graph.build import answer_pairs, judged, weigh
from palaver.operators.audit import audit, dangling, verdict
from palaver.plans.registry import Registry
from palaver.plans.sqltext import A, C, EDGES, JUDGED, Q, U, YEAR_EDGES, month, year
from palaver.sources.tables import first, table
from palaver.sources.writers import insert_or_ignore, undone

REGISTRY = Registry()
TRACKED = ("reactjs", "javascript", "typescript")
# periods of collection: four years and one of fifteen months, as (label, from, to) in epoch seconds
PERIODS = (
    ("2021-01", 1609459200, 1640995200), ("2022-01", 1640995200, 1672531200), ("2023-01", 1672531200, 1704067200),
    ("2024-01", 1704067200, 1735689600), ("2025-01", 1735689600, 1775001600),
)
_PERIODS = ", ".join(f"('{p}', {a}, {b})" for p, a, b in PERIODS)


def questions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """First rows of questions."""
    return first(spark, d, "questions", *cols)


def answers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """First rows of answers."""
    return first(spark, d, "answers", *cols)


def comments(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """First rows of comments."""
    return first(spark, d, "comments", *cols)


# --- edges ---------------------------------------------------------------------


def interaction_edges_of(q: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """Edges rebuilt from posts: answers, replies, and comments on a question or an answer that name no one.

    Both ends known and different; is_react is the question's.  The four joins
    share their scans; AQE splits a question that holds many posts.
    """
    qs = q.select(F.col("question_id").alias("qid"), F.col("owner_user_id").alias("asker"), F.col("is_react").alias("react"))
    out = ("source_user_id", "target_user_id", "interaction_type", "post_id", "parent_post_id", "is_react", "creation_date")

    def edges(df: DataFrame, source: str, target: str, kind: str, post: str, parent: str) -> DataFrame:
        e = df.select(F.col(source), F.col(target), F.lit(kind), F.col(post), F.col(parent), F.col("react"), F.col("creation_date")).toDF(*out)
        return e.where("source_user_id <> target_user_id")  # drops null ends too

    said = a.join(qs, F.col("question_id") == F.col("qid"))
    reply = c.where("reply_to_user_id IS NOT NULL").join(qs, F.col("question_id") == F.col("qid"))
    plain = c.where("reply_to_user_id IS NULL")
    on_q = plain.where("post_type = 'question'").join(qs, F.col("post_id") == F.col("qid"))
    parent = a.select(F.col("answer_id").alias("aid"), F.col("owner_user_id").alias("answerer"), F.col("question_id").alias("aq"))
    on_a = plain.where("post_type = 'answer'").join(parent, F.col("post_id") == F.col("aid")).join(qs, F.col("aq") == F.col("qid"))
    return reduce(DataFrame.unionByName, [
        edges(said, "owner_user_id", "asker", "answer", "answer_id", "qid"),
        edges(reply, "owner_user_id", "reply_to_user_id", "comment_reply", "comment_id", "post_id"),
        edges(on_q, "owner_user_id", "asker", "comment", "comment_id", "qid"),
        edges(on_a, "owner_user_id", "answerer", "comment", "comment_id", "aid"),
    ])


def _edge_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        questions(spark, d, "owner_user_id", "is_react"),
        answers(spark, d, "question_id", "owner_user_id", "creation_date"),
        comments(spark, d, "post_id", "post_type", "question_id", "owner_user_id", "reply_to_user_id", "creation_date"),
    )


_INTERACTIONS = f"""{Q}, {A}, {C}, ie AS (
  SELECT a.owner_user_id AS source_user_id, q.owner_user_id AS target_user_id, 'answer' AS interaction_type, a.answer_id AS post_id, q.question_id AS parent_post_id, q.is_react, a.creation_date
    FROM a JOIN q ON a.question_id = q.question_id WHERE a.owner_user_id <> q.owner_user_id
  UNION ALL SELECT c.owner_user_id, c.reply_to_user_id, 'comment_reply', c.comment_id, c.post_id, q.is_react, c.creation_date
    FROM c JOIN q ON c.question_id = q.question_id WHERE c.owner_user_id <> c.reply_to_user_id
  UNION ALL SELECT c.owner_user_id, q.owner_user_id, 'comment', c.comment_id, q.question_id, q.is_react, c.creation_date
    FROM c JOIN q ON c.post_id = q.question_id WHERE c.post_type = 'question' AND c.reply_to_user_id IS NULL AND c.owner_user_id <> q.owner_user_id
  UNION ALL SELECT c.owner_user_id, a.owner_user_id, 'comment', c.comment_id, a.answer_id, q.is_react, c.creation_date
    FROM c JOIN a ON c.post_id = a.answer_id JOIN q ON a.question_id = q.question_id WHERE c.post_type = 'answer' AND c.reply_to_user_id IS NULL AND c.owner_user_id <> a.owner_user_id)"""


@REGISTRY.query("interaction_edges", f"WITH {_INTERACTIONS} SELECT * FROM ie")
def interaction_edges(spark: SparkSession, d: str) -> DataFrame:
    return interaction_edges_of(*_edge_inputs(spark, d))


@REGISTRY.query("interaction_type_counts", f"WITH {_INTERACTIONS} SELECT interaction_type, count(*) AS n FROM ie GROUP BY 1")
def interaction_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return interaction_edges(spark, d).groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return judged(answer_pairs(answers(spark, d, "question_id", "owner_user_id", "creation_date"), questions(spark, d, "owner_user_id")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Weighted asker -> answerer edges of all years."""
    return weigh(_judged(spark, d).where("reason = 'kept'"))


def year_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same per year."""
    return weigh(_judged(spark, d).where("reason = 'kept'"), ["year"])


@REGISTRY.query("edge_cascade_counts", f"WITH {Q}, {A}, {JUDGED} SELECT reason, count(*) AS n FROM jj GROUP BY 1")
def edge_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


REGISTRY.query("edge_weights_full", f"WITH {EDGES} SELECT * FROM e")(edges)
REGISTRY.query("edge_weights_yearly", f"WITH {YEAR_EDGES} SELECT * FROM e")(year_edges)


@REGISTRY.query("edges_from_interactions", f"""WITH i AS (SELECT target_user_id AS asker, source_user_id AS answerer, {year("creation_date")} AS year FROM interactions WHERE interaction_type = 'answer')
SELECT asker AS src, answerer AS dst, count(*) AS weight FROM i WHERE asker <> 0 AND answerer <> 0 AND asker <> answerer AND year BETWEEN 2021 AND 2026 GROUP BY 1, 2""")  # fmt: skip
def edges_from_interactions(spark: SparkSession, d: str) -> DataFrame:
    """The graph from the stored interactions; the filter on the type reaches the scan."""
    i = table(spark, d, "interactions").where("interaction_type = 'answer'").select(F.col("target_user_id").alias("asker"), F.col("source_user_id").alias("answerer"), "creation_date")
    return weigh(judged(i).where("reason = 'kept'"))


@REGISTRY.query("graph_stats", f"""WITH {YEAR_EDGES} SELECT CAST(year AS VARCHAR) AS period, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY 1
UNION ALL SELECT 'all', count(*), CAST(sum(w) AS BIGINT) FROM (SELECT src, dst, sum(weight) AS w FROM e GROUP BY 1, 2)""")  # fmt: skip
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n = [F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")]
    return year_edges(spark, d).groupBy(F.col("year").cast("string").alias("period")).agg(*n).unionByName(edges(spark, d).groupBy(F.lit("all").alias("period")).agg(*n))


@REGISTRY.query("graph_density_degree", f"""WITH {EDGES}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), t AS (SELECT dst, sum(weight) AS w FROM e GROUP BY 1 ORDER BY w DESC, dst LIMIT 3)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9) AS density,
       (SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY w DESC, dst) FROM t) AS top3""")  # fmt: skip
def graph_density_degree(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.count_distinct("id").alias("nodes"))
    top = e.groupBy("dst").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "dst").limit(3)
    names = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "dst"))), lambda r: r["dst"].cast("string")), ",").alias("top3"))
    count = e.agg(F.count(F.lit(1)).alias("edges"))
    return n.select("nodes", count.scalar().alias("edges"), F.round(count.scalar() / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"), names.scalar().alias("top3"))


# --- statistics ------------------------------------------------------------------

_STATS = f"""{Q}, {A},
  ev AS (SELECT owner_user_id AS user_id, 'q' AS k, score, {year("creation_date")} AS y, 0 AS acc FROM q
   UNION ALL SELECT owner_user_id, 'a', score, {year("creation_date")}, CASE WHEN is_accepted = 1 THEN 1 ELSE 0 END FROM a
   UNION ALL SELECT q.owner_user_id, 's', 0, NULL, 0 FROM q WHERE question_id IN (SELECT question_id FROM a WHERE is_accepted = 1 AND owner_user_id IS NOT NULL)),
  st AS (SELECT user_id, count(CASE WHEN k = 'q' THEN 1 END) AS question_count, count(CASE WHEN k = 'a' THEN 1 END) AS answer_count, CAST(coalesce(sum(CASE WHEN k = 'a' THEN acc END), 0) AS BIGINT) AS accepted_answer_count,
     count(CASE WHEN k = 's' THEN 1 END) AS question_with_accepted_count, CAST(coalesce(sum(CASE WHEN k = 'q' THEN score END), 0) AS BIGINT) AS total_question_score,
     CAST(coalesce(sum(CASE WHEN k = 'a' THEN score END), 0) AS BIGINT) AS total_answer_score, min(y) AS first_activity_year, max(y) AS last_activity_year FROM ev WHERE user_id IS NOT NULL GROUP BY 1)"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every owner of a question or answer."""
    return user_stats(questions(spark, d, "owner_user_id", "score", "creation_date"), answers(spark, d, "question_id", "owner_user_id", "score", "creation_date", "is_accepted"))


@REGISTRY.query("user_activity_stats", f"WITH {_STATS} SELECT * FROM st")
def user_activity_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).drop("answerer_accept_rate", "asker_accept_rate")


@REGISTRY.query("accept_rates", f"""WITH {_STATS} SELECT user_id, round(coalesce(accepted_answer_count / nullif(answer_count, 0), 0), 6) AS answerer_accept_rate,
  round(coalesce(question_with_accepted_count / nullif(question_count, 0), 0), 6) AS asker_accept_rate FROM st""")  # fmt: skip
def accept_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).select("user_id", *[F.round(c, 6).alias(c) for c in ("answerer_accept_rate", "asker_accept_rate")])


@REGISTRY.query("distinct_participants", """WITH x AS (SELECT owner_user_id AS id, is_react FROM questions UNION ALL SELECT owner_user_id, is_react FROM answers UNION ALL SELECT owner_user_id, is_react FROM comments)
SELECT is_react, count(DISTINCT id) AS participants FROM x GROUP BY 1""")  # fmt: skip
def distinct_participants(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("is_react", F.col("owner_user_id").alias("id")) for t in ("questions", "answers", "comments")]
    return reduce(DataFrame.unionByName, parts).groupBy("is_react").agg(F.count_distinct("id").alias("participants"))


@REGISTRY.query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS stored, count(DISTINCT {k}) AS keys FROM {t}" for t, k in (("questions", "question_id"), ("answers", "answer_id"), ("comments", "comment_id"), ("users", "user_id"), ("interactions", "id"))))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    keys = {"questions": "question_id", "answers": "answer_id", "comments": "comment_id", "users": "user_id", "interactions": "id"}
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count(F.lit(1)).alias("stored"), F.count_distinct(k).alias("keys")).select(F.lit(t).alias("table_name"), "stored", "keys") for t, k in keys.items()])


@REGISTRY.query("period_pivot", f"""WITH {Q}, per(period, lo, hi) AS (VALUES {_PERIODS})
SELECT period, {", ".join(f"count(CASE WHEN list_contains(tags, '{t}') THEN 1 END) AS {t}" for t in TRACKED)},
       CAST(sum({" + ".join(f"CASE WHEN list_contains(tags, '{t}') THEN 1 ELSE 0 END" for t in TRACKED)}) AS BIGINT) AS total
FROM q JOIN per ON creation_date >= lo AND creation_date < hi GROUP BY 1""")  # fmt: skip
def period_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Questions per period and tracked tag with row totals: one pass, a literal range test per period, one-hot sums."""
    t = F.col("creation_date")
    period = reduce(lambda c, p: c.when((t >= p[1]) & (t < p[2]), p[0]), PERIODS, F.when(F.lit(False), F.lit(None)))
    q = questions(spark, d, "tags", "creation_date").select(period.alias("period"), *one_hot(F.col("tags"), TRACKED)).where("period IS NOT NULL")
    return q.groupBy("period").agg(*[F.sum(c).alias(c) for c in TRACKED], F.sum(reduce(lambda a, b: a + b, [F.col(c) for c in TRACKED])).alias("total"))


@REGISTRY.query("quality_ratios", f"""WITH {Q}, {C} SELECT 'closed questions' AS metric, round(100.0 * count(CASE WHEN is_closed = 1 THEN 1 END) / count(*), 4) AS percent FROM q
UNION ALL SELECT 'comments with reply', round(100.0 * count(reply_to_user_id) / count(*), 4) FROM c""")  # fmt: skip
def quality_ratios(spark: SparkSession, d: str) -> DataFrame:
    pct = lambda df, name, c: df.agg(F.round(100.0 * F.count(c) / F.count(F.lit(1)), 4).alias("percent")).select(F.lit(name).alias("metric"), "percent")
    return pct(questions(spark, d, "is_closed"), "closed questions", F.when(F.col("is_closed") == 1, 1)).unionByName(pct(comments(spark, d, "reply_to_user_id"), "comments with reply", F.col("reply_to_user_id")))


@REGISTRY.query("tag_flags", f"WITH {Q} SELECT question_id, 1 AS {TRACKED[0]}, " + ", ".join(f"CAST(coalesce(list_contains(tags, '{t}'), false) AS INTEGER) AS {t}" for t in TRACKED[1:]) + " FROM q")
def tag_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the tracked tags; the one that was collected by is always set."""
    return questions(spark, d, "tags").select("question_id", *one_hot(F.col("tags"), TRACKED, forced=TRACKED[0]))


@REGISTRY.query("monthly_questions", f"WITH {Q} SELECT {month('creation_date')} AS month, count(*) AS n, {year('min(creation_date)')} AS year FROM q WHERE creation_date IS NOT NULL GROUP BY 1")
def monthly_questions(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "creation_date").where("creation_date IS NOT NULL")
    return q.groupBy(month_of(F.col("creation_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), year_of(F.min("creation_date")).alias("year"))


# --- joins and anti-joins ----------------------------------------------------------


@REGISTRY.query("dangling_antijoin", f"WITH {Q}, {A} SELECT answer_id, question_id FROM a WHERE question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q WHERE q.question_id = a.question_id)")
def dangling_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return dangling(answers(spark, d, "question_id"), "question_id", table(spark, d, "questions"), "question_id").select("answer_id", "question_id")


@REGISTRY.query("missing_profiles", """WITH x AS (SELECT owner_user_id AS user_id FROM questions UNION SELECT owner_user_id FROM answers UNION SELECT owner_user_id FROM comments UNION SELECT reply_to_user_id FROM comments)
SELECT user_id FROM x WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)""")  # fmt: skip
def missing_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Users that are named but were never fetched; distinct before the anti-join, so no user is probed twice."""
    ids = [table(spark, d, t).select(F.col(c).alias("user_id")) for t, c in (("questions", "owner_user_id"), ("answers", "owner_user_id"), ("comments", "owner_user_id"), ("comments", "reply_to_user_id"))]
    return dangling(reduce(DataFrame.union, ids).distinct(), "user_id", table(spark, d, "users"), "user_id")


@REGISTRY.query("resume_antijoin", f"WITH {Q} SELECT question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM canonical_index WHERE question_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Questions that still await their embedding."""
    return undone(questions(spark, d).select("question_id"), table(spark, d, "canonical_index"), ["question_id"])


@REGISTRY.query("answered_accepted_semijoin", f"""WITH {Q}, {A} SELECT question_id FROM q WHERE question_id IN (SELECT question_id FROM a WHERE is_accepted = 1)
AND question_id IN (SELECT question_id FROM comments WHERE question_id IS NOT NULL)""")  # fmt: skip
def answered_accepted_semijoin(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select("question_id")
    return q.join(answers(spark, d, "question_id", "is_accepted").where("is_accepted = 1"), "question_id", "left_semi").join(table(spark, d, "comments"), "question_id", "left_semi")


@REGISTRY.query("flag_inheritance", f"WITH {Q}, {A} SELECT answer_id, coalesce(q.is_react, 0) AS inherited, a.is_react AS stored FROM a LEFT JOIN q USING (question_id)")
def flag_inheritance(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "is_react").select("question_id", F.col("is_react").alias("q_react"))
    return answers(spark, d, "question_id", "is_react").join(q, "question_id", "left").select("answer_id", F.coalesce("q_react", F.lit(0)).alias("inherited"), F.col("is_react").alias("stored"))


@REGISTRY.query("comment_roots", f"WITH {A}, {C} SELECT comment_id, CASE WHEN post_type = 'question' THEN post_id ELSE a.question_id END AS root_id FROM c LEFT JOIN a ON c.post_id = a.answer_id AND c.post_type <> 'question'")
def comment_roots(spark: SparkSession, d: str) -> DataFrame:
    """The question of each comment, directly or through its answer."""
    parent = answers(spark, d, "question_id").select(F.col("answer_id").alias("aid"), F.col("question_id").alias("via"))
    c = comments(spark, d, "post_id", "post_type")
    return c.join(parent, (F.col("post_id") == F.col("aid")) & (F.col("post_type") != "question"), "left").select("comment_id", F.when(F.col("post_type") == "question", F.col("post_id")).otherwise(F.col("via")).alias("root_id"))


@REGISTRY.query("insert_or_ignore_users", f"""WITH {U}, n AS (SELECT DISTINCT user_id, display_name FROM user_authority)
SELECT user_id, display_name FROM u UNION ALL SELECT user_id, display_name FROM n WHERE user_id NOT IN (SELECT user_id FROM u)""")  # fmt: skip
def insert_or_ignore_users(spark: SparkSession, d: str) -> DataFrame:
    """Profiles plus the users only the snapshot knows: first writer wins."""
    old = first(spark, d, "users", "display_name").select("user_id", "display_name")
    return insert_or_ignore(old, table(spark, d, "user_authority").select("user_id", "display_name"), ["user_id"], [F.col("display_name")])


# --- audits --------------------------------------------------------------------------


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(
        questions(spark, d, "title", "body_text", "owner_user_id", "creation_date", "is_react"),
        answers(spark, d, "question_id", "body_text", "owner_user_id", "creation_date", "is_react"),
        comments(spark, d, "question_id", "body_text", "owner_user_id", "creation_date", "is_react"),
        first(spark, d, "users"),
    )


_ENT = "&(amp|lt|gt|quot|apos|nbsp|#\\d+);"


def _check(name: str, source: str, bad: str, tol: float = 0.0) -> str:
    return f"SELECT '{name}' AS check_name, count(CASE WHEN {bad} THEN 1 END) AS n_bad, count(*) AS n_total, count(CASE WHEN {bad} THEN 1 END) <= {tol} * count(*) AS passed FROM {source}"


_CHECKS = " UNION ALL ".join(
    [
        x
        for t, v in (("questions", "q"), ("answers", "a"), ("comments", "c"))
        for x in (
            _check(f"{t}.body_text is not empty", v, "trim(coalesce(body_text, '')) = ''"),
            _check(f"{t}.body_text has no entities", v, f"regexp_matches(body_text, '{_ENT}')", 0.001),
            _check(f"{t}.creation_date is known", v, "creation_date IS NULL"),
            _check(f"{t} owners have profiles", f"(SELECT DISTINCT owner_user_id FROM {v} WHERE owner_user_id IS NOT NULL) LEFT JOIN u ON user_id = owner_user_id", "user_id IS NULL"),
        )
    ]
    + [_check("questions.title is not empty", "q", "trim(coalesce(title, '')) = ''"), _check("questions.title has no entities", "q", f"regexp_matches(title, '{_ENT}')", 0.001)]
    + [
        x
        for t, v in (("answers", "a"), ("comments", "c"))
        for x in (
            _check(f"{t}.question_id is known", v, "question_id IS NULL"),
            _check(f"{t} lead to a question", f"{v} LEFT JOIN q ON {v}.question_id = q.question_id", f"{v}.question_id IS NOT NULL AND q.question_id IS NULL"),
            _check(f"{t} inherit is_react", f"{v} LEFT JOIN q ON {v}.question_id = q.question_id", f"{v}.is_react <> q.is_react"),
        )
    ]
)


@REGISTRY.query("audit_checks", f"WITH {Q}, {A}, {C}, {U} {_CHECKS}")
def audit_checks(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


@REGISTRY.query("audit_verdict", f"WITH {Q}, {A}, {C}, {U}, k AS ({_CHECKS}) SELECT bool_and(passed) AS passed, count(CASE WHEN NOT passed THEN 1 END) AS n_failed FROM k")
def audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    return verdict(_audit(spark, d))


@REGISTRY.query("downstream_sample", f"WITH {A} SELECT answer_id, score FROM a WHERE body_text <> '' ORDER BY score DESC NULLS LAST, answer_id LIMIT 5")
def downstream_sample(spark: SparkSession, d: str) -> DataFrame:
    """The five top-voted answers, a report; only keys and scores are sorted."""
    return answers(spark, d, "score", "body_text").where("body_text <> ''").orderBy(F.desc_nulls_last("score"), "answer_id").limit(5).select("answer_id", "score")


@REGISTRY.query("first_sentences", f"""WITH {A}, s AS (SELECT answer_id, string_split(regexp_replace(body_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM a)
SELECT answer_id, array_to_string(list_filter(s, lambda x: trim(x) <> '')[1:2], ' | ') AS head FROM s""")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first two sentences of every answer."""
    return answers(spark, d, "body_text").select("answer_id", F.array_join(sentences(F.col("body_text")), " | ").alias("head"))


@REGISTRY.query("data_sufficiency", f"WITH {Q}, {A}, {C} SELECT CAST(61000 AS BIGINT) AS target, (SELECT count(*) FROM a) * 61000 // count(*) AS answers, (SELECT count(*) FROM c) * 61000 // count(*) AS comments FROM q")
def data_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """Answers and comments to expect when 61,000 questions are collected."""
    n = lambda t, k: table(spark, d, t).agg(F.count_distinct(k)).scalar()
    q = table(spark, d, "questions").agg(F.count_distinct("question_id").alias("q"))
    at = lambda t, k: F.floor(n(t, k) * 61000 / F.col("q")).cast("bigint")
    return q.select(F.lit(61000).cast("bigint").alias("target"), at("answers", "answer_id").alias("answers"), at("comments", "comment_id").alias("comments"))


# --- rankings ------------------------------------------------------------------------


@REGISTRY.query("top_answers_of_question", f"""WITH {A} SELECT question_id, answer_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(is_accepted, 0) DESC, score DESC NULLS LAST, answer_id) AS rn FROM a WHERE question_id IS NOT NULL) WHERE rn <= 3""")
def top_answers_of_question(spark: SparkSession, d: str) -> DataFrame:
    """The best three answers of every question, accepted ones first; limited per group before the shuffle."""
    w = Window.partitionBy("question_id").orderBy(F.coalesce("is_accepted", F.lit(0)).desc(), F.desc_nulls_last("score"), "answer_id")
    return answers(spark, d, "question_id", "is_accepted", "score").where("question_id IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place <= 3").select("question_id", "answer_id", "place")


@REGISTRY.query("top_posts_of_user", f"""WITH {Q} SELECT owner_user_id AS user_id, question_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY score DESC NULLS LAST, question_id) AS rn FROM q WHERE owner_user_id IS NOT NULL) WHERE rn <= 5""")
def top_posts_of_user(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("owner_user_id").orderBy(F.desc_nulls_last("score"), "question_id")
    return questions(spark, d, "owner_user_id", "score").where("owner_user_id IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place <= 5").select(F.col("owner_user_id").alias("user_id"), "question_id", "place")


@REGISTRY.query("top_authorities", "SELECT user_id, round(authority_score, 6) AS authority_score FROM user_authority ORDER BY user_authority.authority_score DESC NULLS LAST, user_id LIMIT 10")
def top_authorities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "user_authority").orderBy(F.desc_nulls_last("authority_score"), "user_id").limit(10).select("user_id", F.round("authority_score", 6).alias("authority_score"))


@REGISTRY.query("landing_list", f"""WITH {Q}, g AS (SELECT DISTINCT 'q' || question_id AS group_id FROM canonical_index WHERE question_id IS NOT NULL)
SELECT group_id, coalesce(nullif(title, ''), group_id) AS title, score FROM g LEFT JOIN q ON q.question_id = TRY_CAST(substr(group_id, 2) AS BIGINT)""")  # fmt: skip
def landing_list(spark: SparkSession, d: str) -> DataFrame:
    """Groups with the title of the question their id names, best first, unknown last."""
    g = table(spark, d, "canonical_index").where("question_id IS NOT NULL").select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("group_id")).distinct()
    g = g.withColumn("question_id", F.expr("try_cast(substr(group_id, 2) AS bigint)"))
    q = questions(spark, d, "title", "score").select("question_id", "title", "score")
    return g.join(q, "question_id", "left").select("group_id", F.coalesce(F.nullif("title", F.lit("")), "group_id").alias("title"), "score").orderBy(F.desc_nulls_last("score"), "group_id")


@REGISTRY.query("vote_percentile", f"""WITH {A}, x AS (SELECT question_id, answer_id, coalesce(score, 0) AS v FROM a WHERE question_id IS NOT NULL),
 y AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n, rank() OVER (PARTITION BY question_id ORDER BY v) AS r, count(*) OVER (PARTITION BY question_id, v) AS s FROM x)
SELECT question_id, answer_id, round(CASE WHEN n = 1 THEN 1.0 ELSE (r - 1 + (s - 1) / 2) / (n - 1) END, 6) AS q FROM y""")  # fmt: skip
def vote_percentile(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d, "question_id", "score").where("question_id IS NOT NULL").withColumn("v", F.coalesce("score", F.lit(0)))
    return a.select("question_id", "answer_id", F.round(average_rank_percentile(["question_id"], "v"), 6).alias("q"))


@REGISTRY.query("rank_percentile", "SELECT user_id, round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1) / (n - 1) END, 6) AS percentile FROM (SELECT user_id, row_number() OVER (ORDER BY comp_pagerank, user_id) AS rn, count(*) OVER () AS n FROM user_authority WHERE comp_pagerank > 0)")
def rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percentile of every user with a positive score, over all users, by a distributed sort."""
    ua = table(spark, d, "user_authority").where("comp_pagerank > 0").select("user_id", "comp_pagerank")
    return global_percentile(ua, "comp_pagerank", "user_id", "p").select("user_id", F.round("p", 6).alias("percentile"))


@REGISTRY.query("cdf", "SELECT reputation, CAST(sum(n) OVER (ORDER BY reputation) AS BIGINT) AS upto FROM (SELECT reputation, count(*) AS n FROM user_authority WHERE reputation IS NOT NULL GROUP BY 1)")
def cdf(spark: SparkSession, d: str) -> DataFrame:
    """Empirical distribution: users up to each reputation, from the weighted distinct values, by a distributed running sum."""
    from palaver.sources.materialize import materialize

    n = table(spark, d, "user_authority").where("reputation IS NOT NULL").groupBy("reputation").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(n.repartitionByRange("reputation").sortWithinPartitions("reputation").withColumn("part", F.spark_partition_id()), "cdf")
    sums = held.groupBy("part").agg(F.sum("n").alias("s"))  # one row per task
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("reputation").rowsBetween(Window.unboundedPreceding, 0))
    return held.join(F.broadcast(before), "part").select("reputation", upto.alias("upto"))


@REGISTRY.query("fused_weight", f"""WITH {A}, x AS (SELECT question_id, answer_id, owner_user_id, coalesce(score, 0) AS v FROM a WHERE question_id IS NOT NULL),
 y AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n, rank() OVER (PARTITION BY question_id ORDER BY v) AS r, count(*) OVER (PARTITION BY question_id, v) AS s FROM x),
 z AS (SELECT answer_id, owner_user_id, CASE WHEN n = 1 THEN 1.0 ELSE (r - 1 + (s - 1) / 2) / (n - 1) END AS q FROM y)
SELECT answer_id, round(CASE WHEN comp_pagerank IS NULL THEN q ELSE sqrt(q * greatest(comp_pagerank, 0.05)) END, 6) AS weight,
       CASE WHEN comp_pagerank IS NOT NULL THEN 'scored' WHEN owner_user_id IS NULL THEN 'anonymous' ELSE 'non_interactive' END AS authority_status
FROM z LEFT JOIN user_authority ua ON ua.user_id = z.owner_user_id""")  # fmt: skip
def fused(spark: SparkSession, d: str) -> DataFrame:
    """Answer weight from vote percentile and authority, and why an authority is absent."""
    a = answers(spark, d, "question_id", "owner_user_id", "score").where("question_id IS NOT NULL").withColumn("v", F.coalesce("score", F.lit(0)))
    q = a.withColumn("q", average_rank_percentile(["question_id"], "v"))
    j = q.join(table(spark, d, "user_authority").select(F.col("user_id").alias("owner_user_id"), "comp_pagerank"), "owner_user_id", "left")
    status = F.when(F.col("comp_pagerank").isNotNull(), "scored").when(F.col("owner_user_id").isNull(), "anonymous").otherwise("non_interactive")
    return j.select("answer_id", F.round(fused_weight(F.col("q"), F.col("comp_pagerank")), 6).alias("weight"), status.alias("authority_status"))


@REGISTRY.query("vote_authority", f"WITH {A} SELECT answer_id, round(ln(1 + greatest(coalesce(score, 0), 0)) + CASE WHEN is_accepted = 1 THEN 0.5 ELSE 0.0 END + 0.5, 6) AS score FROM a")
def vote_authority_query(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d, "score", "is_accepted").select("answer_id", F.round(vote_authority(F.coalesce("score", F.lit(0)), F.col("is_accepted") == 1), 6).alias("score"))


@REGISTRY.query("answer_bodies", f"WITH {A} SELECT answer_id, length(coalesce(nullif(body_text, ''), body, '')) AS n_chars FROM a")
def answer_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Length of each answer's text, falling back to its HTML."""
    text = F.coalesce(F.nullif("body_text", F.lit("")), "body", F.lit(""))
    return answers(spark, d, "body", "body_text").select("answer_id", F.length(text).cast("bigint").alias("n_chars"))
