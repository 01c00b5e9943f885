"""Queries of the general training-data operators: features, orphans, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.text import month_of
from palaver.operators.features import entity_features, entity_lines, pick, utc_year
from palaver.operators.orphans import micros, orphan_references, report
from palaver.operators.skew import heavy_keys, key_summary
from palaver.plans.registry import Registry
from palaver.sources.tables import first, table

REGISTRY = Registry()
POST_KINDS = ("accepted", "answer", "question")
HEAVY_SHARE = 0.02
FRACTIONS = {"p50": 0.5, "p90": 0.9}

# first rows in SQL; rows that tie are equal
_Q1 = "q1 AS (SELECT question_id, arg_min(struct_pack(tags := tags, score := score, creation_date := creation_date, owner := owner_user_id, at := collected_at), collected_at) r FROM questions GROUP BY 1)"
_A1 = "a1 AS (SELECT answer_id, arg_min(struct_pack(question_id := question_id, score := score, is_accepted := is_accepted, creation_date := creation_date, owner := owner_user_id, at := collected_at), collected_at) r FROM answers GROUP BY 1)"
_C1 = "c1 AS (SELECT comment_id, arg_min(struct_pack(reply := reply_to_user_id, creation_date := creation_date, at := collected_at), collected_at) r FROM comments GROUP BY 1)"
_YEAR = "CAST(year(make_timestamp({0} * 1000000)) AS INTEGER)"
_MONTH = "strftime(make_timestamp({0} * 1000000), '%Y-%m')"


# --- 1: features ------------------------------------------------------------


def _posts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = first(spark, d, "questions", "owner_user_id", "score", "creation_date", "tags")
    a = first(spark, d, "answers", "owner_user_id", "score", "creation_date", "is_accepted", "question_id")
    return q, a


def _event(kind: str, df: DataFrame, value: str | None = "score", entity: str = "owner_user_id") -> DataFrame:
    return df.select(
        F.nullif(entity, F.lit(0)).alias("entity_id"),
        F.lit(kind).alias("kind"),
        (F.col(value) if value else F.lit(None)).cast("bigint").alias("value"),
        F.col("creation_date").alias("at"),
    )


def post_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of owned first rows: 'question', 'answer' (valued by score) and 'accepted'."""
    q, a = _posts(spark, d)
    owned = F.nullif("owner_user_id", F.lit(0)).alias("entity_id")
    kinds = F.when(F.col("is_accepted") == 1, F.array(F.lit("answer"), F.lit("accepted"))).otherwise(F.array(F.lit("answer")))
    answered = a.select(owned, F.explode(kinds).alias("kind"), F.col("score").alias("value"), F.col("creation_date").alias("at"))
    return answered.unionByName(_event("question", q))


def base_features(wide: DataFrame, kinds: tuple[str, ...] = POST_KINDS) -> DataFrame:
    """The four totals of TESTDATA.md from a feature table over ``kinds``."""
    last = F.greatest(pick(kinds, "last", "answer"), pick(kinds, "last", "question"))
    return wide.select(
        F.col("entity_id").alias("user_id"),
        pick(kinds, "n", "answer").alias("answer_count"),
        pick(kinds, "n", "accepted").alias("accepted_answer_count"),
        pick(kinds, "total", "answer").alias("total_answer_score"),
        utc_year(last).alias("last_activity_year"),
    )


_EXPECTED = f"""
  {_Q1}, {_A1},
  ev AS (SELECT r.owner AS user_id, 1 AS a, CASE WHEN r.is_accepted = 1 THEN 1 ELSE 0 END AS acc, coalesce(r.score, 0) AS s, r.creation_date AS t FROM a1
         UNION ALL SELECT r.owner, 0, 0, 0, r.creation_date FROM q1),
  feat AS (SELECT user_id, CAST(sum(a) AS BIGINT) answer_count, CAST(sum(acc) AS BIGINT) accepted_answer_count,
                  CAST(sum(s) AS BIGINT) total_answer_score, {_YEAR.format("max(t)")} last_activity_year
           FROM ev WHERE user_id <> 0 GROUP BY 1)"""


@REGISTRY.query(
    "p1_found",
    f"""WITH {_EXPECTED}, ua AS (SELECT * FROM user_authority WHERE user_id <> 0)
SELECT coalesce(f.user_id, u.user_id) AS user_id
FROM feat f FULL JOIN ua u ON f.user_id = u.user_id
WHERE u.user_id IS NULL
   OR u.answer_count IS DISTINCT FROM coalesce(f.answer_count, 0)
   OR u.accepted_answer_count IS DISTINCT FROM coalesce(f.accepted_answer_count, 0)
   OR u.total_answer_score IS DISTINCT FROM coalesce(f.total_answer_score, 0)
   OR u.last_activity_year IS DISTINCT FROM f.last_activity_year""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Users whose row in user_authority is absent or differs from the features of the first rows."""
    want = base_features(entity_features(post_events(spark, d), POST_KINDS))
    names = ("answer_count", "accepted_answer_count", "total_answer_score", "last_activity_year")
    have = table(spark, d, "user_authority").where(F.col("user_id") != 0).select("user_id", *[F.col(c).alias(f"have_{c}") for c in names], F.lit(True).alias("known"))
    both = want.join(have, "user_id", "full_outer")
    wanted = lambda c: F.col(c) if c == "last_activity_year" else F.coalesce(c, F.lit(0))
    same = F.col("known").isNotNull()
    for c in names:
        same &= F.col(f"have_{c}").eqNullSafe(wanted(c))
    return both.where(~same).select("user_id").distinct()


@REGISTRY.query("p1_base", f"WITH {_EXPECTED} SELECT * FROM feat")
def p1_base(spark: SparkSession, d: str) -> DataFrame:
    """The four totals of every user that owns a first row of questions or answers."""
    return base_features(entity_features(post_events(spark, d), POST_KINDS))


def all_events(spark: SparkSession, d: str) -> DataFrame:
    """Posts, each kind of interaction made or received, and each tag of a question asked or answered.

    A tag counts once per post, in lower case without blanks at the ends.
    Interactions have no score; odd kinds count under their own name.
    """
    q, a = _posts(spark, d)
    tags = F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    named = F.transform(F.filter(tags, lambda t: t.isNotNull() & (t != "")), lambda t: F.concat(F.lit("tag:"), t))
    q = q.withColumn("tags", named)
    answered = a.join(q.select("question_id", "tags"), "question_id", "left")  # an answer to no question has no tags
    none = F.array().cast("array<string>")
    own = F.when(F.col("is_accepted") == 1, F.array(F.lit("answer"), F.lit("accepted"))).otherwise(F.array(F.lit("answer")))
    at = [F.col("score").alias("value"), F.col("creation_date").alias("at")]
    owner = F.nullif("owner_user_id", F.lit(0)).alias("entity_id")
    posts = q.select(owner, F.explode(F.concat(F.array(F.lit("question")), "tags")).alias("kind"), *at).unionByName(
        answered.select(owner, F.explode(F.concat(own, F.coalesce("tags", none))).alias("kind"), *at)
    )
    edges = table(spark, d, "interactions").select(
        F.explode(
            F.array(
                F.struct(F.nullif("source_user_id", F.lit(0)).alias("entity_id"), F.concat(F.lit("made:"), "interaction_type").alias("kind")),
                F.struct(F.nullif("target_user_id", F.lit(0)).alias("entity_id"), F.concat(F.lit("got:"), "interaction_type").alias("kind")),
            )
        ).alias("e"),
        "creation_date",
    )
    made = edges.select("e.entity_id", "e.kind", F.lit(None).cast("bigint").alias("value"), F.col("creation_date").alias("at"))
    return posts.unionByName(made)


@REGISTRY.query(
    "p1_features",
    f"""WITH {_Q1}, {_A1},
  qt AS (SELECT question_id, list_distinct(list_filter(list_transform(r.tags, lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '')) AS tags,
                r.owner AS owner, r.score AS score, r.creation_date AS cd FROM q1),
  ev AS (SELECT r.owner AS u, 'answer' AS kind, r.score AS v, r.creation_date AS cd FROM a1
   UNION ALL SELECT r.owner, 'accepted', r.score, r.creation_date FROM a1 WHERE r.is_accepted = 1
   UNION ALL SELECT owner, 'question', score, cd FROM qt
   UNION ALL SELECT source_user_id, 'made:' || interaction_type, NULL, creation_date FROM interactions
   UNION ALL SELECT target_user_id, 'got:' || interaction_type, NULL, creation_date FROM interactions
   UNION ALL SELECT owner, 'tag:' || unnest(tags), score, cd FROM qt
   UNION ALL SELECT a1.r.owner, 'tag:' || unnest(qt.tags), a1.r.score, a1.r.creation_date FROM a1 JOIN qt ON a1.r.question_id = qt.question_id),
  st AS (SELECT u, kind, count(*) n, coalesce(sum(v), 0) s, max(cd) t FROM ev WHERE u <> 0 AND kind IS NOT NULL GROUP BY 1, 2),
  kinds AS (SELECT DISTINCT kind FROM st), us AS (SELECT DISTINCT u FROM st)
SELECT us.u AS user_id,
       string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY kinds.kind) AS counts,
       string_agg(CAST(coalesce(s, 0) AS VARCHAR), ',' ORDER BY kinds.kind) AS totals,
       string_agg(coalesce(CAST(year(make_timestamp(t * 1000000)) AS VARCHAR), '-'), ',' ORDER BY kinds.kind) AS years
FROM us CROSS JOIN kinds LEFT JOIN st ON st.u = us.u AND st.kind = kinds.kind GROUP BY 1""",
)
def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per user: count, score total and latest year along the complete sorted list of kinds, as text lists."""
    lines = entity_lines(all_events(spark, d), utc_year(F.col("last")))
    return lines.select(F.col("entity_id").alias("user_id"), F.col("n").alias("counts"), F.col("total").alias("totals"), F.col("last").alias("years"))


# --- 4: orphan references ----------------------------------------------------


def references(spark: SparkSession, d: str) -> DataFrame:
    """Non-null references of first rows to questions and users, with time and month of the referring record."""
    month = month_of(F.col("creation_date")).alias("month")

    def of(df: DataFrame, record: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(dom).alias("domain"), F.lit(name).alias("ref_field"), F.col(col).alias("key")) for name, (dom, col) in fields.items()]))
        return df.select(each.alias("f"), F.col(record).alias("record_id"), micros(F.col("collected_at")).alias("at"), month).select("f.*", "record_id", "at", "month").where(F.col("key").isNotNull())

    a = first(spark, d, "answers", "question_id", "owner_user_id", "creation_date")
    c = first(spark, d, "comments", "reply_to_user_id", "creation_date")
    return of(a, "answer_id", {"answers.question_id": ("questions", "question_id"), "answers.owner_user_id": ("users", "owner_user_id")}).unionByName(
        of(c, "comment_id", {"comments.reply_to_user_id": ("users", "reply_to_user_id")})
    )


def _parents(spark: SparkSession, d: str) -> DataFrame:
    at = micros(F.col("collected_at")).alias("at")
    return (
        table(spark, d, "questions").select(F.lit("questions").alias("domain"), F.col("question_id").alias("key"), at)
        .unionByName(table(spark, d, "users").select(F.lit("users").alias("domain"), F.col("user_id").alias("key"), at))
    )


def misses(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan or early reference of the three fields."""
    return orphan_references(references(spark, d), _parents(spark, d), ("questions", "users"))


_MISSES = f"""
  {_A1}, {_C1},
  refs AS (SELECT 'questions' AS dom, 'answers.question_id' AS ref_field, answer_id AS record_id, r.question_id AS key, r.at AS at, {_MONTH.format("r.creation_date")} AS month FROM a1
     UNION ALL SELECT 'users', 'answers.owner_user_id', answer_id, r.owner, r.at, {_MONTH.format("r.creation_date")} FROM a1
     UNION ALL SELECT 'users', 'comments.reply_to_user_id', comment_id, r.reply, r.at, {_MONTH.format("r.creation_date")} FROM c1),
  tops AS (SELECT 'questions' AS dom, question_id AS key, min(collected_at) AS at FROM questions GROUP BY 2
     UNION ALL SELECT 'users', user_id, min(collected_at) FROM users GROUP BY 2),
  misses AS (SELECT refs.ref_field, refs.record_id, refs.month, CASE WHEN tops.key IS NULL THEN 'missing' ELSE 'late' END AS fault
             FROM refs LEFT JOIN tops ON refs.dom = tops.dom AND refs.key = tops.key
             WHERE refs.key IS NOT NULL AND (tops.key IS NULL OR tops.at > refs.at))"""


@REGISTRY.query("p4_found", f"WITH {_MISSES} SELECT ref_field, record_id, fault FROM misses")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per faulty reference."""
    return misses(spark, d).select("ref_field", "record_id", "fault")


@REGISTRY.query("p4_report", f"WITH {_MISSES} SELECT ref_field, month, fault, count(*) AS n FROM misses GROUP BY 1, 2, 3")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Faulty references per field, month of the referring record and kind of fault."""
    return report(misses(spark, d))


# --- 6: heavy keys -----------------------------------------------------------


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Rows as stored: answers by owner valued by score, interactions by target valued by source."""
    a = table(spark, d, "answers").select(F.lit("answers.owner_user_id").alias("key_field"), F.col("owner_user_id").alias("user_id"), F.col("score").alias("value"))
    i = table(spark, d, "interactions").select(F.lit("interactions.target_user_id").alias("key_field"), F.col("target_user_id").alias("user_id"), F.col("source_user_id").alias("value"))
    return a.unionByName(i)


_KEYED = """keyed AS (SELECT 'answers.owner_user_id' AS key_field, owner_user_id AS user_id, score AS value FROM answers
   UNION ALL SELECT 'interactions.target_user_id', target_user_id, source_user_id FROM interactions)"""


@REGISTRY.query(
    "p6_found",
    f"""WITH {_KEYED}, tot AS (SELECT key_field, count(*) AS total FROM keyed GROUP BY 1)
SELECT key_field, user_id FROM keyed JOIN tot USING (key_field) WHERE user_id IS NOT NULL
GROUP BY 1, 2, total HAVING count(*) * 50 >= total""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Users holding at least 2 percent of all stored rows of a table."""
    found = []
    for name in ("answers.owner_user_id", "interactions.target_user_id"):
        summary = key_summary(_keyed(spark, d).where(F.col("key_field") == name), ["key_field", "user_id"], "value")
        total = table(spark, d, name.split(".")[0]).agg(F.count(F.lit(1)))
        found.append(heavy_keys(summary, total, HEAVY_SHARE).select("key_field", "user_id"))
    return found[0].unionByName(found[1])


@REGISTRY.query(
    "p6_key_stats",
    f"""WITH {_KEYED}, w AS (SELECT key_field, user_id, value, count(*) AS weight FROM keyed WHERE user_id IS NOT NULL GROUP BY 1, 2, 3),
  ok AS (SELECT *, sum(weight) OVER (PARTITION BY key_field, user_id ORDER BY value) AS upto, sum(weight) OVER (PARTITION BY key_field, user_id) AS total,
                row_number() OVER (PARTITION BY key_field, user_id ORDER BY weight DESC, value) AS rn FROM w WHERE value IS NOT NULL),
  pct AS (SELECT key_field, user_id, CAST(sum(weight) AS BIGINT) AS n_values, count(*) AS n_distinct, min(CASE WHEN rn = 1 THEN value END) AS mode,
                 min(CASE WHEN upto >= ceil(0.5 * total) THEN value END) AS p50, min(CASE WHEN upto >= ceil(0.9 * total) THEN value END) AS p90 FROM ok GROUP BY 1, 2),
  allk AS (SELECT key_field, user_id, CAST(sum(weight) AS BIGINT) AS n FROM w GROUP BY 1, 2)
SELECT key_field, user_id, n, coalesce(n_values, 0) AS n_values, coalesce(n_distinct, 0) AS n_distinct, mode, p50, p90 FROM allk LEFT JOIN pct USING (key_field, user_id)""",
)
def p6_key_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per user and table: rows, exact distinct values, mode and exact percentiles of score or source user."""
    return key_summary(_keyed(spark, d), ["key_field", "user_id"], "value", FRACTIONS)
