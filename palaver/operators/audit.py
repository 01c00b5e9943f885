"""Data audit: every check is a row (check_name, n_bad, n_total, passed); a table is read once for all of its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import ENTITY

DIRTY_TOLERANCE = 0.001
FLAGS = ("is_react",)

# fixed values: the columns that the tables should have beside their flags
EXPECTED = {
    "questions": ("question_id", "title", "body", "body_text", "tags", "score", "view_count", "answer_count", "creation_date", "owner_user_id", "owner_display_name", "link", "is_closed", "closed_reason"),
    "answers": ("answer_id", "question_id", "body", "body_text", "score", "is_accepted", "creation_date", "owner_user_id", "owner_display_name"),
    "comments": ("comment_id", "post_id", "post_type", "question_id", "body", "body_text", "score", "creation_date", "owner_user_id", "owner_display_name", "reply_to_user_id"),
    "users": ("user_id", "display_name", "reputation", "badge_gold", "badge_silver", "badge_bronze", "creation_date", "link"),
    "interactions": ("id", "source_user_id", "target_user_id", "interaction_type", "post_id", "parent_post_id", "creation_date"),
}


def checks(df: DataFrame, rules: Mapping[str, Column | tuple[Column, float]]) -> DataFrame:
    """One row per rule: how many rows of ``df`` are bad, of how many, and whether that is within the tolerance (0).

    All rules are counted in one aggregation.  A rule that is null for a row does
    not apply to it but counts in the total.  An empty table passes.
    """
    held = {name: rule if isinstance(rule, tuple) else (rule, 0.0) for name, rule in rules.items()}
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(bad, 1)).alias(f"c{i}") for i, (bad, _) in enumerate(held.values())])
    row = lambda i, name, tol: F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("n_bad"), F.col("n").alias("n_total"), (F.col(f"c{i}") <= F.lit(tol) * F.col("n")).alias("passed"))
    return counts.select(F.explode(F.array(*[row(i, name, tol) for i, (name, (_, tol)) in enumerate(held.items())])).alias("r")).select("r.*")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Columns that the table should have and has not."""
    return sorted(set(wanted) - set(df.columns))


def schema_report(tables: Mapping[str, DataFrame | None], flags: Sequence[str] = FLAGS) -> list[tuple[str, str, bool]]:
    """(table, missing columns, complete) of every expected table; one that is absent lacks all.  No data is read."""
    out = []
    for name, columns in EXPECTED.items():
        wanted = [*columns, *(flags if name != "users" else ())]
        df = tables.get(name)
        gone = sorted(wanted) if df is None else missing_columns(df, wanted)
        out.append((name, ",".join(gone), not gone))
    return out


def unflagged(flags: Sequence[str] = FLAGS) -> Column:
    """Whether a row has none of the flags; a null flag leaves it open."""
    return reduce(lambda a, b: a + b, [F.col(f) for f in flags]) == 0


def unlike(left: Mapping[str, Column], right: Mapping[str, Column]) -> Column:
    """Whether any flag differs from its counterpart; a null on either side does not differ."""
    return reduce(lambda a, b: a | b, [F.coalesce(left[f] != right[f], F.lit(False)) for f in left])


def _dirty(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(ENTITY), F.lit(False))


def _empty(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def owners_without_profile(tables: Mapping[str, DataFrame], users: DataFrame) -> DataFrame:
    """Per table: its distinct owners, and how many of them have no profile; one pass over all tables."""
    owners = reduce(DataFrame.unionByName, [df.where("owner_user_id IS NOT NULL").select(F.lit(name).alias("name"), F.col("owner_user_id").alias("user_id")) for name, df in tables.items()]).distinct()
    known = owners.join(users.select("user_id", F.lit(True).alias("known")).distinct(), "user_id", "left")
    per = known.groupBy("name").agg(F.count(F.when(F.col("known").isNull(), 1)).alias("n_bad"), F.count(F.lit(1)).alias("n_total"))
    names = users.sparkSession.createDataFrame([(n,) for n in tables], "name string")
    every = names.join(per, "name", "left").na.fill(0, ["n_bad", "n_total"])
    return every.select(F.concat("name", F.lit(" owners have profiles")).alias("check_name"), "n_bad", "n_total", (F.col("n_bad") == 0).alias("passed"))


def audit(questions: DataFrame, answers: DataFrame, comments: DataFrame, users: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Body and title cleanliness, null and dangling keys, flag inheritance and missing profiles, over first rows."""
    tables = {"questions": questions, "answers": answers, "comments": comments}

    def common(name: str) -> dict:
        return {
            f"{name}.body_text is not empty": _empty("body_text"),
            f"{name}.body_text has no entities": (_dirty("body_text"), DIRTY_TOLERANCE),
            f"{name}.creation_date is known": F.col("creation_date").isNull(),
        }

    titles = {"questions.title is not empty": _empty("title"), "questions.title has no entities": (_dirty("title"), DIRTY_TOLERANCE)}
    out = [checks(questions, common("questions") | titles), owners_without_profile(tables, users)]
    parents = questions.select("question_id", *[F.col(f).alias(f"q_{f}") for f in flags], F.lit(True).alias("known"))
    for name in ("answers", "comments"):
        own, above = {f: F.col(f) for f in flags}, {f: F.col(f"q_{f}") for f in flags}
        lead = {
            f"{name}.question_id is known": F.col("question_id").isNull(),
            f"{name} lead to a question": F.col("question_id").isNotNull() & F.col("known").isNull(),
            f"{name} inherit is_react": unlike(own, above),
        }
        out.append(checks(tables[name].join(parents, "question_id", "left"), common(name) | lead))
    return reduce(DataFrame.unionByName, out)


def readiness(questions: DataFrame, answers: DataFrame, comments: DataFrame, users: DataFrame, interactions: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """The fourteen readiness checks: flags, keys, texts, edges, profiles, entities, and that code was marked.

    'users are there' and 'code was marked' are bad once if nothing is found.
    """
    none = unflagged(flags)
    entity = F.coalesce(F.col("title").contains("&#") | F.col("title").contains("&amp;") | F.col("title").contains("&quot;"), F.lit(False))
    q = checks(questions, {
        "questions have a flag": none, "questions have a text": F.coalesce("body_text", F.lit("")) == "",
        "titles have no entities": entity, "question texts have no entities": _dirty("body_text"),
    })
    a = checks(answers, {"answers have a flag": none, "answers have a text": F.coalesce("body_text", F.lit("")) == ""})
    c = checks(comments, {"comments have a flag": none, "comments have a question": F.col("question_id").isNull()})
    i = checks(interactions, {
        "edges have two users": F.col("source_user_id").isNull() | F.col("target_user_id").isNull(),
        "edges are no loops": F.col("source_user_id") == F.col("target_user_id"), "edges have a flag": none,
    })
    ends = interactions.select(F.explode(F.array("source_user_id", "target_user_id")).alias("user_id")).where("user_id IS NOT NULL").distinct()
    known = users.select("user_id", F.lit(True).alias("known")).distinct()
    profiles = checks(ends.join(known, "user_id", "left"), {"edge users have profiles": F.col("known").isNull()})

    def found(df: DataFrame, name: str, good: Column) -> DataFrame:
        n = F.count(F.when(good, 1))
        return df.agg(n.alias("n"), F.count(F.lit(1)).alias("n_total")).select(F.lit(name).alias("check_name"), (F.col("n") == 0).cast("bigint").alias("n_bad"), "n_total", (F.col("n") > 0).alias("passed"))

    there = found(users, "users are there", F.lit(True))
    marked = found(questions, "code was marked", F.col("body_text").contains("[CODE]"))
    return reduce(DataFrame.unionByName, [q, a, c, i, profiles, there, marked])


def verdict(checks: DataFrame) -> DataFrame:
    """One row: whether all checks passed, and how many did not."""
    return checks.agg(F.bool_and("passed").alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("n_failed"))


def require(**tables: DataFrame) -> None:
    """Raise with the names of all given inputs that have no rows, before anything runs on them."""
    if empty := sorted(name for name, df in tables.items() if not df.take(1)):
        raise ValueError(f"nothing in {', '.join(empty)}: run the stages before first")
