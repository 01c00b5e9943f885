"""Queries of practices, groups, the resolver, write semantics, audits and display values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.text import query_text
from palaver.operators import practices as ops
from palaver.operators.audit import EXPECTED, FLAGS, readiness, schema_report
from palaver.operators.resolver import Resolution, resolve
from palaver.operators.retrieval import dot, unit
from palaver.plans import landscape
from palaver.plans.network import _ALL, _centralities
from palaver.plans.registry import Registry
from palaver.plans.relational import answers, comments, questions
from palaver.plans.sqltext import PRACTICES, A, C, Q, U
from palaver.plans.textual import EVIDENCE
from palaver.sources.materialize import materialize
from palaver.sources.tables import first, table
from palaver.sources.writers import insert_or_replace, replace_groups, undone, update_columns

REGISTRY = Registry()

# --- practices of answers ----------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_LONG = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: len(w) >= 4)"
SENTENCES = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_EXTRACT = f"""{Q}, {A}, an AS (SELECT answer_id, a.question_id, q.title, coalesce(a.body_text, '') AS text FROM a JOIN q ON q.question_id = a.question_id),
  sd AS (SELECT answer_id, question_id, title, {EVIDENCE} AS evidence_type, list_filter({SENTENCES.format("text")}, lambda s: len({_WORDS.format("s")}) >= 3) AS said FROM an),
  ea AS (SELECT answer_id, question_id, title, evidence_type, unnest(said) AS s, generate_subscripts(said, 1) - 1 AS practice_rank FROM sd),
  ex AS (SELECT answer_id, question_id, practice_rank, s AS practice_sentence, array_to_string(regexp_extract_all(s, '(?i)\\b((?:if|when|unless) [^,.;!?]+)', 1)[1:3], '|') AS conditions, evidence_type,
    CAST(list_has_any({_LONG.format("s")}, {_LONG.format("title")}) AS INTEGER) AS relevant, CAST(len({_WORDS.format("s")}) >= 6 AS INTEGER) AS substantive FROM ea)"""


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Practices of all answers whose question is there."""
    titled = answers(spark, d, "question_id", "body_text").join(questions(spark, d, "title").select("question_id", F.col("title").alias("parent_title")), "question_id")
    return ops.extract(titled)


@REGISTRY.query("practice_extractions", f"WITH {_EXTRACT} SELECT answer_id, CAST(practice_rank AS INTEGER) AS practice_rank, practice_sentence, conditions, evidence_type, relevant, substantive FROM ex")
def practice_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate practice with rank, up to three conditions, evidence and flags."""
    return extracted(spark, d).withColumn("conditions", F.array_join("conditions", "|"))


@REGISTRY.query("kept_practices", f"WITH {_EXTRACT} SELECT question_id, answer_id, CAST(practice_rank AS INTEGER) AS practice_rank, practice_sentence FROM ex WHERE relevant = 1 AND substantive = 1")
def kept_practices(spark: SparkSession, d: str) -> DataFrame:
    """Relevant and substantive practices, joined to the answers of their question."""
    kept = extracted(spark, d).where(ops.is_kept(F.col("relevant"), F.col("substantive")))
    return kept.join(answers(spark, d, "question_id").select("answer_id", "question_id"), "answer_id").select("question_id", "answer_id", "practice_rank", "practice_sentence")


@REGISTRY.query("evidence_histogram", f"WITH {_EXTRACT} SELECT evidence_type, count(*) AS practices, count(CASE WHEN relevant = 1 AND substantive = 1 THEN 1 END) AS kept FROM ex GROUP BY 1")
def evidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    kept = F.count(F.when(ops.is_kept(F.col("relevant"), F.col("substantive")), 1)).alias("kept")
    return extracted(spark, d).groupBy("evidence_type").agg(F.count(F.lit(1)).alias("practices"), kept)


@REGISTRY.query("unmatched_practices", f"""WITH {_EXTRACT}, m AS (SELECT owner_user_id IS NOT NULL AS ok FROM ex JOIN a USING (answer_id))
SELECT count(CASE WHEN ok THEN 1 END) AS matched, count(CASE WHEN NOT ok THEN 1 END) AS unmatched FROM m""")  # fmt: skip
def unmatched_practices(spark: SparkSession, d: str) -> DataFrame:
    """Practices of owned answers, and how many others are dropped."""
    met, rest = ops.matched(extracted(spark, d), answers(spark, d, "owner_user_id").where("owner_user_id IS NOT NULL"))
    return rest.select(met.agg(F.count(F.lit(1))).scalar().alias("matched"), "unmatched")


# groups by asker: a question is a member by its score, or without judgement where it has none
_GROUPS = "CASE WHEN score IS NULL THEN NULL WHEN score >= 3 THEN 'equivalent' WHEN score >= 1 THEN 'borderline' ELSE 'not_equivalent' END"


@REGISTRY.query("pooled_answers", f"""WITH {Q}, {A}, {U}, g AS (SELECT owner_user_id AS group_id, question_id, {_GROUPS} AS gate_decision FROM q WHERE owner_user_id IS NOT NULL)
SELECT g.group_id, a.answer_id, a.question_id, q.title AS parent_title, coalesce(a.body_text, '') AS body_text, a.score AS vote, a.is_accepted, a.owner_user_id AS author_id, u.reputation
FROM g JOIN a ON a.question_id = g.question_id JOIN q ON q.question_id = a.question_id LEFT JOIN u ON u.user_id = a.owner_user_id WHERE gate_decision IS NULL OR gate_decision = 'equivalent'""")  # fmt: skip
def pooled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the member questions of every group, with parent title and author's reputation."""
    q = questions(spark, d, "owner_user_id", "score", "title")
    score = F.col("score")
    decision = F.when(score.isNull(), F.lit(None)).when(score >= 3, "equivalent").when(score >= 1, "borderline").otherwise("not_equivalent")
    groups = q.where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("group_id"), "question_id", decision.alias("gate_decision"))
    a = answers(spark, d, "question_id", "body_text", "score", "is_accepted", "owner_user_id")
    return ops.pooled_answers(groups, a, q, first(spark, d, "users", "reputation"))


_NAMED = "n0 AS (SELECT group_id, camp_id AS cluster, sentence FROM p WHERE camp_id IS NOT NULL)"


@REGISTRY.query("cluster_names", f"""WITH {PRACTICES}, {_NAMED}, w AS (SELECT group_id, cluster, unnest(list_distinct({_WORDS.format("sentence")})) AS word FROM n0),
  pw AS (SELECT group_id, cluster, word, count(*) AS n FROM w GROUP BY 1, 2, 3), wd AS (SELECT group_id, word, count(*) AS clusters FROM pw GROUP BY 1, 2),
  tp AS (SELECT *, row_number() OVER (PARTITION BY group_id, cluster ORDER BY clusters, n DESC, word) AS k FROM pw JOIN wd USING (group_id, word)),
  lb AS (SELECT group_id, cluster, string_agg(word, ' ' ORDER BY k) AS label FROM tp WHERE k <= 3 GROUP BY 1, 2),
  nm AS (SELECT *, row_number() OVER (PARTITION BY group_id, label ORDER BY cluster) AS again FROM lb), ds AS (SELECT group_id, cluster, min(sentence) AS description FROM n0 GROUP BY 1, 2)
SELECT group_id, cluster, CASE WHEN again = 1 THEN label ELSE label || ' ·' || again END AS name, description FROM ds JOIN nm USING (group_id, cluster)""")  # fmt: skip
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of all clusters by the words that tell them apart."""
    p = landscape.held(spark, d).where("camp_id IS NOT NULL")
    return ops.cluster_names(p.select("group_id", F.col("camp_id").alias("cluster"), "sentence"))


@REGISTRY.query("longtail_companions", f"""WITH {PRACTICES}, s AS (SELECT group_id, camp_id, count(*) AS n FROM p WHERE camp_id IS NOT NULL GROUP BY 1, 2)
SELECT p.group_id, ext_id AS idx, CASE WHEN n >= 2 THEN p.camp_id END AS cluster, answer_id AS companion FROM p JOIN s ON s.group_id = p.group_id AND s.camp_id = p.camp_id""")  # fmt: skip
def longtail_companions(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of every clustered practice - none where it is alone - beside its companion label, here the answer it is from."""
    p = landscape.held(spark, d)
    clusters = p.where("camp_id IS NOT NULL").select("group_id", F.col("ext_id").alias("idx"), F.col("camp_id").alias("cluster"))
    return ops.assign(clusters, p.select("group_id", F.col("ext_id").alias("idx"), F.col("answer_id").alias("companion")))


_MEMBERS = "mb AS (SELECT group_id, camp_id AS cluster, list(answer_id ORDER BY answer_id) AS members, count(*) AS n FROM (SELECT DISTINCT group_id, camp_id, answer_id FROM p WHERE camp_id IS NOT NULL) GROUP BY 1, 2)"


@REGISTRY.query("cluster_renames", f"WITH {PRACTICES}, {_MEMBERS} SELECT group_id, cluster, CASE WHEN n > 1 THEN 'pair of ' || members[1] || ' and ' || members[n] ELSE 'camp ' || cluster END AS name, n > 1 AS renamed FROM mb")
def cluster_renames(spark: SparkSession, d: str) -> DataFrame:
    """Names of clusters from a sidecar that lists their members in another order."""
    m = landscape.held(spark, d).where("camp_id IS NOT NULL").groupBy("group_id", F.col("camp_id").alias("cluster")).agg(F.collect_set("answer_id").alias("members"))  # a camp of one problem
    ordered = F.reverse(F.array_sort("members"))
    side = m.where(F.size("members") > 1).select(ordered.alias("members"), F.concat(F.lit("pair of "), F.array_min("members"), F.lit(" and "), F.array_max("members")).alias("name"))
    named = m.withColumn("name", F.concat(F.lit("camp "), F.col("cluster").cast("string")))
    return ops.renamed(named, side).select("group_id", "cluster", "name", "renamed")


@REGISTRY.query("answer_order", f"""WITH {PRACTICES}, f AS (SELECT group_id, answer_id, row_number() OVER (PARTITION BY group_id ORDER BY vote DESC, ext_id) - 1 AS flat FROM p), m AS (SELECT group_id, answer_id, min(flat) AS seen FROM f GROUP BY 1, 2)
SELECT group_id, answer_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY seen) - 1 AS INTEGER) AS place FROM m""")  # fmt: skip
def answer_order(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the order in which their practices first appear."""
    flat = ops.flat_index(landscape.practices(spark, d).withColumn("down", -F.col("vote")), "group_id", "down", "ext_id")
    return ops.first_seen(flat, "group_id", "answer_id", "flat")


_BYNAME = "bn AS (SELECT group_id, CASE WHEN camp_id IS NOT NULL THEN chr(CAST(camp_id // 256 AS INTEGER)) END AS name, ext_id FROM p), hd AS (SELECT group_id, name FROM bn WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), pl AS (SELECT bn.group_id, coalesce(hd.name, 'long-tail') AS cluster, count(*) AS n FROM bn LEFT JOIN hd ON hd.group_id = bn.group_id AND hd.name = bn.name GROUP BY 1, 2)"


@REGISTRY.query("breakdown_by_name", f"WITH {PRACTICES}, {_BYNAME} SELECT group_id, cluster, n, CAST(row_number() OVER (PARTITION BY group_id ORDER BY cluster = 'long-tail', n DESC, cluster) AS INTEGER) AS place FROM pl")
def breakdown_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Clusters keyed by name, so that those of one name are one; by size, then name, the long tail last."""
    p = landscape.held(spark, d).select("group_id", F.when(F.col("camp_id").isNotNull(), F.char(F.floor(F.col("camp_id") / 256))).alias("name"))
    size = p.groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("n"))
    head = F.col("name").isNotNull() & (F.col("n") >= 2)
    placed = size.groupBy("group_id", F.when(head, F.col("name")).otherwise("long-tail").alias("cluster")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("group_id").orderBy(F.col("cluster") == "long-tail", F.desc("n"), "cluster")
    return placed.withColumn("place", F.row_number().over(w))


# --- the resolver --------------------------------------------------------------------------

_HITS = """nv AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  s AS (SELECT x.id AS query_id, y.id, list_cosine_similarity(x.e, y.e) AS c, x.label = y.label AS eq FROM nv x JOIN nv y ON true WHERE x.id % 20 = 0),
  jd AS (SELECT *, CASE WHEN eq AND c >= 0.5 THEN 'equivalent' WHEN eq THEN 'borderline' ELSE 'not_equivalent' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rn FROM s WHERE c >= 0.3) WHERE rn <= 100),
  mm AS (SELECT query_id, id, rn FROM jd WHERE decision = 'equivalent'), ms AS (SELECT query_id, count(*) AS a FROM mm GROUP BY 1),
  gs AS (SELECT label AS group_id, id FROM nv), gz AS (SELECT group_id, count(*) AS b FROM gs GROUP BY 1),
  ov AS (SELECT query_id, group_id, count(*) AS m FROM mm JOIN gs USING (id) GROUP BY 1, 2),
  ru AS (SELECT query_id, 'L' || group_id AS group_id FROM (SELECT query_id, group_id, m / (a + b - m) AS j FROM ov JOIN ms USING (query_id) JOIN gz USING (group_id)) WHERE j >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY j DESC, 'L' || group_id) = 1),
  fr AS (SELECT * FROM mm WHERE query_id NOT IN (SELECT query_id FROM ru)),
  md AS (SELECT x.query_id, x.id, x.rn, round(sum(list_cosine_similarity(vx.e, vy.e)), 9) AS t FROM fr x JOIN fr y USING (query_id) JOIN nv vx ON vx.id = x.id JOIN nv vy ON vy.id = y.id GROUP BY 1, 2, 3),
  nw AS (SELECT query_id, 'q' || id AS group_id FROM md QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t DESC, rn) = 1),
  rs AS (SELECT query_id, group_id, true AS reused FROM ru UNION ALL SELECT query_id, group_id, false FROM nw)"""


def _resolution(spark: SparkSession, d: str) -> Resolution:
    """The stated query set - every vector whose id is divisible by 20 - resolved over all; equal labels stand in for the judgement, labels for known groups."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    label = lambda c, name: v.select(F.col("id").alias(c), F.col("label").alias(name))

    def judge(hits: DataFrame) -> DataFrame:
        both = hits.join(label("id", "has"), "id").join(label("query_id", "asked"), "query_id")
        return both.withColumns({"equivalent": F.col("has") == F.col("asked"), "confidence": F.col("score")})

    known = v.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("group_id"), F.col("id").alias("member"))
    return resolve(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), v, judge, known)


@REGISTRY.query("resolve_groups", f"WITH {_HITS} SELECT nv.id AS query_id, group_id, coalesce(reused, false) AS reused FROM nv LEFT JOIN rs ON rs.query_id = nv.id WHERE nv.id % 20 = 0")
def resolve_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every query, known or new, or none."""
    return _resolution(spark, d).answers


@REGISTRY.query("resolve_candidates", f"""WITH {_HITS}, ls AS (SELECT group_id, max(query_id) AS query_id FROM nw GROUP BY 1)
SELECT group_id, id AS question_id, CAST(rn - 1 AS INTEGER) AS retrieval_rank, round(c, 6) AS retrieval_score, decision AS gate_decision FROM jd JOIN ls USING (query_id)""")  # fmt: skip
def resolve_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of the new groups with their judgement."""
    return _resolution(spark, d).rows.select("group_id", "question_id", "retrieval_rank", F.round("retrieval_score", 6).alias("retrieval_score"), "gate_decision")


KNOWN = {"state update": "q1", "useEffect": "q2", "re-render": "q3", "component": "q4", "react": "q5"}
_KNOWN = " ".join(f"WHEN contains(t, '{k.lower()}') OR contains('{k.lower()}', t) THEN '{g}'" for k, g in KNOWN.items())


@REGISTRY.query("known_groups", f"WITH {Q}, x AS (SELECT question_id, nullif(lower(trim(title)), '') AS t FROM q) SELECT question_id, CASE {_KNOWN} END AS group_id FROM x")
def known_groups(spark: SparkSession, d: str) -> DataFrame:
    """Titles matched with a short list of known texts, either way round, the first hit counts."""
    return questions(spark, d, "title").select("question_id", ops.known_group(F.col("title"), KNOWN).alias("group_id"))


@REGISTRY.query("query_texts", f"WITH {Q} SELECT question_id, nullif(lower(trim(title)), '') AS text FROM q")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "title").select("question_id", query_text(F.col("title")).alias("text"))


@REGISTRY.query("index_norms", "SELECT vec_id AS id, CASE WHEN list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x), 'sum') > 0 THEN 1.0 ELSE 0.0 END AS norm FROM embeddings")
def index_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of every stored vector after it was brought to unit length."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v"))
    return v.select("id", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("norm"))


# --- write semantics and resumption ---------------------------------------------------------


@REGISTRY.query("insert_or_replace_users", f"""WITH {U}, n AS (SELECT user_id, reputation FROM user_authority QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reputation NULLS FIRST) = count(*) OVER (PARTITION BY user_id))
SELECT user_id, reputation FROM n UNION ALL SELECT user_id, reputation FROM u WHERE user_id NOT IN (SELECT user_id FROM n WHERE user_id IS NOT NULL)""")  # fmt: skip
def insert_or_replace_users(spark: SparkSession, d: str) -> DataFrame:
    """Profiles replaced by the snapshot where it has them: last writer wins."""
    old = first(spark, d, "users", "reputation").select("user_id", "reputation")
    return insert_or_replace(old, table(spark, d, "user_authority").select("user_id", "reputation"), ["user_id"], [F.col("reputation").asc_nulls_first()])


@REGISTRY.query("replace_answer_groups", f"WITH {A}, n AS (SELECT question_id, answer_id, score FROM a WHERE is_accepted = 1) SELECT * FROM n UNION ALL SELECT question_id, answer_id, score FROM a WHERE question_id IS NULL OR question_id NOT IN (SELECT question_id FROM n WHERE question_id IS NOT NULL)")
def replace_answer_groups(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a question replaced by its accepted ones where there are some: a restage by group."""
    a = answers(spark, d, "question_id", "score", "is_accepted")
    return replace_groups(a.select("question_id", "answer_id", "score"), a.where("is_accepted = 1").select("question_id", "answer_id", "score"), ["question_id"])


@REGISTRY.query("update_user_scores", f"WITH {U} SELECT u.user_id, coalesce(s.reputation, u.reputation) AS reputation, s.community_id FROM u LEFT JOIN user_authority s USING (user_id)")
def update_user_scores(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with the snapshot's reputation where it has one, and its community as a new column."""
    return update_columns(first(spark, d, "users", "reputation").select("user_id", "reputation"), table(spark, d, "user_authority").select("user_id", "reputation", "community_id"), ["user_id"])


@REGISTRY.query("stages_to_do", f"""WITH {Q}, st AS (SELECT DISTINCT strftime(make_timestamp(creation_date * 1000000), '%Y-%m') AS month, t FROM q, (VALUES ('questions'), ('answers')) x(t) WHERE creation_date IS NOT NULL),
  {A}, dn AS (SELECT DISTINCT strftime(make_timestamp(creation_date * 1000000), '%Y-%m') AS month, 'answers' AS t FROM a WHERE creation_date IS NOT NULL)
SELECT month, t AS stage FROM st WHERE (month, t) NOT IN (SELECT month, t FROM dn)""")  # fmt: skip
def stages_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Stages of collection, a table and a month each, that the ledger does not list; months with answers count as done for answers."""
    from palaver.functions.text import month_of

    month = lambda df: df.where("creation_date IS NOT NULL").select(month_of(F.col("creation_date")).alias("month")).distinct()
    work = month(questions(spark, d, "creation_date")).withColumn("stage", F.explode(F.array(F.lit("questions"), F.lit("answers"))))
    return undone(work, month(answers(spark, d, "creation_date")).withColumn("stage", F.lit("answers")), ["month", "stage"])


# --- audits and reports -----------------------------------------------------------------------

_ENT = "&(amp|lt|gt|quot|apos|nbsp|#\\d+);"


def _bad(name: str, source: str, bad: str) -> str:
    return f"SELECT '{name}' AS check_name, count(CASE WHEN {bad} THEN 1 END) AS n_bad, count(*) AS n_total, count(CASE WHEN {bad} THEN 1 END) = 0 AS passed FROM {source}"


_READY = " UNION ALL ".join([
    _bad("questions have a flag", "q", "is_react = 0"), _bad("questions have a text", "q", "coalesce(body_text, '') = ''"),
    _bad("titles have no entities", "q", "contains(title, '&#') OR contains(title, '&amp;') OR contains(title, '&quot;')"), _bad("question texts have no entities", "q", f"regexp_matches(body_text, '{_ENT}')"),
    _bad("answers have a flag", "a", "is_react = 0"), _bad("answers have a text", "a", "coalesce(body_text, '') = ''"),
    _bad("comments have a flag", "c", "is_react = 0"), _bad("comments have a question", "c", "question_id IS NULL"),
    _bad("edges have two users", "interactions", "source_user_id IS NULL OR target_user_id IS NULL"), _bad("edges are no loops", "interactions", "source_user_id = target_user_id"), _bad("edges have a flag", "interactions", "is_react = 0"),
    _bad("edge users have profiles", "(SELECT source_user_id AS x FROM interactions UNION SELECT target_user_id FROM interactions) LEFT JOIN u ON user_id = x WHERE x IS NOT NULL", "user_id IS NULL"),
    "SELECT 'users are there', CAST(count(*) = 0 AS BIGINT), count(*), count(*) > 0 FROM u",
    "SELECT 'code was marked', CAST(count(CASE WHEN contains(body_text, '[CODE]') THEN 1 END) = 0 AS BIGINT), count(*), count(CASE WHEN contains(body_text, '[CODE]') THEN 1 END) > 0 FROM q",
])


@REGISTRY.query("readiness_checks", f"WITH {Q}, {A}, {C}, {U} {_READY}")
def readiness_checks(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen readiness checks over first rows and stored edges."""
    return readiness(
        questions(spark, d, "title", "body_text", "is_react"), answers(spark, d, "body_text", "is_react"), comments(spark, d, "question_id", "is_react"),
        first(spark, d, "users"), table(spark, d, "interactions").select("source_user_id", "target_user_id", "is_react"),
    )


_EXPECTED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest({[*c, *(FLAGS if t != 'users' else ())]}) AS column_name" for t, c in EXPECTED.items())
_HAVE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in EXPECTED)


@REGISTRY.query("schema_completeness", f"""WITH w AS ({_EXPECTED}), h AS ({_HAVE}), m AS (SELECT table_name, column_name, h.column_name IS NULL AS gone FROM w LEFT JOIN h USING (table_name, column_name))
SELECT table_name, coalesce(string_agg(CASE WHEN gone THEN column_name END, ',' ORDER BY column_name), '') AS missing, count(CASE WHEN gone THEN 1 END) = 0 AS complete FROM m GROUP BY 1""")  # fmt: skip
def schema_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Missing columns of every expected table, from the schemas alone."""
    return spark.createDataFrame(schema_report({t: table(spark, d, t) for t in EXPECTED}), "table_name string, missing string, complete boolean")


@REGISTRY.query("volumes_by_flag", " UNION ALL ".join(f"SELECT '{t}' AS table_name, is_react, count(*) AS n FROM {t} GROUP BY 2" for t in ("questions", "answers", "comments", "interactions")))
def volumes_by_flag(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).groupBy("is_react").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "is_react", "n") for t in ("questions", "answers", "comments", "interactions")]
    return reduce(DataFrame.unionByName, parts)


_ANSWERED = "nq AS (SELECT q.question_id, count(a.answer_id) AS n FROM q LEFT JOIN a ON a.question_id = q.question_id GROUP BY 1)"


@REGISTRY.query("collection_summary", f"""WITH {Q}, {A}, {C}, {U}, {_ANSWERED} SELECT 'questions' AS metric, count(*) AS n FROM q UNION ALL SELECT 'answers', count(*) FROM a UNION ALL SELECT 'comments', count(*) FROM c UNION ALL SELECT 'users', count(*) FROM u
UNION ALL SELECT 'interactions', count(*) FROM interactions UNION ALL SELECT 'questions without answers', count(CASE WHEN n = 0 THEN 1 END) FROM nq UNION ALL SELECT 'questions with two or more', count(CASE WHEN n >= 2 THEN 1 END) FROM nq
UNION ALL SELECT 'questions with three or more', count(CASE WHEN n >= 3 THEN 1 END) FROM nq UNION ALL SELECT 'unflagged rows', (SELECT count(*) FROM q WHERE is_react = 0) + (SELECT count(*) FROM a WHERE is_react = 0) + (SELECT count(*) FROM c WHERE is_react = 0)""")  # fmt: skip
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Volumes, answers per question and unflagged rows of a collection."""
    q, a, c = questions(spark, d, "is_react"), answers(spark, d, "question_id", "is_react"), comments(spark, d, "is_react")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    per = q.select("question_id").join(a.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")), "question_id", "left")
    levels = {"questions without answers": F.col("n").isNull(), "questions with two or more": F.col("n") >= 2, "questions with three or more": F.col("n") >= 3}
    by_level = per.agg(*[F.count(F.when(w, 1)).alias(f"c{i}") for i, w in enumerate(levels.values())])
    stacked = by_level.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"c{i}").alias("n")) for i, name in enumerate(levels)])).alias("r")).select("r.*")
    flags = reduce(DataFrame.unionByName, [df.select("is_react") for df in (q, a, c)]).where("is_react = 0")
    whole = {"questions": q, "answers": a, "comments": c, "users": first(spark, d, "users"), "interactions": table(spark, d, "interactions"), "unflagged rows": flags}
    return reduce(DataFrame.unionByName, [*[one(n, df) for n, df in whole.items()], stacked])


@REGISTRY.query("sampled_answers", f"WITH {A} SELECT answer_id FROM a WHERE coalesce(body_text, '') <> '' ORDER BY md5('7:' || answer_id) LIMIT 5")
def sampled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Five answers drawn by a seeded hash: a sampling operator for reports."""
    a = answers(spark, d, "body_text").where("coalesce(body_text, '') <> ''")
    return a.orderBy(F.md5(F.concat(F.lit("7:"), F.col("answer_id").cast("string")))).limit(5).select("answer_id")


# --- look-ups and rankings ---------------------------------------------------------------------


@REGISTRY.query("top_per_centrality", f"WITH RECURSIVE {_ALL} SELECT m AS method, id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY x DESC, id) AS rn FROM sc) WHERE rn <= 10")
def top_per_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The ten highest nodes of every centrality: a top-k report."""
    w = Window.partitionBy("method").orderBy(F.desc("score"), "id")
    return _centralities(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 10").select("method", "id", "place")


@REGISTRY.query("top_questions_with_answers", f"""WITH {Q}, {A}, t AS (SELECT owner_user_id AS user_id, question_id, row_number() OVER (PARTITION BY owner_user_id ORDER BY score DESC NULLS LAST, question_id) AS rn FROM q WHERE owner_user_id IS NOT NULL)
SELECT t.user_id, t.question_id, a.answer_id, CAST(CASE WHEN a.answer_id IS NOT NULL THEN row_number() OVER (PARTITION BY t.question_id ORDER BY coalesce(a.is_accepted, 0) DESC, a.score DESC NULLS LAST, a.answer_id) END AS INTEGER) AS place FROM t LEFT JOIN a ON a.question_id = t.question_id WHERE rn <= 5""")  # fmt: skip
def top_questions_with_answers(spark: SparkSession, d: str) -> DataFrame:
    """The five best questions of every user with all their answers, accepted ones first."""
    w = Window.partitionBy("owner_user_id").orderBy(F.desc_nulls_last("score"), "question_id")
    top = questions(spark, d, "owner_user_id", "score").where("owner_user_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    a = answers(spark, d, "question_id", "score", "is_accepted").select("question_id", "answer_id", F.col("score").alias("s"), "is_accepted")
    both = top.select(F.col("owner_user_id").alias("user_id"), "question_id").join(a, "question_id", "left")
    order = Window.partitionBy("question_id").orderBy(F.coalesce("is_accepted", F.lit(0)).desc(), F.desc_nulls_last("s"), "answer_id")
    return both.select("user_id", "question_id", "answer_id", F.when(F.col("answer_id").isNotNull(), F.row_number().over(order)).alias("place"))


@REGISTRY.query("answer_lookups", f"WITH {Q}, {A}, {U} SELECT a.answer_id, q.title, u.display_name, u.reputation FROM a LEFT JOIN q ON q.question_id = a.question_id LEFT JOIN u ON u.user_id = a.owner_user_id")
def answer_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Question and author of every answer; null where they are gone."""
    q = questions(spark, d, "title").select("question_id", "title")
    u = first(spark, d, "users", "display_name", "reputation").select(F.col("user_id").alias("owner_user_id"), "display_name", "reputation")
    return answers(spark, d, "question_id", "owner_user_id").join(q, "question_id", "left").join(u, "owner_user_id", "left").select("answer_id", "title", "display_name", "reputation")


_METRICS = ("reputation", "question_count", "answer_count", "total_answer_score")


@REGISTRY.query("cdf_axes", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, coalesce(count(CASE WHEN {m} > 0 THEN 1 END) >= 2 AND max(CASE WHEN {m} > 0 THEN {m} END) / min(CASE WHEN {m} > 0 THEN {m} END) > 1000, false) AS log_axis FROM user_authority" for m in _METRICS))
def cdf_axes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a distribution is drawn on a logarithmic axis: its positive values span more than a factor of 1,000."""
    ua = table(spark, d, "user_authority")
    up = lambda m: F.when(F.col(m) > 0, F.col(m))
    wide = lambda m: F.coalesce((F.count(up(m)) >= 2) & (F.max(up(m)) / F.min(up(m)) > 1000), F.lit(False))
    row = ua.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), wide(m).alias("log_axis")) for m in _METRICS]).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


# --- display values and documents ---------------------------------------------------------------


@REGISTRY.query("lane_radius", f"WITH {landscape._POINTS}, r AS (SELECT group_id, ext_id, round(8 + 30 * coalesce(0.5 * greatest(vote, 0) / nullif(max(greatest(vote, 0)) OVER (PARTITION BY group_id), 0), 0) + 30 * coalesce(0.5 * coalesce(pr, 0) / nullif(max(coalesce(pr, 0)) OVER (PARTITION BY group_id), 0), 0), 6) AS r FROM pt) SELECT group_id, ext_id, round(5 + (r - 8) / CASE WHEN max(r) OVER (PARTITION BY group_id) = 8 THEN 1 ELSE max(r) OVER (PARTITION BY group_id) - 8 END * 9, 4) AS lane FROM r")
def lane_radius(spark: SparkSession, d: str) -> DataFrame:
    """Display radii squeezed into 5 .. 14 per group."""
    r = landscape.node_radius(spark, d)
    top = F.max("radius").over(Window.partitionBy("group_id"))
    return r.select("group_id", "ext_id", F.round(5 + (F.col("radius") - 8) / F.when(top == 8, 1).otherwise(top - 8) * 9, 4).alias("lane"))


@REGISTRY.query("evidence_chips", f"SELECT doc_id, e IN ('code', 'both') AS code, e IN ('prose', 'both') AS prose FROM (SELECT doc_id, {EVIDENCE} AS e FROM documents)")
def evidence_chips(spark: SparkSession, d: str) -> DataFrame:
    from palaver.functions.text import evidence_type

    e = table(spark, d, "documents").select("doc_id", evidence_type(F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e").isin("code", "both").alias("code"), F.col("e").isin("prose", "both").alias("prose"))


GLYPHS = {"consensus": "●", "polarization": "◐", "fragmentation": "∴"}
READABLE = 0.5
_GLYPH = "CASE shape_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GLYPHS.items()) + " END"


@REGISTRY.query("narrative_marks", f"WITH s AS ({landscape.SIGNAL_SQL}) SELECT group_id, {_GLYPH} AS glyph, top1_author IS NOT NULL AND authority_coverage_overall >= {READABLE} AS readable FROM s")
def narrative_marks(spark: SparkSession, d: str) -> DataFrame:
    """The sign of each group's shape, and whether enough authors are known to speak of authority."""
    glyph = F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv])[F.col("shape_label")]
    s = landscape.query_signal(spark, d)
    return s.select("group_id", glyph.alias("glyph"), (F.col("top1_author").isNotNull() & (F.col("authority_coverage_overall") >= READABLE)).alias("readable"))


@REGISTRY.query("document_points", f"WITH {landscape._POINTS} SELECT group_id, ext_id, answer_id, cluster, round(weight, 6) AS weight, authority_status FROM pt")
def document_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of every group as read back from its JSON document."""
    kind = "struct<group_id: bigint, points: array<struct<ext_id: bigint, answer_id: bigint, cluster: string, weight: double, authority_status: string>>>"
    doc = materialize(landscape.breakdown_documents(spark, d), "documents").select(F.from_json("document", kind).alias("j"))
    return doc.select("j.group_id", F.explode("j.points").alias("p")).select("group_id", "p.ext_id", "p.answer_id", "p.cluster", F.round("p.weight", 6).alias("weight"), "p.authority_status")


@REGISTRY.query("document_clusters", f"WITH {PRACTICES}, {landscape._SHELLS} SELECT group_id, CAST(place AS BIGINT) AS place, CASE WHEN k = 1 THEN name ELSE name || ' ·' || k END AS shell_id, n FROM sh")
def document_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of every group as read back from its JSON document; a group without any has an empty list."""
    kind = "struct<group_id: bigint, clusters: array<struct<place: bigint, shell_id: string, n: bigint>>>"
    doc = materialize(landscape.breakdown_documents(spark, d), "documents").select(F.from_json("document", kind).alias("j"))
    return doc.select("j.group_id", F.explode(F.coalesce("j.clusters", F.array().cast("array<struct<place: bigint, shell_id: string, n: bigint>>"))).alias("c")).select("group_id", "c.*")
