"""Queries of the language-model data operators and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import mixing, neardup, splitting, terms, tokens, vectors
from palaver.plans.registry import Registry
from palaver.sources.materialize import materialize
from palaver.sources.tables import first, table

REGISTRY = Registry()
FLOOR = 0.80
NEIGHBOURS = 5
RARE_BELOW = 3
COMMON_ABOVE = 0.1


# --- 2: near-duplicate questions ---------------------------------------------


def similar_questions(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    """Near-duplicate classes of the first rows of questions by title and body."""
    q = first(spark, d, "questions", "title", "body_text")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit("")))
    return neardup.near_duplicates(q, "question_id", text)


_Q_TEXT = """t AS (SELECT question_id AS id, regexp_extract_all(lower(arg_min(coalesce(title, '') || ' ' || coalesce(body_text, ''), collected_at)), '[a-z0-9]+') AS w
     FROM questions WHERE question_id IS NOT NULL GROUP BY 1),
  s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
  pairs AS (SELECT a, b FROM c JOIN n na ON c.a = na.id JOIN n nb ON c.b = nb.id WHERE m * 2 >= na.n + nb.n - m)"""


@REGISTRY.query("p2_found", f"WITH {_Q_TEXT} SELECT a AS question_id_a, b AS question_id_b FROM pairs")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions that share at least half of their three-word shingles."""
    return neardup.duplicate_pairs(similar_questions(spark, d)).select(F.col("id_a").alias("question_id_a"), F.col("id_b").alias("question_id_b"))


_Q_GROUPS = f"""{_Q_TEXT},
  cls AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY sig) AS class_id FROM (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM s GROUP BY 1)),
  lk AS MATERIALIZED (SELECT DISTINCT ca.class_id AS x, cb.class_id AS y FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) JOIN cls ca ON a = ca.id JOIN cls cb ON b = cb.id WHERE ca.class_id <> cb.class_id),
  w(id, root) AS (SELECT DISTINCT class_id, class_id FROM cls UNION SELECT lk.y, w.root FROM w JOIN lk ON lk.x = w.id WHERE w.root < lk.y),
  gr AS (SELECT id, min(root) AS group_id FROM w GROUP BY 1), dg AS (SELECT x, count(*) AS n FROM lk GROUP BY 1)"""


@REGISTRY.query("p2_groups", f"WITH RECURSIVE {_Q_GROUPS} SELECT cls.id AS question_id, class_id, group_id, coalesce(n, 0) AS n_links FROM cls JOIN gr ON gr.id = class_id LEFT JOIN dg ON dg.x = class_id")
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per question: class of equal shingle sets, group of linked classes, and links of its class."""
    return neardup.duplicate_groups(similar_questions(spark, d)).withColumnRenamed("id", "question_id")


# --- 3: most similar vectors -------------------------------------------------


@REGISTRY.query(
    "p3_found",
    """WITH v AS (SELECT question_id AS id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM canonical_index
     WHERE question_id IS NOT NULL AND len(embedding) = 1536 AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END), 'sum') = 0
       AND list_aggregate(list_transform(embedding, lambda x: x * x), 'sum') > 0 GROUP BY 1),
  r AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS c FROM v x JOIN v y ON x.id <> y.id),
  k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM r)
SELECT DISTINCT least(a, b) AS question_id_a, greatest(a, b) AS question_id_b FROM k WHERE rn <= 5 AND c >= 0.8""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions of cosine 0.80 or more of which one is among the other's five most similar."""
    near = vectors.nearest(table(spark, d, "canonical_index"), "question_id", k=NEIGHBOURS, floor=FLOOR)
    return near.select(F.least("id", "neighbour").alias("question_id_a"), F.greatest("id", "neighbour").alias("question_id_b")).distinct()


@REGISTRY.query("p3_neighbours")
def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar questions of every question, whatever their cosine."""
    near = vectors.nearest(table(spark, d, "canonical_index"), "question_id", k=NEIGHBOURS)
    return near.select(F.col("id").alias("question_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"))


# --- 5: frequency of every tag -----------------------------------------------


def _tag_frequencies(spark: SparkSession, d: str) -> DataFrame:
    tags = F.transform("tags", lambda t: F.lower(F.trim(t)))
    return terms.term_frequencies(first(spark, d, "questions", "tags").select(tags.alias("tags")), "tags")


def _question_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").agg(F.count_distinct("question_id"))


_TAGS = """q1 AS (SELECT question_id, arg_min(struct_pack(tags := tags), collected_at) AS r FROM questions WHERE question_id IS NOT NULL GROUP BY 1),
  u AS (SELECT question_id, lower(trim(t)) AS tag FROM (SELECT question_id, unnest(r.tags) AS t FROM q1) WHERE trim(t) <> ''),
  f AS (SELECT tag, count(*) AS uses, count(DISTINCT question_id) AS questions FROM u GROUP BY 1),
  n AS (SELECT count(*) AS total FROM q1)"""


@REGISTRY.query(
    "p5_found",
    f"""WITH {_TAGS} SELECT tag, 'rare' AS mark FROM f WHERE questions < 3
UNION ALL SELECT tag, 'common' FROM f, n WHERE questions > 0.1 * total""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags too rare or too common to be useful."""
    mark = terms.marks(F.col("records"), _question_count(spark, d).scalar(), rare_below=RARE_BELOW, common_above=COMMON_ABOVE)
    return _tag_frequencies(spark, d).select(F.col("term").alias("tag"), F.explode(mark).alias("mark"))


@REGISTRY.query(
    "p5_tags",
    f"""WITH {_TAGS} SELECT tag, uses, questions, coalesce(concat_ws(',', CASE WHEN questions < 3 THEN 'rare' END, CASE WHEN questions > 0.1 * total THEN 'common' END), '') AS mark FROM f, n""",
)
def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    """Uses, questions and marks of every tag."""
    mark = terms.marks(F.col("records"), _question_count(spark, d).scalar(), rare_below=RARE_BELOW, common_above=COMMON_ABOVE)
    return _tag_frequencies(spark, d).select(F.col("term").alias("tag"), "uses", F.col("records").alias("questions"), F.array_join(mark, ",").alias("mark"))


# --- 7: token ids ------------------------------------------------------------


@REGISTRY.query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents"))


@REGISTRY.query("p7_roundtrip", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document's text as it comes back from its token ids."""
    return tokens.decode_corpus(p7_ids(spark, d)).select("doc_id", F.md5("text").alias("digest"))


# --- 8: mixing ---------------------------------------------------------------


def _mixture(spark: SparkSession, d: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): every document as often as the plan draws it, with ``keep`` and its tokens, counted once."""
    counted = materialize(tokens.count_tokens(table(spark, d, "documents"), "doc_id", "source", *keep), "counted")
    plan = materialize(mixing.mix_plan(counted, table(spark, d, "source_mix")), "plan")
    return mixing.replicate(counted, plan), plan


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that do not reach their share in the mixture although every document is there as often as allowed."""
    return mixing.shares(*_mixture(spark, d)).where("short").select("source")


@REGISTRY.query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every copy of every document with its text, in a global shuffle."""
    return mixing.shuffled(_mixture(spark, d, "text")[0]).select("doc_id", "source", "copy_no", "n_tokens", "position", "text")


@REGISTRY.query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mixture(spark, d))


@REGISTRY.query(
    "p8_caps",
    "SELECT DISTINCT doc_id, true AS within_cap, true AS in_sequence, true AS text_kept FROM documents JOIN source_mix USING (source) WHERE target_share > 0 AND max_repeats > 0",
)
def p8_caps(spark: SparkSession, d: str) -> DataFrame:
    """Of every document of the mix: whether its copies keep to the cap, are numbered without gaps, and carry its text."""
    copies, _ = _mixture(spark, d, "text")
    mix = table(spark, d, "source_mix")
    per = copies.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("top"), F.count_distinct("copy_no").alias("numbers"), F.count_distinct("source", F.xxhash64("text")).alias("texts")
    )
    docs = table(spark, d, "documents").join(mix.where("target_share > 0 AND max_repeats > 0").select("source", "max_repeats"), "source").groupBy("doc_id").agg(F.max("max_repeats").alias("cap"), F.count(F.lit(1)).alias("rows"))
    n = F.coalesce("n", F.lit(0))
    return docs.join(per, "doc_id", "left").select(
        "doc_id",
        (n <= F.col("cap") * F.col("rows")).alias("within_cap"),
        ((n == 0) | ((F.col("numbers") == F.col("top") + 1) & (n == F.col("numbers") * F.col("rows")))).alias("in_sequence"),
        (F.coalesce("texts", F.lit(0)) <= F.col("rows")).alias("text_kept"),
    )


# --- 9: splitting ------------------------------------------------------------


@REGISTRY.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents over 1,200 tokens: those that come out in several pieces."""
    pieces = splitting.split_documents(table(spark, d, "documents"), with_text=False)
    return pieces.where("piece_no = 1").select("doc_id")


@REGISTRY.query("p9_pieces")
def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents."""
    return splitting.split_documents(table(spark, d, "documents"))


@REGISTRY.query("p9_cover", "SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS within_limit, true AS chained FROM documents")
def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: digest of its pieces joined without their overlaps, whether all keep to the limit, and whether each begins with the end of the one before."""
    new = F.coalesce(F.expr("substring(piece, char_new - char_start + 1)"), F.lit(""))
    common = F.coalesce(F.expr("substring(piece, 1, char_new - char_start)"), F.lit(""))
    per = splitting.split_documents(table(spark, d, "documents")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new"), common.alias("common"), "piece", "n_tokens", "overlap_tokens", "char_new", "char_end"))).alias("p")
    )  # the pieces of one document are about as large as the document
    after = F.expr("slice(transform(p, (x, i) -> i = 0 OR (x.char_new = p[i - 1].char_end AND x.overlap_tokens BETWEEN 1 AND 80 AND endswith(p[i - 1].piece, x.common))), 2, size(p))")
    return per.select(
        "doc_id",
        F.md5(F.array_join(F.transform("p", lambda x: x["new"]), "")).alias("digest"),
        F.forall("p", lambda x: x["n_tokens"] <= splitting.LIMIT).alias("within_limit"),
        F.forall(after, lambda x: x).alias("chained"),
    )
