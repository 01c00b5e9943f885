"""Queries of consensus signals, clustering, documents and retrieval.

The tables of the community hold no extracted practices, so practices are read
from line items: group = customer, answer = line item, camp = flags of the line
(none on line 6), author = supplier (none on line 7), vote = quantity - 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.operators import consensus, retrieval, signals
from palaver.plans.registry import Registry
from palaver.plans.sqltext import CAMPS, PRACTICES, PRIMARY, shape
from palaver.sources.materialize import materialize
from palaver.sources.tables import table

REGISTRY = Registry()
_LINE = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def practices(spark: SparkSession, d: str) -> DataFrame:
    """Kept practices of all groups."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    line = table(spark, d, "lineitem").withColumn("answer_id", F.col("l_orderkey") * 1000 + F.row_number().over(w))
    line = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("group_id")), "l_orderkey")
    camp = (F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")).cast("bigint")
    base = line.select(
        "group_id", (F.col("answer_id") * 2).alias("ext_id"), "answer_id", F.when(F.col("l_linenumber") != 6, camp).alias("camp_id"), (F.col("l_quantity") - 10).cast("bigint").alias("vote"),
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("author_id"),
        F.when(F.col("l_returnflag") == "A", 0.9).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.7).alias("agreement"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("sentence"), "l_tax",
    )
    again = F.when(F.col("l_tax") > 0.04, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = base.withColumn("n", F.explode(again))
    return twice.withColumns({"ext_id": F.col("ext_id") + F.col("n"), "sentence": F.concat("sentence", F.when(F.col("n") == 1, " again").otherwise(""))}).drop("n", "l_tax")


def held(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once for plans that read them several times."""
    return materialize(practices(spark, d), "practices")


def authorities(spark: SparkSession, d: str) -> DataFrame:
    """(author_id, pr, name) of suppliers."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_acctbal").alias("pr"), F.col("s_name").alias("name"))


_HEAD = f"""h AS (SELECT group_id, count(*) AS n_head, max(CASE WHEN rn = 1 THEN vote_share END) AS t1, coalesce(max(CASE WHEN rn = 2 THEN vote_share END), 0.0) AS t2, coalesce(max(CASE WHEN rn = 3 THEN vote_share END), 0.0) AS t3,
  coalesce(1.0 / nullif(sum(vote_share * vote_share), 0), 0.0) AS eff, sum(agreement * prevalence_n) / sum(prevalence_n) AS agree, max(CASE WHEN rn = 1 THEN camp_id END) AS leader, max(CASE WHEN pn = 1 THEN camp_id END) AS prev FROM cr GROUP BY 1)"""


@REGISTRY.query("consensus_shape", f"WITH {PRACTICES}, {CAMPS}, {_HEAD} SELECT group_id, round(t1, 4) AS top1_share, round(t2, 4) AS top2_share, round(eff, 4) AS effective_camps, {shape('t1', 't2')} AS shape_label FROM h")
def consensus_shape(spark: SparkSession, d: str) -> DataFrame:
    """Vote shares of camps and the label of their shape, for all groups with a camp."""
    camps = signals.camp_votes(practices(spark, d))
    w = Window.partitionBy("group_id").orderBy(F.desc("vote_share"), "first_ext", "camp_id")
    at = lambda n: F.coalesce(F.max(F.when(F.col("rn") == n, F.col("vote_share"))), F.lit(0.0))
    per = camps.withColumn("rn", F.row_number().over(w)).groupBy("group_id").agg(at(1).alias("t1"), at(2).alias("t2"), F.sum(F.col("vote_share") * F.col("vote_share")).alias("ss"))
    eff = F.coalesce(F.lit(1.0) / F.nullif("ss", F.lit(0.0)), F.lit(0.0))
    return per.select("group_id", F.round("t1", 4).alias("top1_share"), F.round("t2", 4).alias("top2_share"), F.round(eff, 4).alias("effective_camps"), signals.shape_label(F.col("t1"), F.col("t2")).alias("shape_label"))


@REGISTRY.query("primary_camp", f"WITH {PRACTICES}, {PRIMARY} SELECT * FROM pc")
def primary_camp(spark: SparkSession, d: str) -> DataFrame:
    return signals.primary_camps(practices(spark, d))


@REGISTRY.query("camp_signal", f"""WITH {PRACTICES}, {CAMPS}, {PRIMARY},
  ex AS (SELECT group_id, camp_id, arg_max(sentence, greatest(vote, 0) * 1000000000000 - ext_id) AS exemplar FROM p WHERE camp_id IS NOT NULL GROUP BY 1, 2),
  na AS (SELECT group_id, count(DISTINCT answer_id) AS n FROM p GROUP BY 1),
  ov AS (SELECT pc.group_id, pc.camp_id, sum(coalesce(k.pr, 0)) AS cpr, max(coalesce(k.pr, 0)) AS tpr, count(CASE WHEN ra.place <= 3 THEN 1 END) AS n3,
         arg_max(pc.author_id, {{'p': coalesce(k.pr, 0), 'a': -pc.author_id}}) AS top FROM pc LEFT JOIN known k USING (author_id) LEFT JOIN ra ON ra.group_id = pc.group_id AND ra.author_id = pc.author_id GROUP BY 1, 2),
  cov AS (SELECT group_id, camp_id, count(DISTINCT answer_id) AS k FROM p JOIN known USING (author_id) WHERE camp_id IS NOT NULL GROUP BY 1, 2)
SELECT cs.group_id, cs.camp_id, exemplar, prevalence_n, first_ext, round(prevalence_n / na.n, 4) AS prevalence_share, vote_sum, round(vote_share, 4) AS vote_share,
  round(coalesce(cpr / pr_total, 0), 4) AS author_pr_share, au.name AS top_author, round(coalesce(tpr / pr_total, 0), 4) AS top_author_pr_share, coalesce(n3, 0) AS n_top3_authors,
  round(coalesce(cov.k, 0) / prevalence_n, 4) AS authority_coverage, round(cs.agreement, 4) AS voting_agreement
FROM cs JOIN ex USING (group_id, camp_id) JOIN na USING (group_id) LEFT JOIN ov USING (group_id, camp_id) LEFT JOIN tot USING (group_id) LEFT JOIN au ON au.author_id = ov.top LEFT JOIN cov USING (group_id, camp_id)""")  # fmt: skip
def camp_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.camp_signals(held(spark, d), authorities(spark, d))


SIGNAL_SQL = f"""WITH {PRACTICES}, {CAMPS}, {PRIMARY}, {_HEAD},
  vt AS (SELECT group_id, answer_id, max(greatest(vote, 0)) AS v, bool_or(camp_id IS NOT NULL) AS hd, max(author_id) AS author_id FROM p GROUP BY 1, 2),
  al AS (SELECT group_id, count(*) AS n_answers, sum(v) AS grand, coalesce(sum(CASE WHEN hd THEN v END), 0) AS hv, count(k.author_id) AS covered FROM vt LEFT JOIN known k USING (author_id) GROUP BY 1),
  sz AS (SELECT group_id, count(*) AS n_practices, count(CASE WHEN camp_id IS NULL THEN 1 END) AS n_longtail FROM p GROUP BY 1),
  tp AS (SELECT ra.group_id, max(CASE WHEN place = 1 THEN name END) AS a1, max(CASE WHEN place = 1 THEN pr END) AS pr1, max(CASE WHEN place = 1 THEN pc.camp_id END) AS c1, sum(pr) AS pr3,
         count(CASE WHEN pc.camp_id = h.leader THEN 1 END) AS inl FROM ra LEFT JOIN pc ON pc.group_id = ra.group_id AND pc.author_id = ra.author_id LEFT JOIN h ON h.group_id = ra.group_id WHERE place <= 3 GROUP BY 1),
  j AS (SELECT *, pr_total > 0 AS ok, CASE WHEN n_head IS NULL THEN 'fragmentation' ELSE {shape('t1', 't2')} END AS label FROM sz JOIN al USING (group_id) LEFT JOIN h USING (group_id) LEFT JOIN tot USING (group_id) LEFT JOIN tp USING (group_id))
SELECT group_id, n_answers, n_practices, coalesce(n_head, 0) AS n_head_camps, n_longtail, round(coalesce((grand - hv) / nullif(grand, 0), 0), 4) AS longtail_vote_share, round(coalesce(eff, 0), 4) AS effective_camps,
  round(coalesce(t1, 0), 4) AS top1_share, round(coalesce(t2, 0), 4) AS top2_share, round(coalesce(t1, 0) - coalesce(t2, 0), 4) AS gap, label AS shape_label,
  CAST(n_head IS NULL OR agree < 0.6 OR (n_head >= 2 AND {shape('(t1 + t2)', 't3')} <> label) AS INTEGER) AS shape_fragile, leader AS vote_leader_cluster, CASE WHEN ok THEN a1 END AS top1_author,
  CASE WHEN ok THEN round(pr1 / pr_total, 4) END AS top1_pr_share, coalesce(CASE WHEN ok THEN round(pr3 / pr_total, 4) END, 0.0) AS top3_pr_share, CAST(coalesce(ok AND pr1 / pr_total > 0.5, false) AS INTEGER) AS single_voice_dominated,
  CASE WHEN ok THEN c1 END AS top1_author_cluster, CAST(coalesce(ok AND c1 <> leader, false) AS INTEGER) AS authority_diverges, CAST(coalesce(inl, 0) AS INTEGER) AS top3_in_vote_leader,
  round(covered / n_answers, 4) AS authority_coverage_overall, prev AS prevalence_leader_cluster, CAST(coalesce(prev <> leader, false) AS INTEGER) AS prevalence_diverges FROM j"""


@REGISTRY.query("query_signal", SIGNAL_SQL)
def query_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.group_signals(held(spark, d), authorities(spark, d))


@REGISTRY.query("runner_up", f"WITH {PRACTICES}, {CAMPS} SELECT group_id, max(CASE WHEN rn = 1 THEN camp_id END) AS leader, max(CASE WHEN rn = 2 THEN camp_id END) AS runner_up FROM cr GROUP BY 1")
def runner_up(spark: SparkSession, d: str) -> DataFrame:
    return signals.runners_up(signals.camp_votes(practices(spark, d)))


@REGISTRY.query("signal_table_text", f"""WITH {PRACTICES}, {CAMPS} SELECT group_id, string_agg(printf('%-8s %5d %6s', CAST(camp_id AS VARCHAR), prevalence_n, CAST(CAST(round(100 * vote_share) AS INTEGER) AS VARCHAR) || '%'), chr(10) ORDER BY vote_share DESC, first_ext) AS "table" FROM cs GROUP BY 1""")
def signal_table_text(spark: SparkSession, d: str) -> DataFrame:
    return signals.signal_text(signals.camp_votes(practices(spark, d)))


@REGISTRY.query("narrative", f"""WITH s AS ({SIGNAL_SQL}) SELECT group_id, upper(shape_label[1]) || shape_label[2:] || ' over ' || n_head_camps || ' camps; the largest holds ' || CAST(round(100 * top1_share) AS INTEGER) || '%'
 || CASE WHEN authority_diverges = 1 THEN '; the most central author stands elsewhere' ELSE '' END AS headline FROM s""")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    """A describing sentence per group; a template stands in for a written narrative."""
    return signals.narrative(signals.group_signals(held(spark, d), authorities(spark, d)))


_SHELLS = """pk AS (SELECT group_id, camp_id, count(*) AS n FROM p WHERE camp_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
  nm AS (SELECT *, chr(CAST(camp_id // 256 AS INTEGER)) AS name FROM pk),
  sh AS (SELECT *, row_number() OVER (PARTITION BY group_id, name ORDER BY n DESC, camp_id) AS k, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, name, camp_id) AS place FROM nm)"""


def shells(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, camp_id, n, shell_id, place): camps of at least two practices, by size, name and id; a name met again gets a number."""
    return _shells(practices(spark, d))


def _shells(kept: DataFrame) -> DataFrame:
    p = kept.where("camp_id IS NOT NULL").groupBy("group_id", "camp_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    p = p.withColumn("name", F.char(F.floor(F.col("camp_id") / 256)))
    again = F.row_number().over(Window.partitionBy("group_id", "name").orderBy(F.desc("n"), "camp_id"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "name", "camp_id"))
    return p.select("group_id", "camp_id", "n", F.when(again == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ·"), again.cast("string"))).alias("shell_id"), place.cast("bigint").alias("place"))


@REGISTRY.query("breakdown_clusters", f"WITH {PRACTICES}, {_SHELLS} SELECT group_id, camp_id, n, CASE WHEN k = 1 THEN name ELSE name || ' ·' || k END AS shell_id, place FROM sh")
def breakdown_clusters(spark: SparkSession, d: str) -> DataFrame:
    return shells(spark, d)


_POINTS = f"""{PRACTICES}, {_SHELLS},
  va AS (SELECT DISTINCT group_id, answer_id, vote FROM p), vq AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, rank() OVER (PARTITION BY group_id ORDER BY vote) AS r, count(*) OVER (PARTITION BY group_id, vote) AS s FROM va),
  q AS (SELECT group_id, answer_id, CASE WHEN n = 1 THEN 1.0 ELSE (r - 1 + (s - 1) / 2) / (n - 1) END AS q FROM vq),
  ap AS (SELECT author_id, pr, (row_number() OVER (ORDER BY pr, author_id) - 1) / (count(*) OVER () - 1) AS a FROM au WHERE pr > 0),
  pt AS (SELECT p.group_id, p.ext_id, p.answer_id, coalesce(CASE WHEN sh.k = 1 THEN sh.name WHEN sh.k > 1 THEN sh.name || ' ·' || sh.k END, 'long-tail') AS cluster, CASE WHEN a IS NULL THEN q ELSE sqrt(q * greatest(a, 0.05)) END AS weight,
         CASE WHEN a IS NOT NULL THEN 'scored' WHEN p.author_id IS NULL THEN 'anonymous' ELSE 'non_interactive' END AS authority_status, ap.pr, p.vote
         FROM p JOIN q USING (group_id, answer_id) LEFT JOIN sh ON sh.group_id = p.group_id AND sh.camp_id = p.camp_id LEFT JOIN ap ON ap.author_id = p.author_id)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """One row per practice with cluster, weight and status."""
    from palaver.functions.rank import average_rank_percentile, fused_weight, global_percentile

    p = held(spark, d)
    q = p.select("group_id", "answer_id", "vote").distinct().withColumn("q", average_rank_percentile(["group_id"], "vote")).drop("vote")
    a = global_percentile(authorities(spark, d).where("pr > 0"), "pr", "author_id", "a").select("author_id", "pr", "a")
    j = p.join(q, ["group_id", "answer_id"]).join(_shells(p).select("group_id", "camp_id", "shell_id"), ["group_id", "camp_id"], "left").join(a, "author_id", "left")
    status = F.when(F.col("a").isNotNull(), "scored").when(F.col("author_id").isNull(), "anonymous").otherwise("non_interactive")
    return j.select("group_id", "ext_id", "answer_id", F.coalesce("shell_id", F.lit("long-tail")).alias("cluster"), fused_weight(F.col("q"), F.col("a")).alias("weight"), status.alias("authority_status"), "pr", "vote")


@REGISTRY.query("breakdown_points", f"WITH {_POINTS} SELECT group_id, ext_id, answer_id, cluster, round(weight, 6) AS weight, authority_status FROM pt")
def breakdown_points(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("group_id", "ext_id", "answer_id", "cluster", F.round("weight", 6).alias("weight"), "authority_status")


@REGISTRY.query("node_radius", f"WITH {_POINTS} SELECT group_id, ext_id, round(8 + 30 * coalesce(0.5 * greatest(vote, 0) / nullif(max(greatest(vote, 0)) OVER (PARTITION BY group_id), 0), 0) + 30 * coalesce(0.5 * coalesce(pr, 0) / nullif(max(coalesce(pr, 0)) OVER (PARTITION BY group_id), 0), 0), 6) AS radius FROM pt")
def node_radius(spark: SparkSession, d: str) -> DataFrame:
    """Display radius, half by vote and half by authority within the group."""
    w = Window.partitionBy("group_id")
    v, p = F.greatest("vote", F.lit(0)), F.coalesce("pr", F.lit(0.0))
    part = lambda c: F.coalesce(0.5 * c / F.nullif(F.max(c).over(w), F.lit(0)), F.lit(0.0))
    return points(spark, d).select("group_id", "ext_id", F.round(8 + 30 * part(v) + 30 * part(p), 6).alias("radius"))


@REGISTRY.query("answer_cards", f"WITH {_POINTS} SELECT group_id, answer_id, count(*) AS n_practices, max(vote) AS vote FROM pt GROUP BY 1, 2")
def answer_cards(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("group_id", "answer_id").agg(F.count(F.lit(1)).alias("n_practices"), F.max("vote").alias("vote"))


@REGISTRY.query("breakdown_documents")
def breakdown_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per group: clusters and points in order, as the serving cache stores it."""
    s = shells(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "shell_id", "n"))).alias("clusters"))
    p = points(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ext_id", "answer_id", "cluster", "weight", "authority_status"))).alias("points"))
    return p.join(s, "group_id", "left").select("group_id", F.to_json(F.struct("group_id", "clusters", "points")).alias("document"))


@REGISTRY.query("circle_pack")
def circle_pack(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all points; checked by properties in the tests."""
    p = points(spark, d).select("group_id", "cluster", F.col("ext_id").alias("idx"), "weight")
    place = shells(spark, d).select("group_id", F.col("shell_id").alias("cluster"), "place")
    return consensus.circle_layout(p.join(place, ["group_id", "cluster"], "left").withColumn("place", F.coalesce("place", F.lit(1 << 40))))  # the long tail last


@REGISTRY.query("usage_cost_rollup", "SELECT coalesce(event_type, 'total') AS tier, count(*) AS calls, round(sum(value), 2) AS cost FROM events GROUP BY ROLLUP (event_type)")
def usage_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A ledger per tier with its total, read from the event stream's types and values."""
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("cost")).select(F.coalesce("event_type", F.lit("total")).alias("tier"), "calls", "cost")


# --- consensus clustering -------------------------------------------------------------
# items = parts; three labellings: brand, type and size; group = the brand's family

_LABELS = """g AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS idx FROM part),
  lb AS (SELECT p_size AS group_id, 0 AS run, idx, p_brand AS label FROM g UNION ALL SELECT p_size, 1, idx, p_type FROM g UNION ALL SELECT p_size, 2, idx, substr(p_brand, 1, 7) || substr(p_type, 1, 3) FROM g)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").withColumn("idx", (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).cast("bigint"))
    keys = F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.substring("p_brand", 1, 7), F.substring("p_type", 1, 3)))
    return g.select(F.col("p_size").alias("group_id"), "idx", F.posexplode(keys).alias("run", "name")).withColumn("label", F.abs(F.xxhash64("name").cast("decimal(20,0)")).cast("bigint"))


@REGISTRY.query("co_association", f"WITH {_LABELS} SELECT x.group_id, x.idx AS i, y.idx AS j, count(DISTINCT x.run) AS votes FROM lb x JOIN lb y ON x.group_id = y.group_id AND x.run = y.run AND x.label = y.label AND x.idx < y.idx GROUP BY 1, 2, 3")
def co_association(spark: SparkSession, d: str) -> DataFrame:
    return consensus.co_votes(_labelled(spark, d))


@REGISTRY.query("majority_clusters", f"""WITH RECURSIVE {_LABELS}, v AS (SELECT x.group_id, x.idx AS i, y.idx AS j FROM lb x JOIN lb y ON x.group_id = y.group_id AND x.run = y.run AND x.label = y.label AND x.idx < y.idx GROUP BY 1, 2, 3 HAVING count(DISTINCT x.run) >= 2),
 b AS (SELECT group_id, i AS x, j AS y FROM v UNION SELECT group_id, j, i FROM v), w(group_id, idx, root) AS (SELECT p_size, idx, idx FROM g UNION SELECT w.group_id, b.y, w.root FROM w JOIN b ON b.group_id = w.group_id AND b.x = w.idx WHERE w.root < b.y)
SELECT group_id, idx, min(root) AS cluster FROM w GROUP BY 1, 2""")  # fmt: skip
def majority_clusters(spark: SparkSession, d: str) -> DataFrame:
    lab = materialize(_labelled(spark, d), "labels")
    return consensus.majority_of_labels(lab, lab.select("group_id", "idx"), 3)


@REGISTRY.query("cluster_agreement", f"""WITH RECURSIVE {_LABELS}, v AS MATERIALIZED (SELECT x.group_id, x.idx AS i, y.idx AS j, count(DISTINCT x.run) AS votes FROM lb x JOIN lb y ON x.group_id = y.group_id AND x.run = y.run AND x.label = y.label AND x.idx < y.idx GROUP BY 1, 2, 3),
 b AS (SELECT group_id, i AS x, j AS y FROM v WHERE votes >= 2 UNION SELECT group_id, j, i FROM v WHERE votes >= 2), w(group_id, idx, root) AS (SELECT p_size, idx, idx FROM g UNION SELECT w.group_id, b.y, w.root FROM w JOIN b ON b.group_id = w.group_id AND b.x = w.idx WHERE w.root < b.y),
 k AS (SELECT group_id, idx, min(root) AS cluster FROM w GROUP BY 1, 2), z AS (SELECT group_id, cluster, count(*) AS size FROM k GROUP BY 1, 2),
 n AS (SELECT v.group_id, x.cluster, sum(votes) AS s FROM v JOIN k x ON x.group_id = v.group_id AND x.idx = i JOIN k y ON y.group_id = v.group_id AND y.idx = j WHERE x.cluster = y.cluster GROUP BY 1, 2)
SELECT group_id, cluster, size, round(CASE WHEN size < 2 THEN 1.0 ELSE coalesce(s, 0) / 3.0 / (size * (size - 1) / 2) END, 6) AS agreement FROM z LEFT JOIN n USING (group_id, cluster)""")
def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Size and within-cluster agreement of every majority cluster; checked against brute force in the tests."""
    lab = materialize(_labelled(spark, d), "labels")
    clusters = materialize(consensus.majority_of_labels(lab, lab.select("group_id", "idx"), 3), "clusters")
    return consensus.agreement_of_labels(clusters, lab, 3).withColumn("agreement", F.round("agreement", 6))


@REGISTRY.query("ward_companion")
def ward_companion(spark: SparkSession, d: str) -> DataFrame:
    """Ward clusters of the vectors of each label."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("idx"), "embedding")
    return consensus.ward_companion(v, v.groupBy("group_id").agg(F.lit(5).alias("k")))


# --- retrieval ----------------------------------------------------------------------------

_UNIT = "nv AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@REGISTRY.query("cosine_topk", f"WITH {_UNIT}, s AS (SELECT x.id AS query_id, y.id, list_cosine_similarity(x.e, y.e) AS c FROM nv x JOIN nv y ON true WHERE x.id % 20 = 0) SELECT query_id, id, round(c, 6) AS score, CAST(rn - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rn FROM s WHERE c >= 0.3) WHERE rn <= 100")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set - every vector whose id is divisible by 20 - against all vectors, at most 100 above 0.30 each."""
    v = _vectors(spark, d)
    return retrieval.cosine_topk(v.where("id % 20 = 0"), v, 100, 0.30).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.query("gate_decision", f"WITH {_UNIT}, s AS (SELECT x.id AS query_id, y.id, list_cosine_similarity(x.e, y.e) AS c, x.label = y.label AS eq FROM nv x JOIN nv y ON true WHERE x.id % 20 = 0) SELECT query_id, id, CASE WHEN eq AND c >= 0.5 THEN 'equivalent' WHEN eq THEN 'borderline' ELSE 'not_equivalent' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rn FROM s WHERE c >= 0.3) WHERE rn <= 100")
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    """Gate of the retrieved candidates; equal labels stand in for the judgement, the cosine for its confidence."""
    v = _vectors(spark, d)
    found = retrieval.cosine_topk(v.where("id % 20 = 0"), v, 100, 0.30)
    named = found.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    return named.select("query_id", "id", retrieval.gate_decision(F.col("label") == F.col("asked"), F.col("score")).alias("decision"))


@REGISTRY.query("medoid", f"WITH {_UNIT}, s AS (SELECT x.label AS group_id, x.id, round(sum(list_cosine_similarity(x.e, y.e)), 9) AS c FROM nv x JOIN nv y ON x.label = y.label GROUP BY 1, 2) SELECT group_id, arg_max(id, {{'c': c, 'i': -id}}) AS medoid FROM s GROUP BY 1")
def medoid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.medoids(v.select(F.col("label").alias("group_id"), "id", F.col("id").alias("pos")), v)


@REGISTRY.query("jaccard_reuse", """WITH n AS (SELECT DISTINCT l_suppkey AS new_id, l_partkey AS member FROM lineitem WHERE l_returnflag = 'A'), g AS (SELECT DISTINCT l_suppkey AS group_id, l_partkey AS member FROM lineitem),
 s AS (SELECT new_id, group_id, count(*) AS m FROM n JOIN g USING (member) GROUP BY 1, 2), x AS (SELECT s.*, m / (a + b - m) AS j FROM s JOIN (SELECT new_id, count(*) AS a FROM n GROUP BY 1) USING (new_id) JOIN (SELECT group_id, count(*) AS b FROM g GROUP BY 1) USING (group_id))
SELECT new_id, group_id, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY j DESC, group_id) AS rn FROM x) WHERE rn = 1 AND j >= 0.3""")  # fmt: skip
def jaccard_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The known group that overlaps most with each new member set, if by 0.3 or more."""
    from palaver.config import RetrievalConfig

    line = table(spark, d, "lineitem")
    new = line.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("new_id"), F.col("l_partkey").alias("member"))
    known = line.select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("member"))
    return retrieval.best_overlap(new, known, RetrievalConfig(dedup_threshold=0.3)).select("new_id", "group_id", F.round("jaccard", 6).alias("jaccard"))


# --- derived display measures -------------------------------------------------------------

RING = 340  # fixed value: radius of the outermost ring
COLOURS = 8  # fixed value: colours before they repeat
WINDOW_START = 1996


@REGISTRY.query("cluster_display", f"WITH {PRACTICES}, {_SHELLS} SELECT group_id, camp_id, round(n / max(n) OVER (PARTITION BY group_id), 6) AS fraction, round({RING} * (1 - n / max(n) OVER (PARTITION BY group_id)), 6) AS ring, (place - 1) % {COLOURS} AS colour FROM sh")
def cluster_display(spark: SparkSession, d: str) -> DataFrame:
    """Size relative to the group's largest cluster, ring radius - larger clusters nearer the centre - and colour by order."""
    share = F.col("n") / F.max("n").over(Window.partitionBy("group_id"))
    return shells(spark, d).select("group_id", "camp_id", F.round(share, 6).alias("fraction"), F.round(RING * (1 - share), 6).alias("ring"), ((F.col("place") - 1) % COLOURS).alias("colour"))


@REGISTRY.query("camp_years", f"""SELECT o_custkey AS group_id, CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS BIGINT) AS camp_id, CAST(min(year(l_shipdate)) AS INTEGER) AS first_year, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year,
  count(CASE WHEN year(l_shipdate) < {WINDOW_START} THEN 1 END) AS n_out_of_window FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")  # fmt: skip
def camp_years(spark: SparkSession, d: str) -> DataFrame:
    """First and last year of each camp's practices and how many precede the window."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")).cast("bigint").alias("camp_id"), F.year("l_shipdate").alias("y"))
    j = line.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id")), "o_orderkey")
    return j.groupBy("group_id", "camp_id").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count(F.when(F.col("y") < WINDOW_START, 1)).alias("n_out_of_window"))


@REGISTRY.query("authority_label", """SELECT user_id, greatest(1, CAST(round((1 - p) * 100) AS INTEGER)) AS top_percent FROM (SELECT user_id, CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1) / (n - 1) END AS p
  FROM (SELECT user_id, row_number() OVER (ORDER BY comp_pagerank, user_id) AS rn, count(*) OVER () AS n FROM user_authority WHERE comp_pagerank > 0))""")  # fmt: skip
def authority_label(spark: SparkSession, d: str) -> DataFrame:
    """The N of 'top N percent' for every scored user, at least 1."""
    from palaver.functions.rank import global_percentile

    ua = global_percentile(table(spark, d, "user_authority").where("comp_pagerank > 0").select("user_id", "comp_pagerank"), "comp_pagerank", "user_id", "p")
    return ua.select("user_id", F.greatest(F.lit(1), F.round((1 - F.col("p")) * 100).cast("int")).alias("top_percent"))


@REGISTRY.query("stream_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the event stream, run to its end with a watermark (an extension)."""
    import uuid

    from palaver.sources.materialize import shared_dir
    from palaver.streaming.edges import event_stream, run_to_end, windowed_counts

    folder = f"{shared_dir(spark)}/palaver-stream-{uuid.uuid4().hex}"  # of this run; one that should go on names its own
    done = run_to_end(windowed_counts(event_stream(spark, f"{d}/events.parquet")), ["start", "event_type"], f"{folder}/windows", f"{folder}/checkpoint")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
