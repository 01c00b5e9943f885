"""Queries of the graph operators.  Iterative ones run until they settle; their SQL recurs for so many steps that nothing changes any more at the digits shown."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.functions.rank import minmax, position_percentile, spearman
from palaver.graph import authority, communities, paths, spectral
from palaver.graph.build import undirected
from palaver.operators.components import connected_components
from palaver.operators.skew import compress, cumulated
from palaver.plans.registry import Registry
from palaver.plans.relational import _STATS, edges, stats, year_edges
from palaver.pipeline import PATHS as PATH_METHODS
from palaver.pipeline import SPECTRAL, centralities
from palaver.plans.sqltext import EDGES, NODES, PATHS, U, YEAR_EDGES, pagerank, yearly_pagerank
from palaver.plans.sqltext import eigenvector as eigenvector_sql
from palaver.plans.sqltext import hits as hits_sql
from palaver.plans.sqltext import katz as katz_sql
from palaver.sources.materialize import materialize
from palaver.sources.tables import first, table

REGISTRY = Registry()
CFG = replace(GraphConfig(), pagerank_tol=1e-15, hits_tol=1e-12, eigenvector_tol=1e-12, katz_tol=1e-12)  # tighter than six digits need


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """(id, rank) on the whole graph."""
    return spectral.pagerank(materialize(edges(spark, d), "edges"), cfg=CFG)


@REGISTRY.query("pagerank_full", f"WITH RECURSIVE {EDGES}, {NODES}, {pagerank()} SELECT id, round(rank * c, 6) AS relative_rank FROM pr")
def pagerank_full(spark: SparkSession, d: str) -> DataFrame:
    """PageRank times the number of nodes."""
    r = materialize(ranks(spark, d), "ranks")
    return r.select("id", F.round(F.col("rank") * r.agg(F.count(F.lit(1))).scalar(), 6).alias("relative_rank"))


@REGISTRY.query("pagerank_yearly", f"""WITH RECURSIVE {YEAR_EDGES}, {yearly_pagerank()}, k AS (SELECT year, count(*) < 200 AS low FROM e GROUP BY 1),
 x AS (SELECT year, id, round(rank * c, 6) AS relative_rank FROM pr)
SELECT year, id, relative_rank, round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1) / (n - 1) END, 6) AS percentile, low AS low_data FROM
 (SELECT *, row_number() OVER (PARTITION BY year ORDER BY relative_rank, id) AS rn, count(*) OVER (PARTITION BY year) AS n FROM x) JOIN k USING (year)""")  # fmt: skip
def pagerank_yearly(spark: SparkSession, d: str) -> DataFrame:
    """All years in one loop, with percentile and a flag for years of few edges."""
    e = materialize(year_edges(spark, d), "year_edges")
    r = materialize(spectral.pagerank(e, by=["year"], cfg=CFG), "ranks")
    n = r.groupBy("year").agg(F.count(F.lit(1)).alias("c"))
    low = e.groupBy("year").agg((F.count(F.lit(1)) < CFG.min_edges_per_year).alias("low_data"))
    x = r.join(n, "year").join(low, "year").select("year", "id", F.round(F.col("rank") * F.col("c"), 6).alias("relative_rank"), "low_data")
    pct = position_percentile(["year"], [F.col("relative_rank"), F.col("id")])
    return x.select("year", "id", "relative_rank", F.round(pct, 6).alias("percentile"), "low_data")


@REGISTRY.query("degrees", f"WITH {EDGES}, x AS (SELECT dst AS id, weight AS i, 0 AS o FROM e UNION ALL SELECT src, 0, weight FROM e) SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return spectral.degrees(edges(spark, d))


def _scaled(column: str) -> str:
    return f"round(coalesce(({column} - min({column}) OVER ()) / nullif(max({column}) OVER () - min({column}) OVER (), 0), 0), 6) AS {column}"


@REGISTRY.query("eigenvector", f"WITH RECURSIVE {EDGES}, {NODES}, {eigenvector_sql()} SELECT id, {_scaled('score')} FROM eig")
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return minmax(spectral.eigenvector(materialize(edges(spark, d), "edges"), cfg=CFG), "score").select("id", F.round("score", 6).alias("score"))


@REGISTRY.query("katz", f"WITH RECURSIVE {EDGES}, {NODES}, {katz_sql()} SELECT id, {_scaled('score')} FROM kz")
def katz(spark: SparkSession, d: str) -> DataFrame:
    return minmax(spectral.katz(materialize(edges(spark, d), "edges"), cfg=CFG), "score").select("id", F.round("score", 6).alias("score"))


@REGISTRY.query("hits", f"WITH RECURSIVE {EDGES}, {NODES}, {hits_sql()} SELECT id, {_scaled('authority')}, {_scaled('hub')} FROM ht")
def hits(spark: SparkSession, d: str) -> DataFrame:
    v = spectral.hits(materialize(edges(spark, d), "edges"), cfg=CFG)
    return minmax(minmax(v, "authority"), "hub").select("id", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@REGISTRY.query("connected_components", f"""WITH RECURSIVE {EDGES}, {NODES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
 w(id, root) AS (SELECT id, id FROM n UNION SELECT b.y, w.root FROM w JOIN b ON b.x = w.id WHERE w.root < b.y) SELECT id AS node, min(root) AS component FROM w GROUP BY 1""")  # fmt: skip
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(edges(spark, d).select("src", "dst"))


def _path_edges(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(edges(spark, d), "edges")
    return paths.bounded(e, spectral.pagerank(e, cfg=CFG))


@REGISTRY.query("closeness_harmonic", f"WITH RECURSIVE {EDGES}, {NODES}, {PATHS} SELECT id, round(closeness, 6) AS closeness, round(harmonic, 6) AS harmonic FROM cl")
def closeness_harmonic(spark: SparkSession, d: str) -> DataFrame:
    """Closeness and harmonic centrality; beyond 20,000 nodes of the top 5,000 by PageRank, as the feature defines it."""
    return paths.distances(_path_edges(spark, d)).select("id", F.round("closeness", 6).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


@REGISTRY.query("betweenness", f"WITH RECURSIVE {EDGES}, {NODES}, {PATHS} SELECT id, {_scaled('score')} FROM bt")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness from 500 sampled sources, min-max scaled: a sampling operator."""
    return minmax(paths.betweenness(_path_edges(spark, d)), "score").select("id", F.round("score", 6).alias("score"))


@REGISTRY.query("louvain")
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return communities.louvain(edges(spark, d))


@REGISTRY.query("louvain_modularity")
def louvain_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity and number of the Louvain communities."""
    e = materialize(edges(spark, d), "edges")
    return communities.modularity(undirected(e), communities.louvain(e))


@REGISTRY.query("modularity_of_partition", f"""WITH {EDGES}, l AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e GROUP BY 1, 2),
 k AS (SELECT user_id AS id, community_id AS c FROM user_authority WHERE community_id IS NOT NULL), x AS (SELECT w, ka.c AS ca, kb.c AS cb FROM l JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b),
 d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM x UNION ALL SELECT cb, w FROM x) GROUP BY 1), i AS (SELECT ca AS c, sum(w) AS i FROM x WHERE ca = cb GROUP BY 1)
SELECT round(2.0 * sum(coalesce(i, 0)) / sum(d) - sum(CAST(d AS DOUBLE) * d) / (CAST(sum(d) AS DOUBLE) * sum(d)), 9) AS modularity, count(*) AS communities FROM d LEFT JOIN i USING (c)""")  # fmt: skip
def modularity_of_partition(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "user_authority").where("community_id IS NOT NULL").select(F.col("user_id").alias("id"), F.col("community_id").alias("community"))
    return communities.modularity(undirected(edges(spark, d)), part).select(F.round("modularity", 9).alias("modularity"), "communities")


_TOP = "t AS (SELECT comp_pagerank AS x, reputation AS y FROM user_authority WHERE comp_pagerank IS NOT NULL ORDER BY comp_pagerank DESC, user_id LIMIT 200)"
_RANKS = "s AS (SELECT x, y FROM t WHERE y IS NOT NULL), rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM s)"


@REGISTRY.query("spearman_topn", f"WITH {_TOP}, {_RANKS} SELECT round(CASE WHEN count(*) >= 3 AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) END, 6) AS rho, count(*) AS n FROM rk")
def spearman_topn(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of score and reputation among the 200 of highest score: a top-k report."""
    top = table(spark, d, "user_authority").where("comp_pagerank IS NOT NULL").orderBy(F.desc("comp_pagerank"), "user_id").limit(200)
    return spearman(top.where("reputation IS NOT NULL"), "comp_pagerank", "reputation").select(F.round("rho", 6).alias("rho"), "n")


@REGISTRY.query("authority_synthesis", f"""WITH RECURSIVE {EDGES}, {NODES}, {pagerank()}, {U}, {_STATS[_STATS.index("ev AS"):]},
 pn AS (SELECT id, (rank - min(rank) OVER ()) / nullif(max(rank) OVER () - min(rank) OVER (), 0) AS p FROM pr),
 rn AS (SELECT user_id AS id, coalesce((reputation - min(reputation) OVER ()) / nullif(max(reputation) OVER () - min(reputation) OVER (), 0), 0) AS r FROM u WHERE reputation IS NOT NULL),
 ac AS (SELECT user_id AS id, accepted_answer_count / answer_count AS v FROM st WHERE answer_count > 0), an AS (SELECT id, coalesce((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), 0) AS acc FROM ac),
 parts AS (SELECT id, coalesce(p, 0.0) AS p, r, acc FROM pn LEFT JOIN rn USING (id) LEFT JOIN an USING (id)),
 t AS (SELECT p AS x, r AS y FROM parts ORDER BY round(p, 9) DESC, id LIMIT 200), {_RANKS},
 sc AS (SELECT CASE WHEN rho IS NULL OR rho > 0.8 THEN 'pagerank_only' WHEN rho < 0.5 THEN 'dual_track' ELSE 'weighted' END AS scheme FROM (SELECT CASE WHEN count(*) >= 3 AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) END AS rho FROM rk))
SELECT id AS user_id, round(CASE WHEN scheme = 'weighted' THEN 0.5 * p + 0.3 * coalesce(r, 0) + 0.2 * coalesce(acc, 0) ELSE p END, 6) AS authority_score, scheme AS authority_scheme,
       round(p, 6) AS comp_pagerank, round(coalesce(r, 0), 6) AS comp_tag_reputation, round(coalesce(acc, 0), 6) AS comp_accept_rate FROM parts, sc""")  # fmt: skip
def authority_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """PageRank, reputation and accept rate joined by the scheme their agreement selects."""
    s = _synthesis(spark, d)
    return s.select("user_id", F.round("authority_score", 6).alias("authority_score"), "authority_scheme", *[F.round(c, 6).alias(c) for c in ("comp_pagerank", "comp_tag_reputation", "comp_accept_rate")])


def _synthesis(spark: SparkSession, d: str) -> DataFrame:
    pr = materialize(ranks(spark, d), "ranks").select("id", F.col("rank").alias("value"))
    rep = first(spark, d, "users", "reputation").where("reputation IS NOT NULL").select(F.col("user_id").alias("id"), F.col("reputation").alias("value"))
    acc = stats(spark, d).where("answer_count > 0").select(F.col("user_id").alias("id"), F.col("answerer_accept_rate").alias("value"))
    return authority.synthesize(pr, rep, acc)


METHODS = ["pagerank", *SPECTRAL, *PATH_METHODS]
_SCALED = {
    "pagerank": "SELECT id, rank AS x FROM pr", "in_degree": "SELECT n.id, coalesce((SELECT sum(weight) FROM e WHERE dst = n.id), 0) AS x FROM n",
    "out_degree": "SELECT n.id, coalesce((SELECT sum(weight) FROM e WHERE src = n.id), 0) AS x FROM n", "hits_authority": "SELECT id, authority AS x FROM ht", "hits_hub": "SELECT id, hub AS x FROM ht",
    "eigenvector": "SELECT id, score AS x FROM eig", "katz": "SELECT id, score AS x FROM kz", "closeness": "SELECT id, closeness AS x FROM cl", "harmonic": "SELECT id, harmonic AS x FROM cl", "betweenness": "SELECT id, score AS x FROM bt",
}
_ALL = f"""{EDGES}, {NODES}, {pagerank()}, {hits_sql()}, {eigenvector_sql()}, {katz_sql()}, {PATHS},
  sc AS MATERIALIZED (SELECT m, id, round(coalesce((x - min(x) OVER (PARTITION BY m)) / nullif(max(x) OVER (PARTITION BY m) - min(x) OVER (PARTITION BY m), 0), 0), 6) AS x FROM ({" UNION ALL ".join(f"SELECT '{m}' AS m, * FROM ({q})" for m, q in _SCALED.items())}))"""


def _centralities(spark: SparkSession, d: str) -> DataFrame:
    """(id, method, score): all ten methods, min-max scaled, at six digits; one that fails raises here."""
    e = materialize(edges(spark, d), "edges")
    scores, notes = centralities(e, materialize(spectral.pagerank(e, cfg=CFG), "ranks"), CFG, tuple(METHODS))
    if notes:
        raise RuntimeError(str(notes))
    return materialize(scores.withColumn("score", F.round("score", 6)), "centralities")


@REGISTRY.query("centralities_long", f"WITH RECURSIVE {_ALL} SELECT id, m AS method, x AS score FROM sc")
def centralities_long(spark: SparkSession, d: str) -> DataFrame:
    """Every centrality of every node of the graph."""
    return _centralities(spark, d)


@REGISTRY.query("authority_wide_table")
def authority_wide_table(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, score, community and the ten centralities of every user; rows only, for its communities have no SQL: `authority_wide_scores` has the rest."""
    groups = communities.louvain(edges(spark, d))
    return authority.wide_table(first(spark, d, "users", "display_name", "reputation"), stats(spark, d), _synthesis(spark, d), groups, _centralities(spark, d), METHODS)


_WIDE = ("question_count", "answer_count", "accepted_answer_count", "total_question_score", "total_answer_score")


@REGISTRY.query("authority_wide_scores", f"""WITH RECURSIVE {_ALL}, {U}, {_STATS[_STATS.index("ev AS"):]},
  ids AS (SELECT user_id FROM st UNION SELECT id FROM n), pv AS (SELECT id, {", ".join(f"max(CASE WHEN m = '{m}' THEN x END) AS cent_{m}" for m in METHODS)} FROM sc GROUP BY 1)
SELECT user_id, display_name, reputation, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _WIDE)}, first_activity_year, last_activity_year, {", ".join(f"coalesce(cent_{m}, 0.0) AS cent_{m}" for m in METHODS)}
FROM ids LEFT JOIN u USING (user_id) LEFT JOIN st USING (user_id) LEFT JOIN pv ON pv.id = user_id""")  # fmt: skip
def authority_wide_scores(spark: SparkSession, d: str) -> DataFrame:
    """The wide table without communities and joined score: profile, activity and all ten centralities."""
    none = table(spark, d, "users").select(F.col("user_id").alias("id"), F.lit(0).cast("bigint").alias("community")).limit(0)
    score = first(spark, d, "users").select("user_id").limit(0)
    cent = _centralities(spark, d)
    score = cent.select(F.col("id").alias("user_id")).distinct().unionByName(score)
    wide = authority.wide_table(first(spark, d, "users", "display_name", "reputation"), stats(spark, d), score, none, cent, METHODS)
    return wide.select("user_id", "display_name", "reputation", *_WIDE, "first_activity_year", "last_activity_year", *[f"cent_{m}" for m in METHODS])


_MATRIX = "rk AS (SELECT m, id, rank() OVER (PARTITION BY m ORDER BY x) + (count(*) OVER (PARTITION BY m, x) - 1) / 2 AS r FROM sc)"


@REGISTRY.query("centrality_correlation", f"WITH RECURSIVE {_ALL}, {_MATRIX} SELECT x.m AS a, y.m AS b, round(corr(x.r, y.r), 6) AS rho FROM rk x JOIN rk y USING (id) GROUP BY 1, 2")
def centrality_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman matrix of the ten centralities, one row per pair.

    Average ranks come from the weighted distinct values of a method by a running
    sum that continues over tasks.
    """
    long = _centralities(spark, d)
    ranks_ = cumulated(compress(long, ["method"], "score"), ["method"])
    ranks_ = ranks_.select("method", F.col("value").alias("score"), (F.col("upto") - (F.col("weight") - 1) / 2).alias("r"))
    wide = long.join(ranks_, ["method", "score"]).groupBy("id").pivot("method", METHODS).agg(F.first("r"))
    pairs = list(combinations_with_replacement(METHODS, 2))
    row = wide.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("rho")) for a, b in pairs]).alias("p"))
    each = row.select(F.explode("p").alias("p")).select("p.*")
    return each.unionByName(each.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
