"""End-to-end runs on tables: the authority run, baking of groups, and the read side of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.config import AuthorityConfig, GraphConfig
from palaver.functions.rank import minmax, position_percentile
from palaver.graph import authority, communities, paths, spectral
from palaver.graph.build import answer_pairs, judged, weigh
from palaver.operators import signals
from palaver.sources.materialize import materialize
from palaver.sources.writers import overwrite, replace_groups

SPECTRAL = ("in_degree", "out_degree", "hits_authority", "hits_hub", "eigenvector", "katz")
PATHS = ("closeness", "harmonic", "betweenness")


def centralities(edges: DataFrame, ranks: DataFrame, cfg: GraphConfig = GraphConfig(), methods: tuple[str, ...] = ("pagerank", *SPECTRAL, *PATHS)) -> tuple[DataFrame, dict[str, str]]:
    """(id, method, score) min-max scaled, and a note per method that was unknown, failed or ran on a subgraph."""
    notes: dict[str, str] = {}
    shared: dict[str, DataFrame] = {}

    def once(key, make):
        if key not in shared:
            shared[key] = materialize(make(), key)
        return shared[key]

    near = lambda: once("near", lambda: paths.bounded(edges, ranks, cfg))
    makers = {
        "pagerank": lambda: ranks.select("id", F.col("rank").alias("score")),
        "in_degree": lambda: once("degrees", lambda: spectral.degrees(edges)).select("id", F.col("in_degree").cast("double").alias("score")),
        "out_degree": lambda: once("degrees", lambda: spectral.degrees(edges)).select("id", F.col("out_degree").cast("double").alias("score")),
        "hits_authority": lambda: once("hits", lambda: spectral.hits(edges, cfg=cfg)).select("id", F.col("authority").alias("score")),
        "hits_hub": lambda: once("hits", lambda: spectral.hits(edges, cfg=cfg)).select("id", F.col("hub").alias("score")),
        "eigenvector": lambda: spectral.eigenvector(edges, cfg=cfg),
        "katz": lambda: spectral.katz(edges, cfg=cfg),
        "closeness": lambda: once("distances", lambda: paths.distances(near())).select("id", F.col("closeness").alias("score")),
        "harmonic": lambda: once("distances", lambda: paths.distances(near())).select("id", F.col("harmonic").alias("score")),
        "betweenness": lambda: paths.betweenness(near(), cfg),
    }
    out = edges.select(F.col("src").alias("id"), F.lit("").alias("method"), F.lit(0.0).alias("score")).limit(0)
    for m in methods:
        if m not in makers:
            notes[m] = "unknown method"
            continue
        try:
            part = minmax(materialize(makers[m](), m), "score").select("id", F.lit(m).alias("method"), "score")
            out = out.unionByName(part)
        except Exception as e:  # one method that fails leaves the others
            notes[m] = f"failed: {type(e).__name__}: {e}"[:200]
    return out, notes


def authority_run(questions: DataFrame, answers: DataFrame, users: DataFrame, out: str, *, graph: GraphConfig = GraphConfig(), score: AuthorityConfig = AuthorityConfig(), methods: tuple[str, ...] | None = None, **overrides) -> dict:
    """Build the graph, score it and write user_authority, user_pagerank_yearly and authority_run_meta below ``out``.

    Inputs are first rows.  ``overrides`` replace fields of ``graph``; an unknown
    name raises before anything runs.  Returns counts of the run.
    """
    graph = replace(graph, **overrides)
    spark = questions.sparkSession
    seen = materialize(judged(answer_pairs(answers, questions), graph), "judged")
    kept = seen.where("reason = 'kept'")
    edges, yearly = materialize(weigh(kept, cfg=graph), "edges"), materialize(weigh(kept, ["year"], graph), "yearly")
    ranks = materialize(spectral.pagerank(edges, cfg=graph), "ranks")
    per_year = materialize(spectral.pagerank(yearly, by=["year"], cfg=graph), "year_ranks")
    low = yearly.groupBy("year").agg((F.count(F.lit(1)) < graph.min_edges_per_year).alias("low_data"))
    pct = position_percentile(["year"], [F.col("rank"), F.col("id")])
    overwrite(per_year.withColumn("percentile", pct).join(low, "year").select("year", F.col("id").alias("user_id"), "rank", "percentile", "low_data"), f"{out}/user_pagerank_yearly.parquet")
    stats = materialize(authority.user_stats(questions, answers), "stats")
    rep = users.where("reputation IS NOT NULL").select(F.col("user_id").alias("id"), F.col("reputation").alias("value"))
    acc = stats.where("answer_count > 0").select(F.col("user_id").alias("id"), F.col("answerer_accept_rate").alias("value"))
    joined = authority.synthesize(ranks.select("id", F.col("rank").alias("value")), rep, acc, score)
    groups = materialize(communities.louvain(edges, cfg=graph), "groups")
    methods = ("pagerank", *SPECTRAL, *PATHS) if methods is None else methods
    scores, notes = centralities(edges, ranks, graph, methods)
    overwrite(authority.wide_table(users, stats, joined, groups, scores, list(methods)), f"{out}/user_authority.parquet")
    counts = {r["reason"]: r["n"] for r in seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    meta = {"nodes": ranks.count(), "edges": edges.count(), "communities": groups.agg(F.count_distinct("community")).first()[0]}
    meta |= {f"answers_{k}": v for k, v in counts.items()} | {f"note_{k}": v for k, v in notes.items()}
    overwrite(spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "key string, value string"), f"{out}/authority_run_meta.parquet")
    return meta


def bake(practices: DataFrame, authors: DataFrame, out: str, *, force: bool = False) -> DataFrame:
    """Signals and narrative of every group not yet baked below ``out`` (of all with ``force``); returns the groups baked.

    ``practices`` and ``authors`` as in :mod:`palaver.operators.signals`.  New groups
    are appended; the table that tells which are baked is written last, and a
    group that an interrupted run has left in the others is counted once when read.
    """
    spark = practices.sparkSession
    todo = practices.select("group_id").distinct()
    if not force:
        try:
            done = spark.read.parquet(f"{out}/query_signal.parquet")
            todo = todo.join(done.select("group_id"), "group_id", "left_anti")
        except Exception as e:  # nothing baked yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    todo = materialize(todo, "todo")
    fresh = practices.join(todo, "group_id", "left_semi")
    camps, groups = signals.camp_signals(fresh, authors), materialize(signals.group_signals(fresh, authors), "groups")
    for name, df in (("camp_signal", camps), ("query_narrative", signals.narrative(groups)), ("query_signal", groups)):  # the last says what is baked
        path = f"{out}/{name}.parquet"
        if force:
            try:
                df = df.unionByName(spark.read.parquet(path).join(todo, "group_id", "left_anti"))
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            overwrite(df, path)
        else:  # groups baked before stay as they are
            df.write.mode("append").parquet(path)
    return todo


def answer_queries(resolver, queries: DataFrame, practices_of: Callable[[DataFrame], DataFrame], authors: DataFrame, out: str) -> DataFrame:
    """Resolve ``queries(query_id, text)``, keep the candidates of new groups and bake what is not baked; returns (query_id, group_id, reused).

    ``practices_of`` gives the practices of (group_id); a query that no group
    answers has none.
    """
    got = resolver.resolve(queries)
    answers = materialize(got.answers, "answers")
    rows = got.rows
    path = f"{out}/canonical_group.parquet"
    try:
        rows = replace_groups(queries.sparkSession.read.parquet(path), rows, ["group_id"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    overwrite(rows, path)
    bake(practices_of(answers.where("group_id IS NOT NULL").select("group_id").distinct()), authors, out)
    return answers


class Store:
    """Read side of an authority run and a bake."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def user_table(self) -> DataFrame:
        """The wide table."""
        return self._table("user_authority")

    def authority_score(self) -> DataFrame:
        """(user_id, authority_score) of scored users."""
        return self.user_table().where("authority_score IS NOT NULL").select("user_id", "authority_score")

    def top_authorities(self, n: int = 10) -> DataFrame:
        """The ``n`` users of highest score."""
        return self.authority_score().orderBy(F.desc("authority_score"), "user_id").limit(n)

    def communities(self) -> DataFrame:
        """(user_id, community_id)."""
        return self.user_table().where("community_id IS NOT NULL").select("user_id", "community_id")

    def centrality_methods(self) -> list[str]:
        """Methods of the run."""
        return [c.removeprefix("cent_") for c in self.user_table().columns if c.startswith("cent_")]

    def centrality(self, method: str) -> DataFrame:
        """(user_id, score) of one method."""
        if method not in self.centrality_methods():
            raise KeyError(method)
        return self.user_table().select("user_id", F.col(f"cent_{method}").alias("score"))

    def pagerank_yearly(self, year: int | None = None) -> DataFrame:
        """Ranks and percentiles of one year or all."""
        t = self._table("user_pagerank_yearly")
        return t if year is None else t.where(F.col("year") == year)

    def low_data_years(self) -> list[int]:
        """Years with few edges."""
        return sorted(r["year"] for r in self.pagerank_yearly().where("low_data").select("year").distinct().collect())

    def run_meta(self) -> dict[str, str]:
        """Counts and notes of the run."""
        return {r["key"]: r["value"] for r in self._table("authority_run_meta").collect()}

    def summary(self) -> dict:
        """The run in one nested value: its counts, low years, communities and the ten highest users."""
        return {
            "run": self.run_meta(), "low_data_years": self.low_data_years(), "methods": self.centrality_methods(),
            "communities": self.communities().agg(F.count_distinct("community_id")).first()[0], "top": [tuple(r) for r in self.top_authorities().collect()],
        }

    def answer(self, answers: DataFrame, answer_id: int) -> str | None:
        """The text of one answer, its HTML where there is no text, None where there is no such answer."""
        row = answers.where(F.col("answer_id") == answer_id).select(F.coalesce(F.nullif("body_text", F.lit("")), "body", F.lit("")).alias("t")).first()
        return None if row is None else row["t"]

    def queries(self) -> DataFrame:
        """Baked groups with their headline."""
        return self._table("query_signal").select("group_id", "shape_label").distinct().join(self._table("query_narrative").distinct(), "group_id").orderBy("group_id")

    def breakdown(self, group_id) -> DataFrame:
        """Camps of one group, the largest share first."""
        return self._table("camp_signal").where(F.col("group_id") == group_id).distinct().orderBy(F.desc("vote_share"), "first_ext")
