"""End-to-end runs, the read side and the external sources."""

from __future__ import annotations

import json
import sqlite3

import pytest

from palaver.contract import PercentileAuthority, VoteAuthority
from palaver.pipeline import Store, authority_run, bake
from palaver.plans.landscape import authorities, practices
from palaver.sources.external import ReplayedPages, SQLiteTable
from palaver.sources.tables import first
from tests.oracle import DATA


def test_authority_run_and_store(spark, tmp_path):
    q, a, u = first(spark, DATA, "questions", "owner_user_id", "score", "creation_date"), first(spark, DATA, "answers", "question_id", "owner_user_id", "score", "creation_date", "is_accepted"), first(spark, DATA, "users", "display_name", "reputation")
    with pytest.raises(TypeError):
        authority_run(q, a, u, str(tmp_path), no_such_option=1)
    meta = authority_run(q, a, u, str(tmp_path), methods=("pagerank", "in_degree", "closeness", "nonsense"))
    store = Store(spark, str(tmp_path))
    assert store.run_meta()["nodes"] == str(meta["nodes"]) and store.run_meta()["note_nonsense"] == "unknown method"
    assert store.top_authorities(3).count() == 3
    assert {"pagerank", "in_degree", "closeness"} <= set(store.centrality_methods())
    assert store.centrality("pagerank").agg({"score": "max"}).first()[0] == 1.0
    assert store.communities().count() == meta["nodes"]
    assert store.low_data_years() and store.pagerank_yearly(2022).count() > 0
    with pytest.raises(KeyError):
        store.centrality("absent")


def test_bake_resumes(spark, tmp_path):
    p, au = practices(spark, DATA), authorities(spark, DATA)
    n = p.select("group_id").distinct().count()
    assert bake(p.where("group_id < 50"), au, str(tmp_path)).count() > 0
    rest = bake(p, au, str(tmp_path)).count()
    assert 0 < rest < n and bake(p, au, str(tmp_path)).count() == 0
    store = Store(spark, str(tmp_path))
    assert store.queries().count() == n
    g = store.queries().first()["group_id"]
    assert store.breakdown(g).count() > 0


def test_providers(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.0)], "user_id bigint, score double")
    answers = spark.createDataFrame([(10, 1, 3, True), (11, 3, -1, False)], "answer_id bigint, author_id bigint, vote bigint, is_accepted boolean")
    assert {r["answer_id"]: r["authority"] for r in PercentileAuthority(scores).score(answers).collect()} == {10: 1.0, 11: None}
    assert {r["answer_id"]: r["authority"] for r in VoteAuthority().score(answers).collect()}[11] == 0.5


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE questions (question_id INTEGER PRIMARY KEY, title TEXT, score REAL)")
    con.executemany("INSERT INTO questions VALUES (?, ?, ?)", [(i, None if i == 3 else f"t{i}", i / 2) for i in range(1, 40)] + [(99, "x", "not a number")])
    con.commit()
    spark.dataSource.register(SQLiteTable)
    df = spark.read.format("sqlite_table").option("path", path).option("table", "questions").load()
    rows = {r["question_id"]: (r["title"], r["score"]) for r in df.collect()}
    assert len(rows) == 40 and rows[3] == (None, 1.5) and rows[99] == ("x", None)
    for bad, message in ((str(tmp_path / "none.db"), "does not exist"), (str(tmp_path / "empty.db"), "is empty")):
        if "empty" in bad:
            open(bad, "w").close()
        with pytest.raises(Exception, match=message):
            spark.read.format("sqlite_table").option("path", bad).option("table", "questions").load().count()


def test_replayed_pages(spark, tmp_path):
    pages = [[{"id": 1}, {"id": 2, "t": "x"}], [], [{"id": 3}], [], [], [{"id": 4}]]
    (tmp_path / "s").mkdir()
    for i, items in enumerate(pages):
        (tmp_path / "s" / f"{i}.json").write_text(json.dumps({"items": items}))
    spark.dataSource.register(ReplayedPages)
    read = spark.read.format("replayed_pages").schema("id long, t string").option("path", str(tmp_path))
    assert sorted((r["id"], r["t"]) for r in read.load().collect()) == [(1, None), (2, "x"), (3, None)]
    assert read.option("most", "2").load().count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "0.json").write_text(json.dumps({"items": [{"id": 7}], "quota_remaining": 3}))
    (tmp_path / "t" / "1.json").write_text(json.dumps({"items": [{"id": 8}]}))
    again = lambda: spark.read.format("replayed_pages").schema("id long, t string").option("path", str(tmp_path))
    ids = lambda r: sorted(x["id"] for x in r.load().collect())
    assert ids(again().option("since", "t")) == [7, 8] and ids(again().option("until", "t")) == [1, 2, 3]
    assert ids(again().option("since", "t").option("quota", "5")) == [7]
    (tmp_path / "t" / "1.json").write_text(json.dumps({"backoff": 0}))
    with pytest.raises(Exception, match="no answer in 2 tries"):
        again().option("since", "t").option("tries", "2").option("wait", "0").load().count()


def test_sqlite_introspection(tmp_path):
    from palaver.sources.external import sqlite_tables

    con = sqlite3.connect(str(tmp_path / "a.db"))
    con.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)")
    con.commit()
    assert sqlite_tables(str(tmp_path / "a.db")) == [("t", "a", "INTEGER", True), ("t", "b", "TEXT", False)]


def test_queries_answered_end_to_end(spark, tmp_path):
    from palaver.operators.resolver import TextResolver, extend_index
    from palaver.operators.resolver import hashed_embedding
    from palaver.pipeline import answer_queries

    q = spark.createDataFrame([(1, "update state", "x"), (2, "css grid", "y")], "question_id bigint, title string, body_text string")
    embed = hashed_embedding(32)
    index = extend_index(q, str(tmp_path / "index"), embed)
    none = spark.createDataFrame([], "group_id string, member bigint")
    p = practices(spark, DATA).where("group_id < 20").drop("group_id")
    asked = spark.createDataFrame([(5, "update state"), (6, "zzz")], "query_id bigint, text string")
    got = answer_queries(TextResolver(index, q, none, embed), asked, lambda g: p.join(g), authorities(spark, DATA), str(tmp_path / "out"))
    assert {r["query_id"]: r["group_id"] for r in got.collect()} == {5: "q1", 6: None}
    store = Store(spark, str(tmp_path / "out"))
    assert [r["group_id"] for r in store.queries().collect()] == ["q1"] and store.breakdown("q1").count() > 0


def test_labeller(spark):
    from palaver.contract import HashedLabeller
    from palaver.operators import consensus

    s = spark.createDataFrame([("g", 0, "copy the object"), ("g", 1, "Copy the object!"), ("g", 2, "use a reducer"), ("g", 3, "?")], "group_id string, idx bigint, sentence string")
    lab = HashedLabeller().label(s)
    got = consensus.majority_clusters(consensus.co_votes(lab), lab, 3)
    assert {r["idx"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
