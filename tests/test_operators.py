"""Components, consensus, retrieval, ranks, text, writers and graph scores against small brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.config import GraphConfig
from palaver.functions import rank, text
from palaver.graph import communities, paths, spectral
from palaver.graph.build import judged, undirected
from palaver.operators import consensus, retrieval, signals
from palaver.operators.components import connected_components
from palaver.sources.writers import insert_or_ignore, insert_or_replace, overwrite, replace_groups, update_columns


def graph(seed=1, n=12, m=30):
    rnd = random.Random(seed)
    e = {}
    for _ in range(m):
        a, b = rnd.randrange(n), rnd.randrange(n)
        if a != b:
            e[a, b] = e.get((a, b), 0) + 1
    return e


def frame(spark, e):
    return spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "src bigint, dst bigint, weight bigint")


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 10), (10, 9), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 9: 9, 10: 9} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_pagerank_sums_to_one_and_matches_numpy(spark):
    e = graph()
    ids = sorted({x for k in e for x in k})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for (x, y), w in e.items():
        a[at[x], at[y]] = w
    out = a.sum(1)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(60):
        p = np.where(out > 0, r / np.where(out > 0, out, 1), 0) @ a
        r = 0.85 * (p + r[out == 0].sum() / len(ids)) + 0.15 / len(ids)
    got = {x["id"]: x["rank"] for x in spectral.pagerank(frame(spark, e)).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert [got[x] for x in ids] == pytest.approx(list(r), abs=1e-7)


def test_scores_are_the_same_in_one_task_and_as_frames(spark):
    e = frame(spark, graph(4, 20, 60))
    close = dict(pagerank_tol=1e-6, hits_tol=1e-5, eigenvector_tol=1e-4, katz_tol=1e-5)  # few steps: each is several jobs
    narrow, wide = GraphConfig(**close), GraphConfig(**close, one_task=0)
    for run, columns in ((spectral.pagerank, ["rank"]), (spectral.hits, ["authority", "hub"]), (spectral.eigenvector, ["score"]), (spectral.katz, ["score"])):
        logs = [], []
        a, b = ({r["id"]: [r[c] for c in columns] for r in run(e, cfg=cfg, log=log).collect()} for cfg, log in zip((narrow, wide), logs))
        assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], abs=5e-3) for i in a)
        assert all(log[-1]["change"] < 1e-4 and log[-1]["steps"] > 1 for log in logs)
    years = e.withColumn("year", F.col("src") % 2)
    a, b = ({(r["year"], r["id"]): r["rank"] for r in spectral.pagerank(years, by=["year"], cfg=cfg).collect()} for cfg in (narrow, wide))
    assert a == pytest.approx(b, abs=1e-4)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_a_slow_graph_is_reported_not_cut_short(spark, one_task):
    chain = frame(spark, {(i, i + 1): 1 for i in range(30)})  # without a cycle the eigenvector settles only as 1 / steps
    with pytest.raises(spectral.NotSettled):
        spectral.eigenvector(chain, cfg=GraphConfig(eigenvector_max_iter=12, one_task=one_task))
    log = []
    ring = frame(spark, {(i, (i + 1) % 5): 1 + i for i in range(5)})
    spectral.katz(ring, cfg=GraphConfig(katz_alpha=0.9, katz_max_iter=12, katz_tol=1e-2, one_task=one_task), log=log)
    assert [n["change"] < 1e-2 for n in log] == [False] * (len(log) - 1) + [True] and len(log) > 1  # alpha was halved


def test_pagerank_of_a_stated_number_of_steps(spark):
    e = frame(spark, graph())
    a, b = ({r["id"]: r["rank"] for r in spectral.pagerank(e, steps=3, cfg=GraphConfig(one_task=t)).collect()} for t in (0, 10**6))
    assert a == pytest.approx(b, abs=1e-12)


def test_paths_against_brute_force(spark):
    e = graph(2)
    ids = sorted({x for k in e for x in k})
    dist = {s: {s: 0} for s in ids}
    for s in ids:
        front = [s]
        while front:
            new = []
            for x in front:
                for a, b in e:
                    if a == x and b not in dist[s]:
                        dist[s][b] = dist[s][x] + 1
                        new.append(b)
            front = new
    for r in paths.distances(frame(spark, e)).collect():
        d = [dist[s][r["id"]] for s in ids if s != r["id"] and r["id"] in dist[s]]
        assert r["harmonic"] == pytest.approx(sum(1 / x for x in d))
        assert r["closeness"] == pytest.approx(len(d) / (len(ids) - 1) * len(d) / sum(d) if d else 0)
    count = {(s, t): 0 for s in ids for t in ids}
    for s in ids:
        count[s, s] = 1
        for t in sorted(dist[s], key=dist[s].get)[1:]:
            count[s, t] = sum(count[s, x] for x, y in e if y == t and dist[s].get(x) == dist[s][t] - 1)
    n = len(ids)
    for r in paths.betweenness(frame(spark, e)).collect():
        v = r["id"]
        b = sum(count[s, v] * count[v, t] / count[s, t] for s in ids for t in ids if len({s, t, v}) == 3 and t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t])
        assert r["score"] == pytest.approx(b / ((n - 1) * (n - 2)))


def test_bounded_falls_back_to_the_top(spark):
    e = frame(spark, {(1, 2): 1, (2, 3): 1, (3, 4): 1})
    ranks = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.3), (4, 0.2)], "id bigint, rank double")
    got = paths.bounded(e, ranks, GraphConfig(expensive_max_nodes=3, expensive_top_n=2)).collect()
    assert [(r["src"], r["dst"]) for r in got] == [(2, 3)]


def test_louvain_finds_two_cliques(spark):
    e = {(a, b): 1 for base in (0, 10) for a in range(base, base + 5) for b in range(base, base + 5) if a < b} | {(4, 10): 1}
    got = {r["id"]: r["community"] for r in communities.louvain(frame(spark, e)).collect()}
    assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(10, 15)} == {10}
    q = communities.modularity(undirected(frame(spark, e)), communities.louvain(frame(spark, e))).first()
    assert q["communities"] == 2 and 0.4 < q["modularity"] < 0.5


def test_louvain_runs_until_no_merge_helps(spark):
    n = 2000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("bigint").alias("weight"))
    of = {r["id"]: r["community"] for r in communities.louvain(e).collect()}
    volume = {}
    for i in range(n):
        volume[of[i]] = volume.get(of[i], 0) + (1 if i in (0, n - 1) else 2)
    m = n - 1
    assert all(of[i] == of[i + 1] or 1 - volume[of[i]] * volume[of[i + 1]] / (2 * m) <= 1e-6 for i in range(n - 1))


def test_louvain_raises_at_its_ceiling(spark):
    with pytest.raises(RuntimeError):
        communities.louvain(frame(spark, {(1, 2): 1, (2, 3): 1}), max_rounds=1, one_task=0)


def test_cascade_counts_the_first_failing_rule(spark):
    t = 1700000000
    rows = [(None, 1, t), (0, 0, t), (0, 5, t), (5, 5, t), (5, 6, 0), (5, 6, None), (5, 6, t)]
    got = [r["reason"] for r in judged(spark.createDataFrame(rows, "asker bigint, answerer bigint, creation_date bigint")).collect()]
    assert got == ["missing", "excluded", "excluded", "self", "year", "year", "kept"]


def practice(spark, rows):
    return spark.createDataFrame(rows, "group_id bigint, ext_id bigint, answer_id bigint, camp_id bigint, vote bigint, author_id bigint, agreement double, sentence string")


def test_top_share_may_pass_one_and_zero_votes_fragment(spark):
    p = practice(spark, [(1, 1, 1, 7, 5, 10, 0.9, "a"), (1, 2, 2, None, 9, 11, None, "b"), (2, 3, 3, 7, 0, 10, 0.9, "c"), (2, 4, 4, 8, -3, None, 0.9, "d"), (3, 5, 5, None, 1, None, None, "e")])
    au = spark.createDataFrame([(10, 1.0, "x"), (11, 3.0, "y")], "author_id bigint, pr double, name string")
    got = {r["group_id"]: r for r in signals.group_signals(p, au).collect()}
    assert got[1]["top1_pr_share"] == 3.0 and got[1]["top1_author"] == "y" and got[1]["authority_diverges"] == 0 and got[1]["top1_author_cluster"] is None
    assert got[1]["shape_label"] == "consensus" and got[1]["longtail_vote_share"] == round(9 / 14, 4)
    assert got[2]["shape_label"] == "fragmentation" and got[2]["effective_camps"] == 0
    assert got[3]["shape_label"] == "fragmentation" and got[3]["shape_fragile"] == 1 and got[3]["n_head_camps"] == 0


def test_labels_and_agreement(spark):
    c = spark.createDataFrame([("g", 0, 0, [0, 1, 9]), ("g", 0, 1, [1, 2]), ("g", 1, 0, [0, 1, 2]), ("g", 2, 0, [1, 2])], "group_id string, run int, pos int, members array<int>")
    n = spark.createDataFrame([("g", 4)], "group_id string, n int")
    lab = consensus.labels(c, n)
    assert {(r["run"], r["idx"]): r["label"] for r in lab.collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (0, 3): -1, (1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): -1, (2, 0): -1, (2, 1): 0, (2, 2): 0, (2, 3): -1}
    votes = consensus.co_votes(lab)
    assert {(r["i"], r["j"]): r["votes"] for r in votes.collect()} == {(1, 2): 3, (0, 1): 1, (0, 2): 1}
    got = consensus.majority_clusters(votes, lab, 3)
    assert {r["idx"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 3}
    assert {r["cluster"]: r["agreement"] for r in consensus.agreement(got, votes, 3).collect()} == {0: 1.0, 1: 1.0, 3: 1.0}


def random_labels(spark, runs, seed=3):
    """Labels of three groups, some missing, repeated or several in one run."""
    rnd = random.Random(seed)
    rows = [(g, r, i, rnd.choice([-1, 0, 0, 1, 2, 3])) for g in "abc" for r in range(runs) for i in range(25)]
    rows += rows[:20] + [("a", 0, 3, 1), ("a", 0, 3, 2), ("a", 1, 3, 0), ("b", 2, 4, 3), (None, 0, 1, 1), ("a", 0, None, 1), ("a", 0, 2, None)]
    return spark.createDataFrame(rows, "group_id string, run int, idx bigint, label bigint")


@pytest.mark.parametrize("runs", [1, 3, 12])
def test_majority_without_pairs(spark, runs):
    lab = random_labels(spark, runs)
    items = lab.where("group_id IS NOT NULL AND idx IS NOT NULL")
    got = consensus.majority_of_labels(lab, items, runs).collect()
    assert sorted(got) == sorted(consensus.majority_clusters(consensus.co_votes(lab), items, runs).collect())


def test_votes_without_shuffled_pairs(spark, monkeypatch):
    lab = random_labels(spark, 4)
    has = {}
    for r in lab.where("label >= 0 AND group_id IS NOT NULL AND idx IS NOT NULL").collect():
        has.setdefault((r["group_id"], r["idx"]), set()).add((r["run"], r["label"]))
    want = sorted((g, i, j, len({r for r, _ in v & w})) for (g, i), v in has.items() for (h, j), w in has.items() if g == h and i < j and v & w)
    assert sorted(tuple(r) for r in consensus.co_votes(lab).collect()) == want
    monkeypatch.setattr(consensus, "BLOCK", 2)
    monkeypatch.setattr(consensus, "CELL", 3)
    assert sorted(tuple(r) for r in consensus.co_votes(lab).collect()) == want
    plan = consensus.co_votes(lab)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "HashAggregate(keys=[group_id#" not in plan.split("Generate")[0]  # nothing gathers the pairs


@pytest.mark.parametrize("runs", [3, 12])
def test_agreement_without_pairs(spark, runs):
    lab = random_labels(spark, runs)
    clusters = lab.where("group_id IS NOT NULL AND idx IS NOT NULL").select("group_id", "idx", (F.col("idx") % 4).alias("cluster")).distinct()
    got = consensus.agreement_of_labels(clusters, lab, runs).collect()
    assert sorted(got) == sorted(consensus.agreement(clusters, consensus.co_votes(lab), runs).collect())


def test_majority_of_one_large_label(spark):
    n = 100_000  # 5 billion pairs
    lab = spark.range(n).select(F.lit(1).alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"), F.col("id").alias("idx"), F.lit(7).cast("bigint").alias("label"))
    got = consensus.majority_of_labels(lab, lab.select("group_id", "idx"), 3).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]
    one = lab.where("run = 0").select("group_id", "idx", F.lit(0).alias("cluster"))
    assert [tuple(r) for r in consensus.agreement_of_labels(one, lab, 3).collect()] == [(1, 0, n, 1.0)]


def test_ward_separates():
    x = np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0]])
    assert list(consensus.ward_labels(x, 3)) == [0, 0, 1, 1, 2]
    assert list(consensus.ward_labels(x, 9)) == [0, 1, 2, 3, 4]


def test_circles_do_not_overlap():
    r = np.sqrt(np.random.default_rng(1).random(40) + 0.01)
    at = consensus.pack_circles(r)
    for i in range(40):
        for j in range(i):
            assert np.hypot(*(at[i] - at[j])) >= r[i] + r[j] - 1e-6


def test_retrieval_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0])], "id bigint, embedding array<double>")
    got = [(r["id"], r["rank"]) for r in retrieval.cosine_topk(v.where("id = 1"), v, 2).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1)]
    assert retrieval.cosine_topk(v.where("id = 9"), v, 2).count() == 0
    m = spark.createDataFrame([("a", 1, 0), ("a", 5, 1), ("a", 4, 2), ("b", 99, 0), ("b", 98, 1), ("c", 97, 0), ("c", 4, 1)], "group_id string, id bigint, pos bigint")
    assert {r["group_id"]: r["medoid"] for r in retrieval.medoids(m, v).collect()} == {"a": 5, "b": 99, "c": 4}
    new = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "new_id bigint, member bigint")
    old = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 9), ("y", 8), ("y", 7)], "group_id string, member bigint")
    assert [(r["new_id"], r["group_id"]) for r in retrieval.best_overlap(new, old).collect()] == [(1, "x")]


def test_percentiles(spark):
    df = spark.createDataFrame([("g", 1), ("g", 1), ("g", 3), ("h", 5)], "g string, v bigint")
    assert sorted((r[0], r[1]) for r in df.select("v", rank.average_rank_percentile(["g"], "v")).collect()) == [(1, 0.25), (1, 0.25), (3, 1.0), (5, 1.0)]
    wide = spark.range(0, 101).select(F.col("id").alias("k"), (F.col("id") % 10).alias("s"))
    got = {r["k"]: r["p"] for r in rank.global_percentile(wide, "s", "k", "p").collect()}
    order = sorted(range(101), key=lambda k: (k % 10, k))
    assert got == pytest.approx({k: i / 100 for i, k in enumerate(order)})
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id bigint, x double")
    assert [r["x"] for r in rank.minmax(same, "x").collect()] == [0.0, 0.0]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, text.clean_html, "<p>a &amp;lt; b</p><pre><code>x\ny</code></pre>  <code>z</code>&eacute;<br/>") == "a &lt; b\n [CODE] [CODE] é"
    assert one(spark, text.clean_html, None) == ""
    assert [one(spark, text.evidence_type, x) for x in (None, "plain", "```a\nb```", "[CODE]\nshort", "[CODE]\n" + "w " * 40)] == ["prose", "prose", "code", "code", "both"]
    assert [one(spark, text.parse_epoch, x) for x in ("12", " 7 ", "2024-01-01", "2024-01-01 00:00:01", "2024-01-01T00:00:02", "junk", "", None)] == [12, 7, 1704067200, 1704067201, 1704067202, None, None, None]
    assert one(spark, text.sentences, "One. Two!  Three?") == ["One.", "Two!"]
    md = text.html_to_markdown('<h2>T</h2><p>a <b>b</b> <a href="http://x">l</a></p><ol><li>1</li><li>2</li></ol><pre><code class="language-js">f()</code></pre>')
    assert "## T" in md and "**b**" in md and "[l](http://x)" in md and "2. 2" in md and "```js\nf()" in md
    assert text.markdown_to_html("**a** <b> `x*y*z`\n\n- i\n- j") == "<p><strong>a</strong> &lt;b&gt; <code>x*y*z</code></p><ul><li>i</li><li>j</li></ul>"


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k bigint, v string")
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(insert_or_ignore(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "y")]
    assert get(insert_or_replace(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "x"), (3, "z")]
    assert get(replace_groups(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]
    assert get(update_columns(old, spark.createDataFrame([(1, None, 5), (2, "n", 6)], "k bigint, v string, w bigint"), ["k"]).select("k", "v", "w")) == [(1, "a", 5), (2, "n", 6)]
    path = str(tmp_path / "t")
    old.write.partitionBy("k").parquet(path)
    overwrite(spark.read.parquet(path).where("k = 2").withColumn("v", F.lit("new")), path, partition_by=["k"])
    assert get(spark.read.parquet(path).select("k", "v")) == [(1, "a"), (2, "new")]


def test_stream_counts_and_resume(spark, tmp_path):
    from palaver.streaming.edges import append_once, event_stream, run_to_end, windowed_counts

    source = str(tmp_path / "events")
    kind = "event_id bigint, ts string, event_type string, value double"

    def arrive(*rows):
        spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    def counted():
        df = run_to_end(windowed_counts(event_stream(spark, source)), ["start", "event_type"], str(tmp_path / "windows"), str(tmp_path / "marks"))
        return {(str(r["start"])[:10], r["event_type"]): (r["n"], r["total"]) for r in df.collect()}

    arrive((1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 02:00:00", "a", 2.0), (3, "2024-01-02 02:00:00", "b", 3.0))
    assert counted() == {("2024-01-01", "a"): (2, 3.0), ("2024-01-02", "b"): (1, 3.0)}
    arrive((4, "2024-01-09 00:00:00", "b", 1.0))
    counted()  # the watermark is now two days before that
    arrive((5, "2024-01-01 03:00:00", "a", 9.0), (6, "2024-01-08 03:00:00", "a", 4.0))
    got = counted()
    assert got[("2024-01-01", "a")] == (2, 3.0)  # late, so dropped
    assert got[("2024-01-08", "a")] == (1, 4.0) and got[("2024-01-09", "b")] == (1, 1.0)
    target, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    for i in range(2):  # another checkpoint reads everything again; the ledger keeps it from being written again
        arrive((10 + i, "2024-02-01 00:00:00", "c", 0.0))
        append_once(event_stream(spark, source), target, ledger, ["event_id"], str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5, 6, 10, 11]


def test_markdown_marks():
    m = text.html_to_markdown
    assert m("<blockquote>a<br>b</blockquote>") == "> a  \n> b"
    assert m("<p>x<br/>y</p><hr><ul>lost<li>i <em>j</em></li><li>k</li></ul>") == "x  \ny\n\n---\n\n- i *j*\n- k"
    assert m('<pre class="x"><code class="lang-py hl">a &lt; b\n</code></pre>') == "```py\na < b\n```"
    assert m("<a>t</a><a href='u'> v </a><li>w</li><p>open") == "t[v](u)w\nopen" and m(None) == m("") == ""
    p = text.markdown_by_pattern
    assert p('<p>x</p><pre><code class="language-js">f() &amp;amp;\n</code></pre>y<br />z') == "x\n\n```js\nf() &\n```\ny  \nz"
    assert p("a <code>&lt;b&gt;c</code>") == "a `c`" and p(None) == ""  # decoded before the tags go


def test_practices_of_an_answer(spark):
    from palaver.operators import practices as ops

    a = spark.createDataFrame([(1, "How to update state", "Use the state setter when you merge, if it is old, unless x, when y is so. No. Always copy first!"), (2, None, None), (3, "t", "")], "answer_id bigint, parent_title string, body_text string")
    got = [(r["practice_rank"], r["conditions"], r["relevant"], r["substantive"], r["evidence_type"]) for r in ops.extract(a).orderBy("practice_rank").collect()]
    assert got == [(0, ["when you merge", "if it is old", "unless x"], 1, 1, "prose"), (1, [], 0, 0, "prose")]
    gone, none = ops.matched(ops.extract(a), a.where("answer_id = 2"))
    assert gone.count() == 0 and none.first()[0] == 2
    flags = spark.createDataFrame([(1, 1, None), (1, None, "equivalent"), (0, 1, "borderline")], "r int, s int, g string")
    assert [tuple(x) for x in flags.select(ops.is_kept(F.col("r"), F.col("s")), ops.is_member(F.col("g"))).collect()] == [(True, True), (False, True), (False, False)]


def test_names_companions_and_renames(spark):
    from palaver.operators import practices as ops

    m = spark.createDataFrame([("g", 1, "copy the state"), ("g", 1, "copy state first"), ("g", 2, "state reducer"), ("g", 3, "..."), ("h", 1, "same words"), ("h", 2, "words same")], "group_id string, cluster bigint, sentence string")
    got = {(r["group_id"], r["cluster"]): r["name"] for r in ops.cluster_names(m).collect()}
    assert got == {("g", 1): "copy first the", ("g", 2): "reducer state", ("g", 3): "", ("h", 1): "same words", ("h", 2): "same words ·2"}
    c = spark.createDataFrame([("g", 0, 5), ("g", 1, 5), ("g", 2, 6)], "group_id string, idx bigint, cluster bigint")
    k = spark.createDataFrame([("g", 0, 8), ("g", 2, 9)], "group_id string, idx bigint, companion bigint")
    assert sorted(map(tuple, ops.assign(c, k).select("idx", "cluster", "companion").collect()), key=lambda r: r[0]) == [(0, 5, 8), (1, 5, None), (2, None, 9)]
    named = spark.createDataFrame([("g", 1, [3, 1], "one"), ("g", 2, [2], "two")], "group_id string, cluster bigint, members array<bigint>, name string")
    side = spark.createDataFrame([([1, 3], "new"), ([1, 3], "other"), ([7], "none")], "members array<bigint>, name string")
    assert {r["cluster"]: (r["name"], r["renamed"]) for r in ops.renamed(named, side).collect()} == {1: ("new", True), 2: ("two", False)}


def test_resolver(spark, tmp_path):
    from palaver.operators.resolver import TextResolver, extend_index, hashed_embedding

    q = spark.createDataFrame([(1, "update state twice", "x"), (2, "update the state", None), (3, "css grid", "layout"), (4, None, None)], "question_id bigint, title string, body_text string")
    embed, path = hashed_embedding(64), str(tmp_path / "index")
    extend_index(q.where("question_id < 3"), path, embed)
    index = extend_index(q, path, embed)
    assert sorted(r["id"] for r in index.collect()) == [1, 2, 3, 4]  # the first two were not embedded again
    asked = spark.createDataFrame([(10, " Update STATE "), (11, "css grid layout"), (12, "  "), (13, None), (14, "nothing alike")], "query_id bigint, text string")
    known = spark.createDataFrame([("old", 3)], "group_id string, member bigint")
    from palaver.config import RetrievalConfig

    got = TextResolver(index, q, known, embed, RetrievalConfig(accept_confidence=0.4)).resolve(asked)
    answers = {r["query_id"]: (r["group_id"], r["reused"]) for r in got.answers.collect()}
    assert answers[11] == ("old", True) and answers[12] == answers[13] == answers[14] == (None, False)
    assert answers[10][0] in ("q1", "q2") and not answers[10][1]
    rows = got.rows.collect()
    assert {r["group_id"] for r in rows} == {answers[10][0]} and "equivalent" in {r["gate_decision"] for r in rows}


def test_many_queries_meet_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 6)).round(1)
    x[50:90] = x[50]  # more ties than wanted
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, embedding array<double>").repartition(5)
    rows = lambda df: {(r["query_id"], r["rank"]): r["id"] for r in df.collect()}
    one, many = rows(retrieval.cosine_topk(v, v, 7, 0.1)), rows(retrieval.cosine_topk(v, v, 7, 0.1, block=25, part=40))
    assert one == many
    assert [one[60, r] for r in range(7)] == [50, 51, 52, 53, 54, 55, 56]  # the smaller ids of those that tie


def test_circles_in_circles(spark):
    p = spark.createDataFrame([(1, "b", 2, i, 1.0 + i) for i in range(5)] + [(1, "a", 1, 10 + i, 0.5) for i in range(3)] + [(1, "tail", 9, 20, None)], "group_id bigint, cluster string, place int, idx bigint, weight double")
    rows = consensus.circle_layout(p).collect()
    shells = {r["cluster"]: r for r in rows if r["level"] == 1}
    assert len(shells) == 3 and all(np.hypot(r["x"], r["y"]) + r["r"] <= 1 + 1e-9 for r in rows)
    for r in rows:
        if r["level"] == 2:
            s = shells[r["cluster"]]
            assert np.hypot(r["x"] - s["x"], r["y"] - s["y"]) + r["r"] <= s["r"] + 1e-9
    area = {r["idx"]: r["r"] ** 2 for r in rows if r["level"] == 2}
    assert area[4] / area[0] == pytest.approx(5) and area[0] / area[10] == pytest.approx(2)


def test_circles_side_by_side():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 60, 41, 40, *rng.integers(1, 30, 3000)]
    radii = [rng.random(n) + 0.05 for n in sizes]
    at = consensus.pack_each(np.concatenate(radii), np.cumsum([0, *sizes[:-1]]))
    for k, start in list(enumerate(np.cumsum([0, *sizes[:-1]])))[:60]:
        own, r = at[start : start + sizes[k]], radii[k]
        gap = np.hypot(*(own[:, None] - own[None]).transpose(2, 0, 1)) - r[:, None] - r + np.eye(len(r)) * 9
        assert gap.min() >= -1e-8
        assert np.hypot(*own.T) == pytest.approx(np.hypot(*consensus.pack_circles(r).T), abs=1e-6)


def test_groups_of_circles_over_batches(spark):
    rows = [(g, "ab"[i % 2], i % 2, 100 * k + i, 0.1 + (i * 7 + k) % 5) for k, g in enumerate(["x", "y", None, "z", "zz"]) for i in range(3 + 4 * k)]
    p = spark.createDataFrame(rows, "group_id string, cluster string, place int, idx bigint, weight double").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        found = []
        for most in (4, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = consensus.circle_layout(p).collect()
            found.append({tuple(r[:4]): tuple(r[4:]) for r in got})
            assert len(got) == len(rows) + 10 and sorted(r["idx"] for r in got if r["level"] == 2) == sorted(r[3] for r in rows)
            assert all(np.hypot(r["x"], r["y"]) + r["r"] <= 1 + 1e-9 for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {k: pytest.approx(v) for k, v in found[0].items()} == found[1]


def test_audit_of_nothing_and_guards(spark):
    from palaver.operators import audit

    none = {t: spark.createDataFrame([], ", ".join(f"{c} string" for c in (*cols, "is_react"))) for t, cols in audit.EXPECTED.items()}
    got = audit.readiness(*(none[t] for t in ("questions", "answers", "comments", "users", "interactions"))).collect()
    assert len(got) == 14 and {r["check_name"] for r in got if not r["passed"]} == {"users are there", "code was marked"}
    assert [r[2] for r in audit.schema_report({**none, "users": None})] == [True, True, True, False, True]
    assert audit.missing_columns(none["users"], ["user_id", "shoe_size"]) == ["shoe_size"]
    with pytest.raises(ValueError, match="answers, users"):
        audit.require(users=none["users"], answers=none["answers"], there=spark.range(1))
    two = spark.createDataFrame([(1, 0, 1, 1), (0, 0, 1, None)], "a int, b int, c int, d int")
    flags = two.select(audit.unflagged(["a", "b"]), audit.unlike({"a": F.col("a"), "b": F.col("b")}, {"a": F.col("c"), "b": F.col("d")})).collect()
    assert [tuple(r) for r in flags] == [(False, True), (True, True)]


def test_tolerant_sources(spark, tmp_path):
    from palaver.sources import tables

    spark.createDataFrame([(1, "x")], "user_id bigint, extra string").write.parquet(str(tmp_path / "users.parquet"))
    got = tables.table_or_empty(spark, str(tmp_path), "users", "user_id bigint, reputation bigint").collect()
    assert [tuple(r) for r in got] == [(1, None)] and tables.table_or_empty(spark, str(tmp_path), "absent", "a int").count() == 0
    (tmp_path / "c.json").write_text('{"n": 2, "clusters": [{"name": "a", "members": [1, 2]}, {"name": "b", "members": []}]}')
    items = tables.json_items(spark, str(tmp_path / "c.json"), "clusters", "name: string, members: array<int>").collect()
    assert [(r["pos"], r["name"], r["members"]) for r in items] == [(0, "a", [1, 2]), (1, "b", [])]
    tables.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "b"]
    df = spark.createDataFrame([(1,)], "old int")
    new = tables.evolved(tables.evolved(df, {"c": F.lit(0)}, {"old": "new"}), {"c": F.lit(9)}, {"old": "new"})
    assert [tuple(r) for r in new.select("new", "c").collect()] == [(1, 0)]
