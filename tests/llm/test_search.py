"""Near-duplicates, similar vectors and term counts against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import neardup, terms, vectors
from palaver.llm.queries import REGISTRY
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_against_sql(spark, name):
    compare(spark, REGISTRY.queries[name], REGISTRY.sql[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_runs(spark, name):
    assert REGISTRY.queries[name](spark, DATA).count() >= 0


# --- near-duplicates ------------------------------------------------------------


def shingles(text, n=3):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def edited(rnd, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)


def test_sketch_estimates_the_similarity():
    how = neardup.Sketch(compared=1000)
    rnd = random.Random(5)
    for share in (0.02, 0.1, 0.3):
        base = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(150))
        a, b = neardup.shingle_sets([base, edited(rnd, base, share)], 3)
        ra, rb = neardup.registers([a, b], how, how.registers)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        up, down = (ra > rb).sum(), (ra < rb).sum()
        got = neardup.estimate(*(np.array([x]) for x in (up, down, how.registers - up - down, len(a), len(b))), how.base)[0]
        assert abs(got - true) < 0.07
        union = neardup.registers([np.union1d(a, b)], how, how.registers)[0]
        assert (union == np.maximum(ra, rb)).all()  # registers merge


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(800)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 90))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        rows.append((100 + i, edited(rnd, rnd.choice(base), rnd.choice([0.0, 0.02, 0.05, 0.1, 0.15]))))
    rows += [(300 + i, base[0].upper() + "!") for i in range(60)]  # a third are copies
    rows += [(900, None), (901, ""), (902, "two words"), (903, "two words"), (904, "Just three words"), (905, "just, three... WORDS"), (906, "long " * 40000)]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumns({c: F.lit("x") for c in ("id", "text", "class", "a", "b")})
    found = neardup.near_duplicates(df, "k", F.col("t"))
    sets = {k: shingles(t) for k, t in rows}
    true = {(x, y): jaccard(sets[x], sets[y]) for x in sets for y in sets if x < y}
    want = {p for p, j in true.items() if j >= 0.5}
    got = [(r["id_a"], r["id_b"]) for r in neardup.duplicate_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.002 * len(want)
    groups = {r["id"]: r for r in neardup.duplicate_groups(found).collect()}
    assert set(groups) == {k for k, s in sets.items() if s}
    assert groups[904]["class_id"] == groups[905]["class_id"] == 904
    assert len({groups[300 + i]["class_id"] for i in range(60)}) == 1
    for a, b in got:
        assert groups[a]["group_id"] == groups[b]["group_id"]


def test_hot_bucket_leaves_as_blocks():
    who = np.arange(100, dtype=np.int64)
    lists = list(neardup._pairs_in(np.zeros(100, np.uint32), who, 16))
    assert all(cross for *_, cross in lists) and max(len(a) for a, *_ in lists) <= 16
    assert {(x, y) for a, b, _ in lists for x in a for y in b if x < y} == {(x, y) for x in who for y in who if x < y}


def variants(rnd, n):
    """Texts that share a template with some edits each: many pairs above and below the threshold, all in the same buckets."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
    return [(i, edited(rnd, " ".join(base), rnd.choice([0.03, 0.08, 0.15]))) for i in range(n)]


def test_hot_buckets_lose_no_pair(spark):
    rows = variants(random.Random(21), 150)
    df = spark.createDataFrame(rows, "k bigint, t string")
    sets = {k: shingles(t) for k, t in rows}
    want = {(x, y) for x in sets for y in sets if x < y and jaccard(sets[x], sets[y]) >= 0.5}
    pairs = lambda how: {(r["id_a"], r["id_b"]) for r in neardup.duplicate_pairs(neardup.near_duplicates(df, "k", F.col("t"), how), part=7).collect()}
    narrow, wide = pairs(neardup.Sketch(block=16)), pairs(neardup.Sketch(block=10**6))
    assert narrow == wide and narrow <= want and len(want - narrow) <= 0.002 * len(want) and len(want) > 500


def test_copies_in_parts(spark):
    df = spark.createDataFrame([(i, "one two three four") for i in range(40)] + [(99, "one two three four five")], "k bigint, t string")
    got = [(r["id_a"], r["id_b"]) for r in neardup.duplicate_pairs(neardup.near_duplicates(df, "k", F.col("t")), part=6).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in [*range(40), 99] for b in [*range(40), 99] if a < b}


def test_sets_with_one_name_are_told_apart(spark):
    rows = [(1, 5, 0), (2, 5, 0), (3, 5, 9), (4, 6, 1), (5, 5, 8)]
    drawn = spark.createDataFrame([(i, c, k, 1, b"") for i, c, k in rows], "id bigint, class bigint, check bigint, n bigint, regs binary")
    told, renamed = neardup._told_apart(drawn, spark.createDataFrame([(5, 0)], "class bigint, least bigint"))
    name = {r["id"]: r["class"] for r in told.collect()}
    assert name[1] == name[2] == 5 and name[4] == 6 and len({5, name[3], name[5]}) == 3
    pairs = neardup._with_renamed(spark.createDataFrame([(5, 6)], "a bigint, b bigint"), renamed)
    group = {5, name[3], name[5]}
    assert {frozenset(r) for r in pairs.collect()} == {frozenset((x, 6)) for x in group} | {frozenset((x, y)) for x in group for y in group if x != y}
    blocks = neardup._blocks_with_renamed(spark.createDataFrame([([5, 6], [7, 8], True)], "a array<bigint>, b array<bigint>, cross boolean"), renamed).first()
    assert set(blocks["a"]) == group | {6} and blocks["b"] == [7, 8]


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "k bigint, t string"), "k", F.col("t"))
    assert neardup.duplicate_pairs(found).count() == 0 and neardup.duplicate_groups(found).count() == 0


# --- vectors --------------------------------------------------------------------

HOW = vectors.Scan(dim=32, list_size=100)


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    return c


def clustered(n=900, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 2
    return (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))).astype(np.float32)


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "k bigint, e array<float>")


def test_recall(spark):
    x = clustered()
    c = cosines(x.astype(np.float64))
    got = collections.defaultdict(dict)
    for r in vectors.nearest(table(spark, x), "k", "e", how=HOW).collect():
        got[r["id"]][r["neighbour"]] = r["cosine"]
    hits = sum(len(set(np.argsort(-c[i])[:5]) & set(got[i])) for i in range(len(x)))
    assert hits >= 0.9 * 5 * len(x)
    assert all(abs(c[i, j] - s) < 2e-3 for i in got for j, s in got[i].items())


def dense_third(dim=128, seed=6):
    """2,000 vectors around 200 centres, then 1,000 noisy copies of one vector: a group of cosines about 0.85."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((200, dim))[rng.integers(0, 200, 2000)] + 0.6 * rng.standard_normal((2000, dim))
    one = rng.standard_normal(dim)
    return np.r_[x, one + 0.42 * rng.standard_normal((1000, dim))].astype(np.float32)


def test_recall_in_a_dense_group_over_many_lists(spark):
    x, how = dense_third(), vectors.Scan(dim=128, list_size=10)
    df = table(spark, x)
    lists = vectors.fit(df.select(F.col("k").alias("id"), F.col("e").alias("embedding")), how)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(set(lists.home(u[2000:], u[2000:]))) >= 40
    c = cosines(x.astype(np.float64))
    got = collections.defaultdict(set)
    for r in vectors.nearest(df, "k", "e", how=how).collect():
        got[r["id"]].add(r["neighbour"])
    group = range(2000, 3000)
    assert sum(len(set(np.argsort(-c[i])[:5]) & got[i]) for i in group) >= 0.9 * 5 * len(group)
    close = {(i, j) for i in group for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.8}
    found = {(r["id"], r["neighbour"]) for r in vectors.nearest(df, "k", "e", floor=0.8, how=how).collect()}
    assert len(close & found) >= 0.9 * len(close)


def test_floor_keeps_every_close_pair(spark):
    x = clustered(400)
    x = np.r_[x, x[:200] + 0.05 * np.random.default_rng(9).standard_normal((200, 32))].astype(np.float32)
    c = cosines(x.astype(np.float64))
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.95}
    got = {(r["id"], r["neighbour"]) for r in vectors.nearest(table(spark, x), "k", "e", floor=0.95, how=HOW).collect()}
    assert len(want & got) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_copies_ties_and_broken_rows(spark):
    x = clustered(60)
    ids = [*range(60), *range(100, 140), 7]
    rows = table(spark, np.r_[x, np.repeat(x[:1], 40, 0), x[7:8]], ids)
    broken = spark.createDataFrame([(200, None), (201, []), (202, [1.0] * 31), (203, [0.0] * 32), (204, [float("nan")] * 32), (205, [None] + [1.0] * 31), (None, [1.0] * 32)], "k bigint, e array<float>")
    both = rows.unionByName(broken).withColumns({c: F.lit("x") for c in ("id", "embedding", "list", "kind")})
    got = collections.defaultdict(list)
    for r in vectors.nearest(both, "k", "e", how=HOW).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    assert set(got) == set(range(60)) | set(range(100, 140))
    assert all(len(v) == 5 == len(set(v)) and k not in v for k, v in got.items())
    assert got[0] == [100, 101, 102, 103, 104] and got[101] == [0, 100, 102, 103, 104]  # equal vectors: smaller ids first


def test_fewer_rows_than_neighbours_and_none(spark):
    assert {(r["id"], r["neighbour"]) for r in vectors.nearest(table(spark, clustered(3)), "k", "e", how=HOW).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert vectors.nearest(table(spark, clustered(1)), "k", "e", how=HOW).count() == 0
    assert vectors.nearest(spark.createDataFrame([], "k bigint, e array<float>"), "k", "e", how=HOW).count() == 0


def index(spark, folder):
    """Usable vectors of the stored index by id."""
    rows = spark.read.parquet(f"{folder}/canonical_index.parquet").select("question_id", "embedding")
    held = rows.toArrow()
    ok, x = vectors.matrix(held.column("embedding"), 1536)
    ids = held.column("question_id").to_numpy()[ok].astype(np.float64)
    known = ~np.isnan(ids)
    unique, at = np.unique(ids[known].astype(np.int64), return_index=True)
    return rows, unique, x[known][at]


def answers(rows, **how):
    got = collections.defaultdict(dict)
    for r in vectors.nearest(rows, "question_id", **how).collect():
        got[r["id"]][r["neighbour"]] = r["cosine"]
    return got


def recall(ids, x, got, k=5):
    """Share of the true k nearest that were found; cosines within 1e-9 of the k-th are as good."""
    hits = 0
    for s in range(0, len(ids), 500):
        c = x[s : s + 500].astype(np.float64) @ x.T.astype(np.float64)
        c[np.arange(len(c)), np.arange(s, s + len(c))] = -2
        for row, i in zip(c, ids[s : s + 500]):
            hits += len({ids[j] for j in np.argsort(-row, kind="stable")[:k]} & set(got[i]))
    return hits / (k * len(ids))


@pytest.mark.parametrize("how", [vectors.Scan(list_size=50), vectors.Scan(list_size=50, flat=8, block=40)], ids=["one level", "two levels, blocks"])
def test_recall_over_many_lists(spark, how):
    """The whole index of sf0.1, 1,536 dimensions, over 40 lists; by pairs of centres and split lists too."""
    rows, ids, x = index(spark, "/root/testdata/sf0.1")
    lists = vectors.fit(rows.where("question_id IS NOT NULL AND embedding IS NOT NULL").withColumnRenamed("question_id", "id"), how)
    used = len(set(lists.home(x, x @ vectors.rotation(1536, how.seed)[:, : how.leading])))
    assert used >= 40
    got = answers(rows, how=how)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    share = recall(ids, x, got)
    print(f"recall over {used} lists: {share:.4f}")
    assert share >= 0.9


def test_exact_is_brute_force(spark):
    rows, ids, x = index(spark, "/root/testdata/sf0.01")
    got = answers(rows, how=vectors.Scan(list_size=20, flat=4, block=16), exact=True)
    assert recall(ids, x, got) == 1


def test_open_choices_are_settled_in_double_precision(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(64)
    near = one + 0.5 * rng.standard_normal((40, 64)) / 1
    # forty candidates whose cosines to the first differ by less than half precision tells
    u = one / np.linalg.norm(one)
    side = near - (near @ u)[:, None] * u
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = 0.8 + 2e-6 * np.arange(40)[:, None]
    x = np.r_[u[None], angle * u + np.sqrt(1 - angle**2) * side].astype(np.float32)
    c = cosines(x.astype(np.float64))
    how = vectors.Scan(dim=64, epsilon=9.0)
    got = {r["neighbour"] for r in vectors.nearest(table(spark, x), "k", "e", how=how).where("id = 0").collect()}
    assert got == {int(j) for j in np.argsort(-c[0])[:5]}
    kept = {r["neighbour"] for r in vectors.nearest(table(spark, x), "k", "e", k=40, floor=0.80004, how=how).where("id = 0").collect()}
    assert kept == {int(j) for j in np.flatnonzero(c[0] >= 0.80004)}


def test_small_lists_send_their_vectors_further():
    near = np.array([[1.0, 0.2, 0.5, 0.1], [0.1, 0.9, 0.2, 0.0]])
    go = vectors.visited(near, np.array([1, 9, 2, 50]), 0.06, 6)
    assert go.tolist() == [[True, True, True, False], [False, True, False, False]]
    assert vectors.visited(near, np.array([1, 1, 1, 1]), 0.06, 6).all()  # fewer ids than wanted: everywhere


def test_large_lists_are_split():
    n, start = vectors.blocks_of(np.array([0, 1, 40, 41, 0, 400]), 40)
    assert n.tolist() == [0, 1, 1, 2, 0, 10] and start.tolist() == [0, 0, 1, 2, 4, 4]


# --- terms ----------------------------------------------------------------------


def test_trie_counts_and_bursts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(3000)]
    trie = terms.BurstTrie(burst=4)
    for w in words:
        trie.add(w, 1, 1)
    got = {p + s: c[0] for p, leaf in trie.leaves() for s, c in leaf.items()}
    assert got == collections.Counter(words) and trie.size == len(got)


@pytest.mark.parametrize("sizes", [{}, {"burst": 3, "max_terms": 20, "per_route": 100, "least_routes": 2}, {"burst": 2, "per_route": 10**9, "least_routes": 1}])
def test_terms_against_brute_force(spark, sizes):
    rnd = random.Random(8)
    vocab = ["hot"] * 300 + ["".join(rnd.choice("abcé中") for _ in range(rnd.randrange(1, 6))) for _ in range(400)] + ["x" * 5000]
    rows = [(i, [rnd.choice(vocab) for _ in range(rnd.randrange(6))]) for i in range(800)] + [(900, None), (901, []), (902, [None, "", "a", "a"])]
    df = spark.createDataFrame(rows, "i bigint, t array<string>").repartition(5).withColumns({c: F.lit("q") for c in ("term", "uses", "prefix")})
    got = [(r["term"], r["uses"], r["records"]) for r in terms.term_frequencies(df, "t", **sizes).collect()]
    uses = collections.Counter(t for _, ts in rows for t in ts or [] if t)
    docs = collections.Counter(t for _, ts in rows for t in {*(ts or [])} if t)
    assert sorted(got) == sorted((t, n, docs[t]) for t, n in uses.items())


def test_terms_of_nothing(spark):
    assert terms.term_frequencies(spark.createDataFrame([], "t array<string>"), "t").count() == 0
