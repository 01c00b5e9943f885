"""Per-key results under skew against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.operators.skew import compress, heavy_keys, key_summary, split_join


def brute(rows):
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    out = {}
    for k, vs in by.items():
        real = sorted(v for v in vs if v is not None)
        mode = min(Counter(real).items(), key=lambda x: (-x[1], x[0]))[0] if real else None
        at = lambda p: real[math.ceil(p * len(real)) - 1] if real else None
        out[k] = (len(vs), len(real), len(set(real)), mode, at(0.5), at(0.9))
    return out


def summary(df):
    return {r["k"]: (r["n"], r["n_values"], r["n_distinct"], r["mode"], r["p50"], r["p90"]) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(1000)) for _ in range(3000)] + [(rnd.choice([2, 3, None]), rnd.choice([None, 1, 1, -7, 9])) for _ in range(300)] + [(4, None), (5, 2), (5, 1)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7).withColumns({c: F.lit("x") for c in ("value", "weight", "part", "total")})
    assert summary(key_summary(df, ["k"], "v", {"p50": 0.5, "p90": 0.9})) == brute(rows)


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], "k bigint, v bigint")
    assert key_summary(df, ["k"], "v", {"p50": 0.5}).count() == 0
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, 1)], "value bigint, v bigint"), ["value"], "v")


def test_heavy_keys_at_the_limit(spark):
    df = spark.createDataFrame([(1, 0)] * 2 + [(2, 0)] + [(None, 0)] * 97, "k bigint, v bigint")
    got = heavy_keys(key_summary(df, ["k"], "v"), df.agg(F.count(F.lit(1))), 0.02)
    assert [r["k"] for r in got.collect()] == [1]


def test_mode_of_texts(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, None)], "k bigint, v string")
    assert {r["k"]: r["mode"] for r in key_summary(df, ["k"], "v").collect()} == {1: "a", 2: None}


def test_split_join_equals_a_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (2, 0), (3, 1), (None, 2)], "k bigint, v bigint")
    one = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (4, "q"), (None, "n")], "k bigint, t string")
    want = sorted(map(tuple, many.join(one, "k").select("k", "v", "t").collect()))
    assert sorted(map(tuple, split_join(many, one, "k", most=40).select("k", "v", "t").collect())) == want
    assert split_join(many.limit(0), one, "k").count() == 0
