"""Feature table: nulls, ties, repeated events, empty input, clashing columns, many kinds."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.operators.features import entity_features, entity_lines, kind_list, utc_year

SCHEMA = "entity_id bigint, kind string, value bigint, at bigint"


def rows(df):
    return {r["entity_id"]: (r["n"], r["total"], r["last"]) for r in df.collect()}


def test_counts_totals_and_recency(spark):
    ev = spark.createDataFrame([(1, "a", 5, 10), (1, "a", None, 30), (1, "a", 5, 10), (1, "b", -2, None), (2, "b", None, None), (None, "a", 1, 1), (3, None, 1, 1), (4, "other", 1, 1)], SCHEMA)
    got = rows(entity_features(ev, ["a", "b"]))
    assert got == {1: ([3, 1], [10, -2], [30, None]), 2: ([0, 1], [0, 0], [None, None]), 4: ([0, 0], [0, 0], [None, None])}


def test_all_kinds_and_clashing_columns(spark):
    ev = spark.createDataFrame([(1, "b", 1, 1), (1, "a", 1, 2), (2, "a", 3, 4)], SCHEMA).withColumns({c: F.lit("x") for c in ("salt", "n", "total", "last", "place", "cells")})
    assert kind_list(ev) == ["a", "b"]
    assert rows(entity_features(ev)) == {1: ([1, 1], [1, 1], [2, 1]), 2: ([1, 0], [3, 0], [4, None])}


def test_many_kinds_equal_few(spark):
    ev = spark.createDataFrame([(i % 7, f"k{i % 50:02d}", i, i * 10) for i in range(400)], SCHEMA)
    kinds = kind_list(ev)
    wide = rows(entity_features(ev, kinds))
    for part in range(0, 50, 25):
        narrow = rows(entity_features(ev, kinds[part : part + 25]))
        for e, cells in narrow.items():
            assert [list(c) for c in cells] == [list(c[part : part + 25]) for c in wide[e]]


def test_a_kind_with_no_time_is_null_in_wide_lists(spark):
    ev = spark.createDataFrame([(1, f"k{i:02d}", 1, None) for i in range(40)], SCHEMA)
    assert rows(entity_features(ev))[1][2] == [None] * 40


def test_lines(spark):
    ev = spark.createDataFrame([(1, "a", 5, 10), (1, "b", None, None), (2, "c", -3, 7), (3, "z", 1, 1)], SCHEMA)
    got = rows(entity_lines(ev, F.col("last") + 1, ["a", "b", "c"]))
    assert got == {1: ("1,1,0", "5,0,0", "11,-,-"), 2: ("0,0,1", "0,0,-3", "-,-,8"), 3: ("0,0,0", "0,0,0", "-,-,-")}


def test_empty(spark):
    ev = spark.createDataFrame([], SCHEMA)
    assert entity_lines(ev, F.col("last")).count() == 0
    assert entity_features(ev, ["a"]).count() == 0
    assert entity_features(ev).count() == 0


def test_too_many_kinds_is_an_error(spark):
    ev = spark.createDataFrame([(1, f"k{i}", 1, 1) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError):
        entity_features(ev, max_kinds=4)


def test_hot_group_over_many_partitions(spark):
    ev = spark.range(0, 20000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("entity_id"), F.lit("a").alias("kind"), F.col("id").alias("value"), F.col("id").alias("at"))
    got = rows(entity_features(ev, ["a"], salts=4))
    assert got[-1] == ([13333], [sum(i for i in range(20000) if i % 3)], [19999])
    assert len(got) == 51


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("abc"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30))
def test_against_brute_force(spark, events):
    got = rows(entity_features(spark.createDataFrame([(e, k, v, i) for i, (e, k, v) in enumerate(events)], SCHEMA), list("abc")))
    for e in {x[0] for x in events}:
        mine = [[v for x, kk, v in events if x == e and kk == k] for k in "abc"]
        assert got[e][0] == [len(m) for m in mine]
        assert got[e][1] == [sum(v or 0 for v in m) for m in mine]


def test_year_is_utc(spark):
    df = spark.createDataFrame([(0,), (-1,), (1640995199,), (1640995200,), (None,), (2**62,)], "t bigint")
    assert [r[0] for r in df.select(utc_year(F.col("t"))).collect()] == [1970, 1969, 2021, 2022, None, None]
