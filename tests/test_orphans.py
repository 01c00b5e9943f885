"""Orphan references: every fault, nulls, repeats, hot keys, empty sides."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from palaver.operators.orphans import orphan_references, range_bounds, report

REFS = "domain string, ref_field string, record_id bigint, key bigint, at bigint, month string"
TOPS = "domain string, key bigint, at bigint"


def run(spark, refs, tops, **kw):
    found = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(tops, TOPS), ("d", "e"), **kw)
    return sorted((r["ref_field"], r["record_id"], r["fault"]) for r in found.collect())


def test_faults(spark):
    tops = [("d", 1, 10), ("d", 1, 5), ("d", 2, 50), ("e", 3, 1), ("d", None, 1), ("d", 4, None)]
    refs = [
        ("d", "f", 1, 1, 5, "m"), ("d", "f", 2, 1, 4, "m"), ("d", "f", 3, 2, 49, "m"), ("d", "f", 4, 3, 9, None), ("e", "g", 5, 3, 9, "m"),
        ("e", "g", 6, 0, 9, "m"), ("d", "f", 7, None, 1, "m"), ("d", "f", 8, 2, None, "m"), ("d", "f", 9, 4, 1, "m"), ("other", "h", 10, 1, 1, "m"), ("d", "f", 2, 1, 4, "m"),
    ]
    assert run(spark, refs, tops) == [("f", 2, "late"), ("f", 2, "late"), ("f", 3, "late"), ("f", 4, "missing"), ("g", 6, "missing")]


def test_empty_sides(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("d", 1, 1)]) == []
    assert run(spark, [("d", "f", 1, 1, 1, "m")], []) == [("f", 1, "missing")]


def test_hot_keys_over_several_ranges(spark):
    rnd = random.Random(1)
    tops = [("d", k, rnd.randrange(100)) for k in range(0, 400, 2)] + [("e", k, 0) for k in range(5)]
    refs = [("d", "f", i, 100 if i % 3 == 0 else (7 if i % 3 == 1 else rnd.randrange(450)), rnd.randrange(100), "m") for i in range(3000)]
    refs += [("e", "g", i, rnd.randrange(7), 1, "m") for i in range(200)]
    first = {(d, k): t for d, k, t in tops}
    want = []
    for d, f, i, k, t, _ in refs:
        if (d, k) not in first:
            want.append((f, i, "missing"))
        elif first[d, k] > t:
            want.append((f, i, "late"))
    keys = spark.createDataFrame([(r[0], r[3]) for r in refs], "domain string, key bigint")
    bounds = range_bounds(keys, ("d", "e"), rows_per_range=50)
    assert (bounds["d"] == 100).sum() > 5  # a hot key owns several ranges
    assert run(spark, refs, tops, rows_per_range=50) == sorted(want)


def test_report_and_clashing_columns(spark):
    refs = spark.createDataFrame([("d", "f", i, i % 3, 1, f"2024-0{i % 2 + 1}") for i in range(12)], REFS).withColumns({c: F.lit(9) for c in ("part", "tag", "r", "fault")})
    tops = spark.createDataFrame([("d", 1, 0)], TOPS).withColumn("part", F.lit("x"))
    got = {(r["month"], r["fault"]): r["n"] for r in report(orphan_references(refs, tops, ("d",))).collect()}
    assert got == {("2024-01", "missing"): 4, ("2024-02", "missing"): 4}
