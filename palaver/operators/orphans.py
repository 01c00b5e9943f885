"""References to records that do not exist, by range-partitioned binary search.

The key space of each parent table is cut at approximate quantiles of all keys
and references, so every range holds about the same number of rows.  A key that
is a boundary several times - one that holds many references - owns several
ranges: its references are dealt over them by record and only that one parent
key is copied to each.  Parents reach a range first and are kept there as one
sorted array; the references follow in Arrow batches and are looked up by binary
search.  Nothing but the parents of one range is held at a time.

Quantiles steer the balance only; they never change the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.sources.materialize import materialize

LEAST_CUTS = 2048
ROWS_PER_RANGE = 2_000_000
NEVER = np.iinfo(np.int64).max

_OUT = "ref_field string, record_id bigint, month string, fault string"


def range_bounds(keys: DataFrame, domains: Sequence[str], *, rows_per_range: int = ROWS_PER_RANGE) -> dict[str, np.ndarray]:
    """Inner bounds of the ranges of each domain, from ``keys(domain, key)``: one range per ``rows_per_range`` rows, at least one a core."""
    spark = keys.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = {r["domain"]: r["n"] for r in keys.groupBy("domain").agg(F.count("key").alias("n")).collect()}  # one row per domain
    parts = {d: max(least, -(-n.get(d, 0) // rows_per_range)) for d in domains}
    cuts = max(LEAST_CUTS, *parts.values())
    found = {r["domain"]: r["at"] for r in keys.groupBy("domain").agg(F.percentile_approx("key", [(i + 1) / cuts for i in range(cuts - 1)], 4 * cuts).alias("at")).collect()}
    bounds = {}
    for d in domains:
        if not n.get(d) or parts[d] < 2:
            bounds[d] = np.empty(0, np.int64)
            continue
        at = np.sort(np.asarray(found[d], np.int64))
        bounds[d] = at[[i * cuts // parts[d] - 1 for i in range(1, parts[d])]]
    return bounds


def _range_of(bounds: dict[str, np.ndarray], domains: Sequence[str]):
    starts, total = {}, 0
    for d in domains:
        starts[d] = total
        total += len(bounds[d]) + 1

    @F.pandas_udf("lo int, hi int")
    def range_of(domain, key):
        import pandas as pd

        k, of = key.to_numpy(np.int64), domain.to_numpy()
        lo, hi = np.zeros(len(k), np.int32), np.zeros(len(k), np.int32)
        for d in domains:
            at = np.flatnonzero(of == d)
            lo[at] = starts[d] + np.searchsorted(bounds[d], k[at], "left")
            hi[at] = starts[d] + np.searchsorted(bounds[d], k[at], "right")
        return pd.DataFrame({"lo": lo, "hi": hi})

    return range_of, total


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, pieces, keys, seen = None, [], None, None
    for batch in batches:
        part = batch.column("part").to_numpy()
        tag = batch.column("tag").to_numpy()
        key = batch.column("key").to_numpy()
        at = batch.column("at").to_numpy()
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(tag) != 0)) + 1
        faults = np.zeros(len(part), np.int8)
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(part)]):
            if a == b:
                continue
            if part[a] != now:
                now, pieces, keys = part[a], [], None
            if tag[a] == 0:
                pieces.append((key[a:b], at[a:b]))
                keys = None
                continue
            if keys is None:
                keys = np.concatenate([p[0] for p in pieces]) if pieces else np.empty(0, np.int64)
                seen = np.concatenate([p[1] for p in pieces]) if pieces else np.empty(0, np.int64)
                pieces = [(keys, seen)]
            where = np.searchsorted(keys, key[a:b])
            if len(keys):
                where = np.minimum(where, len(keys) - 1)
                hit = keys[where] == key[a:b]
                faults[a:b] = np.where(hit, np.where(seen[where] > at[a:b], 2, 0), 1)
            else:
                faults[a:b] = 1
        bad = np.flatnonzero(faults)
        if len(bad):
            rows = batch.take(pa.array(bad))
            yield pa.RecordBatch.from_arrays(
                [rows.column("ref_field"), rows.column("record_id"), rows.column("month"), pa.array(np.array(["", "missing", "late"])[faults[bad]])],
                names=["ref_field", "record_id", "month", "fault"],
            )


def orphan_references(references: DataFrame, parents: DataFrame, domains: Sequence[str], *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(ref_field, record_id, month, fault) of every reference that leads nowhere or to a later record.

    ``references(domain, ref_field, record_id, key, at, month)`` are probed
    against ``parents(domain, key, at)``; ``at`` is the time in microseconds.
    ``fault`` is 'missing' where the domain has no such key and 'late' where
    the key's first time is after the reference's.  Null references are no
    references; a null time on either side never makes a reference late.
    Repeated parents count by their first time, repeated references each.
    Both sides are written once, for the bounds and for the probe.
    """
    refs = references.where(F.col("key").isNotNull() & F.col("domain").isin(*domains))
    refs = materialize(refs.select("domain", "ref_field", "record_id", "key", "at", "month"), "references")
    tops = parents.where(F.col("key").isNotNull()).groupBy("domain", "key").agg(F.min("at").alias("at"))
    tops = materialize(tops, "parents")
    bounds = range_bounds(refs.select("domain", "key").unionByName(tops.select("domain", "key")), domains, rows_per_range=rows_per_range)
    return _probe_ranges(refs, tops, bounds, domains)


def _probe_ranges(refs: DataFrame, tops: DataFrame, bounds: dict[str, np.ndarray], domains: Sequence[str]) -> DataFrame:
    range_of, total = _range_of(bounds, domains)
    located = F.col("r")
    probes = refs.withColumn("r", range_of("domain", "key")).select(
        (located["lo"] + F.pmod(F.xxhash64("record_id", "ref_field"), located["hi"] - located["lo"] + 1).cast("int")).alias("part"),
        F.lit(1).cast("tinyint").alias("tag"),
        "key",
        F.coalesce("at", F.lit(int(NEVER))).alias("at"),
        "ref_field",
        "record_id",
        "month",
    )
    stored = tops.withColumn("r", range_of("domain", "key")).select(
        F.explode(F.sequence(located["lo"], located["hi"])).alias("part"),
        F.lit(0).cast("tinyint").alias("tag"),
        "key",
        F.coalesce("at", F.lit(-int(NEVER))).alias("at"),
        F.lit(None).cast("string").alias("ref_field"),
        F.lit(None).cast("bigint").alias("record_id"),
        F.lit(None).cast("string").alias("month"),
    )
    return (
        stored.unionByName(probes)
        .repartitionById(total, F.col("part"))
        .sortWithinPartitions("part", "tag", "key")
        .mapInArrow(_probe, _OUT)
    )


def report(misses: DataFrame) -> DataFrame:
    """(ref_field, month, fault) -> n; partial counts are merged map-side, so few hot groups do no harm."""
    return misses.groupBy("ref_field", "month", "fault").agg(F.count(F.lit(1)).alias("n"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))
