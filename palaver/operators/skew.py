"""Per-key results when a few keys hold most rows, by value-frequency compression.

Rows are first grouped by (key, value), which Spark combines map-side: a key
that holds half of all rows shrinks to its distinct values, spread over all
reducers.  Counts, exact distinct counts and modes of a key then come from these
weighted values.  Exact percentiles need the values of a key in order; they are
range-partitioned by (key, value), so a key with very many values spans several
tasks, and each task continues from the summed weights of the tasks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.sources.materialize import materialize

_RESERVED = {"value", "weight", "part", "offset", "total", "upto", "w", "n", "n_values", "n_distinct", "mode"}


def compress(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) -> weight.  Null keys make no group; null values do.  Other columns are ignored; keys named like a result are an error."""
    if clash := _RESERVED & set(keys):
        raise ValueError(f"rename the keys {sorted(clash)}")
    kept = rows
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.select(*keys, F.col(value).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("weight"))


def weighted_summary(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n (all rows), n_values (rows with a value), n_distinct, mode (most frequent value, the smallest on ties).

    A key whose values are all null has n_distinct 0 and a null mode.  All
    columns are fixed-width partial aggregates, combined map-side.
    """
    valued = F.col("value").isNotNull()
    top = F.min(F.when(valued, F.struct((-F.col("weight")).alias("w"), "value")))["value"]  # values of any type that has an order
    return weighted.groupBy(*keys).agg(
        F.sum("weight").alias("n"),
        F.coalesce(F.sum(F.when(valued, F.col("weight"))), F.lit(0)).alias("n_values"),
        F.count(F.when(valued, 1)).alias("n_distinct"),
        top.alias("mode"),
    )


def cumulated(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, weight, upto, total): the weight of a key's values up to each, and of all.  No task gathers a key."""
    keys = list(keys)
    ranged = (
        weighted.where(F.col("value").isNotNull())
        .repartitionByRange(*[F.col(k) for k in keys], F.col("value"))
        .sortWithinPartitions(*keys, "value")
        .withColumn("part", F.spark_partition_id())
    )
    ranged = materialize(ranged, "ranged")  # freezes which task holds what
    shares = ranged.groupBy(*keys, "part").agg(F.sum("weight").alias("w"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select(
        *keys,
        "part",
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"),
        F.sum("w").over(Window.partitionBy(*keys)).alias("total"),
    )
    upto = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.join(offsets, [*keys, "part"]).withColumn("upto", F.col("offset") + F.sum("weight").over(upto))
    return ranks.select(*keys, "value", "weight", "upto", "total")


def weighted_percentiles(weighted: DataFrame, keys: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles per key: the smallest value whose cumulated weight reaches fraction * total.

    ``fractions`` maps result columns to fractions in (0, 1].  Keys without
    values have no row.
    """
    return cumulated(weighted, keys).groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total")), F.col("value"))).alias(name) for name, p in fractions.items()]
    )


def key_summary(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """One row per key with counts, exact distinct count, mode and, if asked, exact percentiles of ``value``."""
    weighted = compress(rows, keys, value)
    if not fractions:
        return weighted_summary(weighted, keys)
    weighted = materialize(weighted, "weighted")
    named = weighted_summary(weighted, keys)
    ranks = weighted_percentiles(weighted, keys, fractions)
    return named.join(ranks, list(keys), "left")


def heavy_keys(summary: DataFrame, total: DataFrame, share: float) -> DataFrame:
    """Keys of ``summary`` holding at least ``share`` of the one-row count ``total``; at most 1/share rows."""
    return summary.where(F.col("n") >= F.lit(share) * total.scalar())


def split_join(many: DataFrame, one: DataFrame, key: str, *, most: int = 200_000) -> DataFrame:
    """Inner join on ``key`` where ``many`` may hold any number of rows of a key.

    The rows of a key with more than ``most`` are dealt over several tasks by
    their hash, and the rows of ``one`` with that key are copied to each.  ``many``
    is read twice, so it should be a written table.  Null keys join nothing.
    """
    heavy = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    heavy = F.broadcast(heavy)  # at most one row per ``most`` rows of ``many``
    dealt = many.join(heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    copied = one.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")
