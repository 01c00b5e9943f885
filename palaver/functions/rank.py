"""Ranks, percentiles and scalings as window expressions; every order has a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A_FLOOR = 0.05


def position_percentile(by: list[str], order: list[Column]) -> Column:
    """i/(n-1) of the i-th row in ``order`` within ``by``; 1.0 for a single row.  Ties differ by position."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return F.when(n == 1, 1.0).otherwise(i / F.nullif(n - 1, F.lit(0)))


def global_percentile(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """``df`` with the position percentile of ``score`` over all rows, without gathering them in one task.

    Rows are range-partitioned and sorted; a task continues from the number of
    rows in the tasks before it.  Null scores have no row.
    """
    from palaver.sources.materialize import materialize

    sorted_ = df.where(F.col(score).isNotNull()).repartitionByRange(score, key).sortWithinPartitions(score, key).withColumn("_part", F.spark_partition_id())
    held = materialize(sorted_, "percentile")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per task
    w = Window.partitionBy(F.lit(0)).orderBy("_part")
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    i = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(score, key)) - 1
    pct = F.when(F.col("_all") == 1, 1.0).otherwise(i / F.nullif(F.col("_all") - 1, F.lit(0)))
    return held.join(F.broadcast(offsets), "_part").withColumn(name, pct).drop("_part", "_before", "_all")  # as many rows as tasks


def average_rank_percentile(by: list[str], value: str) -> Column:
    """Percentile in which equal values share the middle of their band; 1.0 for a single row."""
    w = Window.partitionBy(*by)
    n, same = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(n == 1, 1.0).otherwise((F.rank().over(w.orderBy(value)) - 1 + (same - 1) / 2) / F.nullif(n - 1, F.lit(0)))


def fused_weight(q: Column, a: Column) -> Column:
    """sqrt(q * max(a, floor)), or q where there is no authority."""
    return F.when(a.isNull(), q).otherwise(F.sqrt(q * F.greatest(a, F.lit(A_FLOOR))))


def vote_authority(vote: Column, accepted: Column) -> Column:
    """log1p of the non-negative vote, plus one half, plus one half if accepted."""
    return F.log1p(F.greatest(vote, F.lit(0))) + F.when(accepted, 0.5).otherwise(0.0) + 0.5


def minmax(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``column`` scaled to [0, 1]; 0.0 if all values are equal.  The bounds are two numbers per group."""
    by = by or []
    if not by:
        ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
        held = df.withColumn("_e", ends)
    else:
        held = df.join(df.groupBy(*by).agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("_e")), by)
    span = F.col("_e")["hi"] - F.col("_e")["lo"]
    return held.withColumn(column, F.when(span == 0, F.lit(0.0)).otherwise((F.col(column) - F.col("_e")["lo"]) / span)).drop("_e")


def spearman(df: DataFrame, x: str, y: str, most: int | None = None) -> DataFrame:
    """One row (rho, n): rank correlation with average ranks; null under 3 points or if a side is constant.

    Meant for a bounded number of rows (a top-n); the ranks are taken in one task.
    """
    one = Window.partitionBy(F.lit(0))
    avg = lambda c: F.rank().over(one.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    ranked = (df if most is None else df.limit(most)).select(avg(x).alias("rx"), avg(y).alias("ry"))
    n = F.count(F.lit(1))
    ok = (n >= 3) & (F.count_distinct("rx") > 1) & (F.count_distinct("ry") > 1)
    return ranked.agg(F.when(ok, F.corr("rx", "ry")).alias("rho"), n.alias("n"))
