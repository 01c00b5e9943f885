"""Write semantics of the store on plain Parquet tables: first wins, last wins, replace a group, update a column.

Each returns the new content; :func:`overwrite` swaps it in.  A lakehouse table
format would do the same by MERGE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.sources.materialize import materialize


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key is not there; of equal new keys the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    firsts = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return existing.unionByName(firsts.join(existing.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def insert_or_replace(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``new`` plus the rows of ``existing`` whose key is not in it; of equal new keys the last by ``order`` (given ascending)."""
    n = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    last = n.withColumn("_last", F.max("_rank").over(Window.partitionBy(*keys))).where("_rank = _last").drop("_rank", "_last")
    return last.unionByName(existing.join(last.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_groups(existing: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """``new`` plus the rows of ``existing`` in groups that ``new`` does not touch: an idempotent restage."""
    return new.unionByName(existing.join(new.select(*group).distinct(), list(group), "left_anti"), allowMissingColumns=True)


def update_columns(existing: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with the non-null values of ``changes``, one row per key; columns it lacks are added."""
    new = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = existing.join(renamed, list(keys), "left")
    cols = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in existing.columns else F.col(f"_new_{c}") for c in new}
    return joined.withColumns(cols).drop(*[f"_new_{c}" for c in new])


def overwrite(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``, also when ``df`` reads it; with partitions only those in ``df``."""
    held = materialize(df, "overwrite")
    w = held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def undone(work: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The work whose keys the ledger does not list: resume without repeating."""
    return work.join(ledger.select(*keys).distinct(), list(keys), "left_anti")
