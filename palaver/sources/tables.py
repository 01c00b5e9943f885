"""Tolerant table readers and the first-row rule.

A table is a Parquet file or folder ``<dir>/<name>.parquet``.  The collectors
write a key several times; the first writer wins, so every consumer reads
through :func:`first_rows`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = {"questions": "question_id", "answers": "answer_id", "comments": "comment_id", "users": "user_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; Catalyst prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_tolerant(df: DataFrame, wanted: Mapping[str, Column]) -> DataFrame:
    """Project ``wanted``; a column that ``df`` lacks takes the given default."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else default).alias(c) for c, default in wanted.items()])


def table_or_empty(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """The table in the columns of ``schema``, those it lacks null; no rows where there is no such table."""
    wanted = spark.createDataFrame([], schema)
    try:
        have = table(spark, sf_dir, name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    return select_tolerant(have, {f.name: F.lit(None).cast(f.dataType) for f in wanted.schema})


def json_items(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """(…, pos) of the items of the array field ``array`` of one JSON document or of a list of them, in their order; ``schema`` is an item's."""
    docs = spark.read.schema(f"`{array}` array<struct<{schema}>>").option("multiLine", True).json(path)
    return docs.select(F.posexplode(array).alias("pos", "item")).select("item.*", "pos")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, replacing what is there; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def evolved(df: DataFrame, add: Mapping[str, Column] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with columns renamed and, unless it has them, added: as often as one likes with the same result."""
    for old, new in (rename or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumns({c: v for c, v in (add or {}).items() if c not in df.columns})


def first_rows(df: DataFrame, key: str, *columns: str, order: str = "collected_at") -> DataFrame:
    """One row per non-null ``key``: the one with the smallest ``order``.

    Rows without a time come last.  Rows that tie are equal by the collectors'
    contract; should they differ, the smallest hash of the projected columns
    decides, so that the result is the same in every run.  Spark limits each
    group before the shuffle (WindowGroupLimit), so a key that holds a third of
    all rows sends one row per map task.
    """
    take = [key, *[c for c in columns if c not in (key, order)]]
    rank = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*take))
    return (
        df.select(*take, order)
        .where(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def first(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """First rows of a collected table, with only ``columns`` besides key and time."""
    return first_rows(table(spark, sf_dir, name), KEYS[name], *columns)
