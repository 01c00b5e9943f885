"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    """DuckDB with one view per table of ``folder``."""
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    if isinstance(v, float) and np.isnan(v):
        return None
    return tuple(v) if isinstance(v, (list, np.ndarray)) else v


def compare(spark: SparkSession, query, sql: str, folder: str = DATA) -> None:
    """Assert equal columns and equal bags of rows."""
    df = query(spark, folder)
    rel = connection(folder).sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    mine = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
