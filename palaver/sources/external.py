"""Python data sources: tables of a SQLite file, and saved pages of a paginated service.

    spark.dataSource.register(SQLiteTable)
    spark.read.format("sqlite_table").option("path", file).option("table", "questions").load()

    spark.dataSource.register(ReplayedPages)
    spark.read.format("replayed_pages").schema("question_id long, ...").option("path", folder).load()
"""

from __future__ import annotations

import json
import os
import sqlite3
import time
import warnings
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


class SourceError(ValueError):
    """The file is missing, empty, or without the table asked for; each has its own message."""


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise SourceError(f"{path} does not exist")
    if not os.path.getsize(path):
        raise SourceError(f"{path} is empty")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' LIMIT 1").fetchone():
        raise SourceError(f"{path} has no tables")
    return con


def _type(declared: str):
    """Column type by SQLite's affinity rules."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


def sqlite_tables(path: str) -> list[tuple[str, str, str, bool]]:
    """(table, column, declared type, part of the primary key) of every table, for introspection."""
    with _open(path) as con:
        names = [n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return [(t, c, k, bool(pk)) for t in names for c, k, pk in con.execute("SELECT name, type, pk FROM pragma_table_info(?)", (t,))]


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class SQLiteTable(DataSource):
    """One table of a SQLite file, read in ranges of its row ids; ``partitions`` sets their number (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as con:
            found = con.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not found:
            raise SourceError(f"{self.options['path']} has no table {self.options['table']}")
        return found

    def schema(self) -> StructType:
        return StructType([StructField(n, _type(t)) for n, t in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SQLiteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "8")))


class _SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int) -> None:
        self.path, self.schema, self.parts = path, schema, parts
        self.table = '"' + table.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        step = -(-(hi - lo + 1) // self.parts)
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        cast = {LongType: int, DoubleType: float, StringType: str}
        kinds = [cast.get(type(f.dataType)) for f in self.schema]
        names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.schema)
        with _open(self.path) as con:
            for row in con.execute(f"SELECT {names} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (part.lo, part.hi)):
                out = []
                for v, k in zip(row, kinds):
                    try:
                        out.append(v if v is None or k is None else k(v))
                    except (TypeError, ValueError):  # SQLite's types are per value
                        out.append(None)
                yield tuple(out)


class ReplayedPages(DataSource):
    """Items of saved JSON pages ``<path>/<series>/<n>.json``, each ``{"items": [...]}``; one task per series.

    A series is named for what it covers, such as a month.  Pages are read in
    order; two empty ones in a row end a series, ``most`` items end it too, and a
    warning says so.  ``since`` and ``until`` are names: series before the one or
    from the other on are left out.  A page that says ``"backoff"`` or ``"error"``
    is read again up to ``tries`` times (5), waiting twice as long each time from
    ``wait`` seconds on (0.5); then the series fails.  One whose ``quota_remaining``
    is below ``quota`` (0) ends the series with a warning.  Fields that an item
    lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "replayed_pages"

    def schema(self) -> StructType:
        raise SourceError("give a schema: pages have none")

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return _PageReader(
            o["path"], schema, int(o.get("most", "0")), o.get("since", ""), o.get("until", ""), int(o.get("tries", "5")), float(o.get("wait", "0.5")), int(o.get("quota", "0"))
        )


class _Series(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class _PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int, since: str, until: str, tries: int, wait: float, quota: int) -> None:
        self.path, self.schema, self.most = path, schema, most
        self.since, self.until, self.tries, self.wait, self.quota = since, until, tries, wait, quota

    def partitions(self) -> list[InputPartition]:
        found = sorted((e for e in os.scandir(self.path) if e.is_dir()), key=lambda e: e.name)
        return [_Series(e.path) for e in found if e.name >= self.since and (not self.until or e.name < self.until)]

    def _page(self, path: str) -> dict:
        wait = self.wait
        for left in reversed(range(self.tries)):
            with open(path) as f:
                page = json.load(f)
            if "backoff" not in page and "error" not in page:
                return page
            if left:
                time.sleep(max(wait, float(page.get("backoff", 0))))
                wait *= 2
        raise SourceError(f"{path} gave no answer in {self.tries} tries")

    def read(self, part: _Series) -> Iterator[tuple]:
        empty = given = 0
        for name in sorted(os.listdir(part.folder), key=lambda n: int(n.split(".")[0])):
            page = self._page(os.path.join(part.folder, name))
            items = page.get("items", [])
            empty = 0 if items else empty + 1
            if empty == 2:
                return
            for item in items:
                yield tuple(item.get(f.name) for f in self.schema)
                given += 1
                if given == self.most:
                    warnings.warn(f"{part.folder}: stopped at {self.most} items", stacklevel=1)
                    return
            if page.get("quota_remaining", self.quota) < self.quota:
                warnings.warn(f"{part.folder}: stopped after {given} items, the quota is used up", stacklevel=1)
                return
