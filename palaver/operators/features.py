"""Per-entity feature table from events, by two-stage salted aggregation.

Stage 1 groups by (entity, kind, salt).  The salt is the number of the scan
partition, so an entity-kind group of any size is spread over up to ``salts``
reducers, while light groups gain no rows: within one map task the salt is
constant and the map-side combine still merges everything.  Stage 2 merges the
partial statistics - all mergeable: count, sum, max.  It is partitioned by
entity alone, which also satisfies stage 3, so that gathering the kinds of an
entity costs no further shuffle.  Stage 3 expands the complete kind list: as
aggregates for a few kinds, by scattering into dense Arrow lists for many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import year_of
from palaver.sources.materialize import materialize

SALTS = 32
MAX_KINDS = 20_000
NARROW = 32
_CELLS = 4_000_000
_NONE = -(2**63)


def merged_stats(events: DataFrame, *, salts: int = SALTS, partition_by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """(entity_id, kind) -> n, total, last of ``events(entity_id, kind, value, at)``.

    Null entities and null kinds are no groups.  Null values add nothing to
    ``total`` (0 if all are null); ``last`` is null if no event has a time.
    """
    partial = (
        events.where(F.col("entity_id").isNotNull() & F.col("kind").isNotNull())
        .select("entity_id", "kind", "value", "at", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
        .groupBy("entity_id", "kind", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("at").alias("last"))
    )
    return (
        partial.repartition(*[F.col(c) for c in partition_by])
        .groupBy("entity_id", "kind")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
            F.max("last").alias("last"),
        )
    )


def kind_list(events: DataFrame, *, max_kinds: int = MAX_KINDS) -> list[str]:
    """All kinds, sorted.  A table as wide as its vocabulary has a bound: more than ``max_kinds`` are an error, not cut off."""
    kinds = events.where(F.col("entity_id").isNotNull() & F.col("kind").isNotNull()).select("kind").distinct()
    found = [r["kind"] for r in kinds.limit(max_kinds + 1).collect()]
    if len(found) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of events; name the kinds wanted or raise max_kinds")
    return sorted(found)


def entity_features(events: DataFrame, kinds: Sequence[str] | None = None, *, salts: int = SALTS, max_kinds: int = MAX_KINDS) -> DataFrame:
    """One row per entity: ``entity_id`` and the arrays ``n``, ``total``, ``last`` along ``kinds``.

    ``kinds`` lists the kinds in order; None takes :func:`kind_list`.  A kind
    that an entity never had counts 0, its total is 0 and its last time null.
    Events of a kind not listed still make their entity a row.  No events give
    no rows; other columns of ``events`` are ignored.
    """
    kinds, stats = _listed(events, kinds, salts, max_kinds)
    if len(kinds) <= NARROW:
        cell = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
        zero = F.lit(0).cast("bigint")
        return stats.groupBy("entity_id").agg(
            F.array(*[F.coalesce(cell(k, "n"), zero) for k in kinds]).cast("array<bigint>").alias("n"),
            F.array(*[F.coalesce(cell(k, "total"), zero) for k in kinds]).cast("array<bigint>").alias("total"),
            F.array(*[cell(k, "last") for k in kinds]).cast("array<bigint>").alias("last"),
        )
    sparse = _cells(stats, kinds, F.coalesce("last", F.lit(_NONE)))
    width = len(kinds)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _CELLS // width)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                cells = batch.column("cells")
                sizes = np.diff(cells.offsets.to_numpy())
                at = np.repeat(np.arange(len(sizes)), sizes)
                flat = cells.flatten()
                place = flat.field("place").to_numpy()
                use = place >= 0
                where = (at * width + place)[use]
                out = []
                for name, none in (("n", 0), ("total", 0), ("last", _NONE)):
                    dense = np.full(len(sizes) * width, none, np.int64)
                    dense[where] = flat.field(name).to_numpy()[use]
                    values = pa.array(dense, mask=dense == _NONE if name == "last" else None)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width), values))
                yield pa.RecordBatch.from_arrays([batch.column("entity_id"), *out], names=["entity_id", "n", "total", "last"])

    return sparse.mapInArrow(expand, "entity_id bigint, n array<bigint>, total array<bigint>, last array<bigint>")


def _listed(events: DataFrame, kinds: Sequence[str] | None, salts: int, max_kinds: int) -> tuple[list[str], DataFrame]:
    """(kinds, merged statistics); where the kinds are not given they are read off the statistics, which are written once."""
    stats = merged_stats(events, salts=salts)
    if kinds is not None:
        return list(kinds), stats
    stats = materialize(stats, "stats")
    return kind_list(stats, max_kinds=max_kinds), stats


def _cells(stats: DataFrame, kinds: Sequence[str], last: Column) -> DataFrame:
    """(entity_id, cells) with one cell (place, n, total, last) per kind the entity had; place -1 for kinds not listed."""
    places = stats.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kinds)], "kind string, place int")
    cell = F.struct(F.coalesce("place", F.lit(-1)).alias("place"), "n", "total", last.alias("last"))
    placed = stats.join(F.broadcast(places), "kind", "left")  # at most max_kinds rows
    return placed.groupBy("entity_id").agg(F.collect_list(cell).alias("cells"))


def entity_lines(events: DataFrame, last: Column, kinds: Sequence[str] | None = None, *, salts: int = SALTS, max_kinds: int = MAX_KINDS) -> DataFrame:
    """As :func:`entity_features` with the three lists as comma-separated text, for exchange as plain files.

    ``last`` turns the column ``last`` of the statistics into what is shown; '-' stands where it is null.
    """
    kinds, stats = _listed(events, kinds, salts, max_kinds)
    width = len(kinds)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                cells = batch.column("cells")
                ends = np.r_[0, np.cumsum(np.diff(cells.offsets.to_numpy()))]
                flat = cells.flatten()
                place = flat.field("place").to_pylist()
                out = []
                for name, none in (("n", "0"), ("total", "0"), ("last", "-")):
                    shown = flat.field(name).cast(pa.string()).fill_null(none).to_pylist()
                    lines = []
                    for a, b in zip(ends[:-1], ends[1:]):
                        line = [none] * width
                        for at, text in zip(place[a:b], shown[a:b]):
                            if at >= 0:
                                line[at] = text
                        lines.append(",".join(line))
                    out.append(pa.array(lines, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("entity_id"), *out], names=["entity_id", "n", "total", "last"])

    return _cells(stats, kinds, last.cast("string")).mapInArrow(expand, "entity_id bigint, n string, total string, last string")


def pick(kinds: Sequence[str], part: str, kind: str) -> Column:
    """The cell of ``kind`` in array ``part`` of a table built with the list ``kinds``."""
    return F.col(part)[list(kinds).index(kind)]


def utc_year(epoch: Column) -> Column:
    """Calendar year of epoch seconds in UTC, whatever the session's zone; null where no date is that far away."""
    return year_of(epoch)
