"""Occurrences and record counts of every distinct term, by burst-trie counting.

Each task counts the terms of its records in a burst trie: inner nodes branch on
one character, leaves are compact containers of suffixes with two counters, and
a container bursts into inner nodes when it holds too many terms.  Leaves leave
the task as rows (prefix, suffixes, counters).  Prefixes that hold many terms
anywhere become routes; every container is sent, or divided, to the longest
route that starts its terms - terms under no route go by a hash - and there the
subtrees of all workers are merged, one route at a time.

Routes only balance the load; their number follows from the number of terms in
all leaves, and the result is the same for any set of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.sources.materialize import materialize

BURST = 256
PER_ROUTE = 20_000
LEAST_ROUTES = 1024
MAX_TERMS = 1_000_000
_STEP = 5000

_LEAF = "prefix string, suffixes array<string>, uses array<bigint>, records array<bigint>"
_NAMES = ["prefix", "suffixes", "uses", "records"]


class BurstTrie:
    """Terms with two counters each; leaves are dicts suffix -> [uses, records], inner nodes dicts character -> node."""

    class _Leaf(dict):
        pass

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.root = self._Leaf()
        self.size = 0

    def add(self, term: str, uses: int, records: int) -> None:
        """Count ``term``, a non-empty string."""
        node, parent, depth = self.root, None, 0
        while type(node) is dict:
            c = term[depth : depth + 1]
            parent, node = node, node.get(c)
            if node is None:
                node = parent[c] = self._Leaf()
            depth += 1
            if not c:  # the term ends at this inner node
                break
        rest = term[depth:]
        held = node.get(rest)
        if held is not None:
            held[0] += uses
            held[1] += records
            return
        node[rest] = [uses, records]
        self.size += 1
        if len(node) > self.burst:
            inner: dict = {}
            for suffix, counts in node.items():
                inner.setdefault(suffix[:1], self._Leaf())[suffix[1:]] = counts
            if parent is None:
                self.root = inner
            else:
                parent[term[depth - 1]] = inner

    def add_leaf(self, prefix: str, suffixes: list[str], uses: list[int], records: list[int]) -> None:
        """Merge a leaf of another trie."""
        for s, u, r in zip(suffixes, uses, records):
            self.add(prefix + s, u, r)

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """(prefix, container) of each leaf."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if type(node) is dict:
                todo += [(prefix + c, n) for c, n in node.items()]
            elif node:
                yield prefix, node


def _rows(leaves: Iterator[tuple[str, dict]]) -> Iterator[pa.RecordBatch]:
    held: list = []
    size = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held))
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)

    for prefix, node in leaves:
        items = sorted(node.items())
        held.append((prefix, [s for s, _ in items], [c[0] for _, c in items], [c[1] for _, c in items]))
        size += len(items)
        if size >= _STEP:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def partial_tries(records: DataFrame, terms: str, *, burst: int = BURST, max_terms: int = MAX_TERMS) -> DataFrame:
    """The leaves of one trie per task over the array column ``terms``; a trie of ``max_terms`` is put out and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in batches:
            uses: Counter = Counter()
            seen: Counter = Counter()
            for ts in batch.column(0).to_pylist():
                if ts:
                    here = [t for t in ts if t]
                    uses.update(here)
                    seen.update(set(here))
            for t, n in uses.items():
                trie.add(t, n, seen[t])
            if trie.size >= max_terms:
                yield from _rows(trie.leaves())
                trie = BurstTrie(burst)
        yield from _rows(trie.leaves())

    return records.select(terms).mapInArrow(run, _LEAF)


def route_of(term: str, routes: frozenset[str], longest: int, spread: int) -> str:
    """The longest route that starts ``term``; without one, a bucket by hash, which no prefix equals."""
    for n in range(min(longest, len(term)), 0, -1):
        if term[:n] in routes:
            return term[:n]
    return f"\0{zlib.crc32(term.encode()) % spread}"


def merge_tries(leaves: DataFrame, *, per_route: int = PER_ROUTE, least_routes: int = LEAST_ROUTES, burst: int = BURST) -> DataFrame:
    """(term, uses, records) from leaves of many tries.

    There is one route, and one bucket for the terms under none, per ``per_route``
    terms of the leaves - an upper bound of what a merged trie holds on average -
    but at least ``least_routes``.  A short string per route comes to the driver.
    """
    terms = leaves.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    max_routes = spread = max(least_routes, -(-terms // per_route))
    heavy = leaves.where("prefix <> ''").groupBy("prefix").agg(F.sum(F.size("suffixes")).alias("n")).orderBy(F.desc("n"), "prefix").limit(max_routes).collect()
    routes = frozenset(r["prefix"] for r in heavy)
    longest = max(map(len, routes), default=0)
    inner = frozenset(r[:n] for r in routes for n in range(len(r)))  # prefixes below which there are routes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, dict] = {}
            whole: list = []
            for prefix, suffixes, uses, records in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix and prefix not in inner:  # no route begins below, so one holds for all its terms
                    route = next((prefix[:n] for n in range(min(longest, len(prefix)), 0, -1) if prefix[:n] in routes), None)
                    if route is not None:
                        whole.append((route, [prefix[len(route) :] + s for s in suffixes], uses, records))
                        continue
                for s, u, r in zip(suffixes, uses, records):
                    route = route_of(prefix + s, routes, longest, spread)
                    held = out.setdefault(route, {})
                    suffix = prefix + s if route[:1] == "\0" else (prefix + s)[len(route) :]
                    if suffix in held:
                        held[suffix][0] += u
                        held[suffix][1] += r
                    else:
                        held[suffix] = [u, r]
            if whole:
                kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*whole), kinds)], names=_NAMES)
            yield from _rows(iter(out.items()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, BurstTrie(burst)

        def result() -> Iterator[pa.RecordBatch]:
            start = "" if now is None or now[:1] == "\0" else now
            for prefix, node in trie.leaves():
                cols = [pa.array([start + prefix + s for s in node], pa.string()), pa.array([c[0] for c in node.values()], pa.int64()), pa.array([c[1] for c in node.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "uses", "records"])

        for batch in batches:
            for route, suffixes, uses, records in zip(*(c.to_pylist() for c in batch.columns)):
                if route != now:
                    yield from result()
                    now, trie = route, BurstTrie(burst)
                trie.add_leaf("", suffixes, uses, records)
        yield from result()

    return leaves.mapInArrow(send, _LEAF).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(merge, "term string, uses bigint, records bigint")


def term_frequencies(records: DataFrame, terms: str, **sizes: int) -> DataFrame:
    """(term, uses, records) of every distinct non-empty string in the array column ``terms``.

    ``uses`` counts every occurrence, ``records`` the rows with at least one.
    Null arrays, null and empty strings count nowhere; no records give no rows.
    """
    leaves = materialize(partial_tries(records, terms, **{k: v for k, v in sizes.items() if k in ("burst", "max_terms")}), "leaves")
    return merge_tries(leaves, **{k: v for k, v in sizes.items() if k in ("burst", "per_route", "least_routes")})


def marks(records: Column, total: Column, *, rare_below: int = 3, common_above: float = 0.1) -> Column:
    """The marks of a term: 'rare' below ``rare_below`` records, 'common' in more than ``common_above`` of all; both or none in an array."""
    none = F.lit(None).cast("string")
    each = F.array(F.when(records < rare_below, F.lit("rare")).otherwise(none), F.when(records > F.lit(common_above) * total, F.lit("common")).otherwise(none))
    return F.array_except(each, F.array(none))
