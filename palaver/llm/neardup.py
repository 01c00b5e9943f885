"""Near-duplicate texts by SetSketch registers, banding, joint likelihood and an exact check.

A text's set of word shingles is sketched by registers K = floor(1 - log_b h),
where h is the smallest of exponentially distributed hashes of the members:
exponentially spaced, truncated minima.  Registers of a union are the maxima of
registers, and two sets agree in a register with a probability close to their
Jaccard similarity, so equal bands of registers make candidates.

Candidates are found among *classes* of equal sets, so a group of copies of any
size is one candidate.  A bucket of a band with many classes is not expanded: it
is dealt over all tasks as pairs of blocks, whose sketches are compared there, and
only the likely pairs leave.  For each other candidate the similarity is
estimated by maximum likelihood from the registers and the exact set sizes; those
far below the threshold are dropped and the rest is checked on the sets
themselves.  Classes are named by 64 bits of a hash and confirmed by 64 more; sets
that share a name by chance are told apart again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.components import connected_components
from palaver.operators.skew import split_join
from palaver.sources.materialize import materialize

_WORD = re.compile("[a-z0-9]+")
_U64 = np.uint64


@dataclass(frozen=True)
class Sketch:
    """Parameters of shingles, sketch and bands.

    With 5 rows and 200 bands a pair of similarity 0.5 is found with probability
    0.998, of 0.55 with 0.99997; one of 0.1 becomes a candidate with
    probability 0.002.  ``compared`` registers are kept for the estimate, ``entries``
    band keys are matched at a time, buckets of more than ``block`` classes are
    compared as blocks, and members of a class are paired in parts of ``part``.
    """

    shingle: int = 3
    threshold: float = 0.5
    rows: int = 5
    bands: int = 200
    base: float = 1.001
    rate: float = 20.0
    compared: int = 96
    entries: int = 2_000_000
    block: int = 256
    part: int = 1000
    tasks: int = 20_000

    @property
    def registers(self) -> int:
        return self.rows * self.bands

    def multipliers(self, n: int) -> np.ndarray:
        """Fixed odd multipliers, one per register hash."""
        drawn = np.random.default_rng(20240601).integers(0, 2**32, self.registers, dtype=np.uint64)[:n]
        return (drawn | _U64(1)).astype(np.uint32)[None, :]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingle_sets(texts: list[str | None], size: int, memo: _Words | None = None) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of all ``size`` consecutive words of each text; texts are in lower case."""
    memo = _Words() if memo is None else memo
    words = [_WORD.findall(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    n = max(0, len(flat) - size + 1)
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for i in range(size):
            gram = _mix(gram * _U64(0x9E3779B97F4A7C15) + flat[i : i + n])
    ends = np.cumsum(counts)
    empty = np.empty(0, np.uint64)
    return [np.unique(gram[e - c : e - size + 1]) if c >= size else empty for e, c in zip(ends, counts)]


def class_of(members: np.ndarray) -> tuple[int, int]:
    """(name, check): two 64-bit halves of one hash of a set of shingles."""
    got = xxhash.xxh3_128_intdigest(members.tobytes())
    return (got >> 64) - 2**63, (got & (2**64 - 1)) - 2**63


def registers(sets: list[np.ndarray], how: Sketch, n: int) -> np.ndarray:
    """The first ``n`` registers of each non-empty set."""
    mult = how.multipliers(n)
    low = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    grid = np.empty((64, n), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> _U64(32)).astype(np.uint32)[:, None]
        for a in range(0, len(x), 64):
            part = grid[: min(64, len(x) - a)]
            np.multiply(x[a : a + 64], mult, out=part)
            np.minimum(low[i], np.minimum.reduce(part, axis=0), out=low[i])
    h = -np.log1p(-(low + 0.5) / 2**32) / how.rate
    return np.clip(np.floor(1 - np.log(h) / np.log(how.base)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray, how: Sketch) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bands = regs.reshape(len(regs), how.bands, how.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(how.bands, dtype=np.uint64) * _U64(0xD6E8FEB86659FD93), bands.shape[:2])
        for r in range(how.rows):
            key = _mix(key + bands[:, :, r] + _U64(1))
    return key


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of greater, smaller and equal registers and the set sizes."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)
    log_b = np.log(base)
    best = np.full(len(u), -np.inf)
    out = np.zeros(len(u))
    for step in np.linspace(0, 1, 65):
        j = step * top
        p = lambda x: -np.log1p(-x * (base - 1) / base) / log_b
        more, less = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        like = above * np.log(more + tiny) + below * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, 0) + tiny)
        out = np.where(like > best, j, out)
        best = np.maximum(best, like)
    return out


def _bucket_rows(texts: DataFrame, how: Sketch, parts: int) -> DataFrame:
    """(part, keys, times, classes): 32 further bits of each band key and how often each class occurs, one row per task batch and part.

    Bits that two bands share by chance cost a candidate that the estimate drops.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                sets = [s for s in shingle_sets(whole.column(0).slice(at, 4096).to_pylist(), how.shingle, memo) if len(s)]
                if not sets:
                    continue
                names, first = np.unique(np.array([class_of(s) for s in sets], np.int64), axis=0, return_index=True)
                kinds = names[:, 0]
                keys = band_keys(registers([sets[i] for i in first], how, how.registers), how).ravel()
                part = (keys % _U64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")  # so the classes of a part stay in order
                rest = (keys[order] // _U64(parts)).astype(np.uint32)
                who, part = order // how.bands, part[order]
                cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    used, times = np.unique(who[a:b], return_counts=True)
                    rows.append((int(part[a]), rest[a:b].tobytes(), times.astype(np.uint16).tobytes(), kinds[used].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "times", "classes"])

    return texts.select("text").mapInArrow(run, "part int, keys binary, times binary, classes binary")


def _pairs_in(key: np.ndarray, who: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Lists of classes that share a key: pair by pair, or two blocks of which all pairs are meant."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.empty(0, bool)
    key, who = key[keep], who[keep]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= block, sizes)
    for d in range(1, min(block, int(sizes[sizes <= block].max(initial=1)))):
        at = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        for i in range(0, len(at), 4096):
            yield who[at[i : i + 4096]], who[at[i : i + 4096] + d], False
    for s, n in zip(starts[sizes > block], sizes[sizes > block]):
        parts = [who[a : min(a + block, s + n)] for a in range(s, s + n, block)]
        for i, x in enumerate(parts):
            for y in parts[i:]:
                yield x, y, True


def _match(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in held])
            who = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(t, np.uint16)) for _, t, c in held])
            for a, b, cross in _pairs_in(key, who, block):
                yield pa.RecordBatch.from_arrays([pa.array([a.tolist()], pa.list_(pa.int64())), pa.array([b.tolist()], pa.list_(pa.int64())), pa.array([cross])], names=["a", "b", "cross"])

        for batch in batches:
            for part, k, t, c in zip(*(x.to_pylist() for x in batch.columns)):
                if part != now:
                    yield from found()
                    now, held = part, []
                held.append((k, t, c))
        yield from found()

    return run


def buckets(texts: DataFrame, how: Sketch, n_texts: int) -> DataFrame:
    """(a, b, cross): arrays of classes that share a band, pair by pair, or two blocks of which all pairs are meant; ``n_texts`` sizes the parts."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_texts * how.bands // how.entries))
    tasks = min(parts, how.tasks)  # a task takes its parts one after the other
    packed = _bucket_rows(texts, how, parts).repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")
    return packed.mapInArrow(_match(how.block), "a array<bigint>, b array<bigint>, cross boolean")


def candidates(lists: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the classes listed pair by pair."""
    both = lists.where("not cross").select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    return both.where("a < b").distinct()


def sketches(texts: DataFrame, how: Sketch) -> DataFrame:
    """(id, class, check, n, regs) of each text with at least one shingle; regs are the registers to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), how.shingle, memo)
            use = [i for i, s in enumerate(sets) if len(s)]
            if not use:
                continue
            regs = registers([sets[i] for i in use], how, how.compared)
            names = np.array([class_of(sets[i]) for i in use], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(use)),
                    pa.array(names[:, 0]),
                    pa.array(names[:, 1]),
                    pa.array([len(sets[i]) for i in use], pa.int64()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["id", "class", "check", "n", "regs"],
            )

    return texts.select("id", "text").mapInArrow(run, "id bigint, class bigint, check bigint, n bigint, regs binary")


def least_estimate(how: Sketch) -> float:
    """Five standard errors of the estimate below the threshold."""
    t, m = how.threshold, how.compared
    return t - 5 * (t * (1 - t) / m) ** 0.5


_LIKELY = "a bigint, b bigint, id_a bigint, id_b bigint"


def _likely(pairs: DataFrame, classes: DataFrame, how: Sketch) -> DataFrame:
    """Candidates whose estimate is not five standard errors below the threshold, with a member of each class; ``pairs`` is a written table."""
    m, least = how.compared, least_estimate(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("regs_a", "regs_b"))
            above, below = (x > y).sum(1), (x < y).sum(1)
            got = estimate(above, below, m - above - below, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), how.base)
            ok = pa.array(np.flatnonzero(got >= least))
            if len(ok):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(ok) for c in ("a", "b", "id_a", "id_b")], names=["a", "b", "id_a", "id_b"])

    side = lambda s: classes.select(F.col("class").alias(s), F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    return split_join(pairs, side("a"), "a").join(side("b"), "b").mapInArrow(run, _LIKELY)


def _likely_in_blocks(lists: DataFrame, classes: DataFrame, how: Sketch) -> DataFrame:
    """The same of all pairs of the two blocks of each row: the sketches of at most two blocks meet in one row, and only likely pairs leave it."""
    m, least = how.compared, least_estimate(how)
    few = int(0.6 * least * m)  # so few equal registers that no estimate passes: they count about m times the similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                out = [[], [], [], []]
                sides = [[c for c in cells if c["side"] == k] for k in (0, 1)]
                if not sides[1]:  # a block with itself
                    sides[1] = sides[0]
                left, right = sides
                x, y = (np.frombuffer(b"".join(c["regs"] for c in s), np.uint16).reshape(-1, m) for s in sides)
                cx, cy = (np.array([c["class"] for c in s], np.int64) for s in sides)
                nx, ny = (np.array([c["n"] for c in s], np.int64) for s in sides)
                for i in range(len(left)):
                    equal = (y == x[i]).sum(1)
                    at = np.flatnonzero((equal > few) & (cx[i] != cy))
                    if not len(at):
                        continue
                    above = (x[i] > y[at]).sum(1)
                    got = estimate(above, m - equal[at] - above, equal[at], np.full(len(at), nx[i]), ny[at], how.base)
                    for j in at[got >= least]:
                        p, q = (left[i], right[j]) if cx[i] < cy[j] else (right[j], left[i])
                        for to, v in zip(out, (p["class"], q["class"], p["id"], q["id"])):
                            to.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "id_a", "id_b"])

    # two blocks that several bands pair are compared once
    wide = lists.where("cross").select("a", F.when(F.col("a") != F.col("b"), F.col("b")).otherwise(F.array().cast("array<bigint>")).alias("b")).withColumn("pair", F.xxhash64("a", "b")).dropDuplicates(["pair"])
    member = lambda name, k: F.transform(name, lambda c: F.struct(F.lit(k).alias("side"), c.alias("class")))
    each = materialize(wide.select("pair", F.explode(F.concat(member("a", 0), member("b", 1))).alias("c")).select("pair", "c.*"), "blocks")
    held = split_join(each, classes, "class").groupBy("pair").agg(F.collect_list(F.struct("side", "class", "id", "n", "regs")).alias("cells"))  # two blocks at most
    return held.select("cells").mapInArrow(run, _LIKELY).distinct()


def _verified(likely: DataFrame, texts: DataFrame, how: Sketch) -> DataFrame:
    """(a, b, jaccard) of the candidates that reach the threshold by their sets; ``likely`` is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            xs, ys = (shingle_sets(batch.column(c).to_pylist(), how.shingle, memo) for c in ("text_a", "text_b"))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(xs, ys)], np.int64) - common
            ok = np.flatnonzero((union > 0) & (common >= how.threshold * union))
            if len(ok):
                take = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(common[ok] / union[ok])], names=["a", "b", "jaccard"])

    side = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}"))
    return split_join(likely, side("a"), "id_a", most=20_000).join(side("b"), "id_b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, jaccard double")


@dataclass(frozen=True)
class NearDuplicates:
    """``members(id, class)`` of every text with a shingle and ``links(a, b, jaccard)``, a < b, between classes of different sets."""

    members: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, key: str, text: Column, how: Sketch = Sketch()) -> NearDuplicates:
    """Near-duplicate classes of ``docs``, which holds each key once.

    ``text`` is compared in lower case; words are maximal runs of a-z and 0-9.
    Texts with fewer words than a shingle, null ones included, have no class.
    """
    texts = materialize(docs.select(F.col(key).alias("id"), F.lower(text).alias("text")).where(F.col("id").isNotNull()), "texts")
    drawn = materialize(sketches(texts, how), "sketches")
    lists = materialize(buckets(texts, how, texts.count()), "buckets")
    pairs, renamed = materialize(candidates(lists), "pairs"), None
    twice = drawn.groupBy("class").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most").select("class", "least")
    if twice.take(1):
        drawn, renamed = _told_apart(drawn, twice)
        pairs = materialize(_with_renamed(pairs, renamed), "pairs")
    classes = drawn.groupBy("class").agg(F.min(F.struct("id", "n", "regs")).alias("r")).select("class", "r.*")
    likely = _likely(pairs, classes, how)
    if lists.where("cross").take(1):
        wide = lists.where("cross") if renamed is None else _blocks_with_renamed(lists.where("cross"), renamed)
        likely = likely.unionByName(_likely_in_blocks(wide, classes, how)).distinct()
    links = materialize(_verified(materialize(likely, "likely"), texts, how), "links")
    return NearDuplicates(drawn.select("id", "class"), links)


def _told_apart(drawn: DataFrame, twice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches with a new name for the further sets of a name, (class, new) of those)."""
    held = drawn.join(F.broadcast(twice), "class", "left")  # names met twice: next to none of all, by the size of the hash
    further = F.col("least").isNotNull() & (F.col("check") != F.col("least"))
    new = F.when(further, F.xxhash64("class", "check")).otherwise(F.col("class"))
    told = materialize(held.withColumn("new", new), "told")
    renamed = told.where("new <> class").select("class", "new").distinct()
    return told.withColumn("class", F.col("new")).drop("new", "least"), renamed


def _with_renamed(pairs: DataFrame, renamed: DataFrame) -> DataFrame:
    """``pairs`` with each name also standing for the further sets that had it, and those sets among themselves."""
    every = lambda c: renamed.groupBy(F.col("class").alias(c)).agg(F.collect_set("new").alias(f"more_{c}"))
    more = lambda c: F.explode(F.concat(F.array(F.col(c)), F.coalesce(f"more_{c}", F.array().cast("array<bigint>")))).alias(c)
    wide = pairs.join(F.broadcast(every("a")), "a", "left").join(F.broadcast(every("b")), "b", "left")
    wide = wide.select(more("a"), "b", "more_b").select("a", more("b"))
    same = renamed.select(F.col("class").alias("a"), F.col("new").alias("b"))
    among = renamed.alias("x").join(renamed.alias("y"), "class").select(F.col("x.new").alias("a"), F.col("y.new").alias("b"))
    both = wide.unionByName(same).unionByName(among)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _blocks_with_renamed(lists: DataFrame, renamed: DataFrame) -> DataFrame:
    """Blocks in which a name also stands for the further sets that had it."""
    names = renamed.agg(F.map_from_entries(F.collect_list(F.struct("new", "class"))).alias("m")).scalar()
    more = lambda c: F.concat(c, F.map_keys(F.map_filter("names", lambda _, old: F.array_contains(c, old))))
    return lists.withColumn("names", names).select(more(F.col("a")).alias("a"), more(F.col("b")).alias("b"), "cross")


def duplicate_pairs(found: NearDuplicates, part: int = Sketch.part) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all near-duplicate texts, copies expanded: as many rows as there are such pairs.

    The members of a class are dealt over parts of about ``part``, and parts are
    paired with parts, so no task gathers a class.
    """
    m = found.members
    sizes = m.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts"))
    dealt = materialize(m.join(sizes, "class").select("class", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id"), "dealt")
    left = dealt.select(F.col("class").alias("a"), F.col("part").alias("pa"), F.col("id").alias("x"))
    right = dealt.select(F.col("class").alias("b"), F.col("part").alias("pb"), F.col("id").alias("y"))
    count = lambda c: sizes.select(F.col("class").alias(c), F.col("parts").alias(f"n{c}"))
    all_ = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)).alias(name)
    links = found.links.select("a", "b").join(count("a"), "a").join(count("b"), "b")
    paired = links.select("a", "b", "nb", all_("a", "pa")).select("a", "b", "pa", all_("b", "pb"))
    linked = paired.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("x", "y")
    own = sizes.select(F.col("class").alias("a"), "parts").join(m.groupBy(F.col("class").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a")
    own = own.select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pa")).select("a", F.col("a").alias("b"), "pa", F.explode(F.sequence("pa", F.col("parts") - 1)).alias("pb"))
    copies = own.join(left, ["a", "pa"]).join(right, ["b", "pb"]).where("pa < pb or x < y").select("x", "y")
    both = linked.unionByName(copies)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_groups(found: NearDuplicates) -> DataFrame:
    """(id, class_id, group_id, n_links) per text: smallest id of its equal texts and of its group, links to other classes."""
    m = found.members
    named = m.join(m.groupBy("class").agg(F.min("id").alias("class_id")), "class")
    reps = named.select("class", "class_id").distinct()
    a, b = reps.select(F.col("class").alias("a"), F.col("class_id").alias("src")), reps.select(F.col("class").alias("b"), F.col("class_id").alias("dst"))
    edges = materialize(found.links.join(a, "a").join(b, "b").select("src", "dst"), "edges")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    return named.drop("class").join(groups, "class_id", "left").join(degree, "class_id", "left").select(
        "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
