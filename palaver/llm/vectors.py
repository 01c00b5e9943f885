"""The k most similar vectors of every vector, by an adaptive dimension scan over inverted lists.

Centres fitted on a bounded sample give the lists.  Beyond ``flat`` lists a first
level of centres is divided further: each of its cells has centres of its own,
fitted in a task of its own on a sample of the cell, in the leading dimensions
only.  Every vector is stored in its nearest list and visits every other list
whose centre is almost as near, however many they are, and further ones until k
other ids are in reach.  A list that holds more than ``block`` vectors is dealt
over several blocks, each a unit of work of its own, and whoever visits it visits
them all.

Vectors are turned by one random rotation, after which any block of leading
dimensions estimates a distance without bias.  Within a block of stored vectors
the distances of all candidates are taken over the first dimensions; a
hypothesis test drops those whose partial distance is too large to still belong
to the k nearest, and only the rest go on to the next dimensions.

Codes cross the shuffle in half precision, once for the list a vector lives in
and once for each further block it visits.  Equal vectors are one candidate and
one query, whatever their number: a map task sends them once with their smallest
ids, and the answer is joined to all of them at the end.  Where half precision
leaves open whether a candidate is among the k or reaches the floor, the cosine
is taken again from the vectors themselves in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.sources.materialize import materialize

DENSE = 40  # a gathered product costs about this many times one within a matrix product; above that the whole block is multiplied
FEW = 200_000  # vectors to look up whose ids are broadcast; more are joined


@dataclass(frozen=True)
class Scan:
    """Parameters of lists and scan.

    ``list_size`` vectors a list on average.  At most ``max_sample`` vectors are
    drawn to fit the first level and ``per_centre`` for each list of the second,
    at most ``cell`` lists a cell and ``max_lists`` in all, whose centres in
    ``leading`` dimensions are broadcast (130 MB at most); beyond that lists grow
    and are split into blocks.  A vector visits all further lists whose centre's
    cosine is within ``margin`` (second level: ``inner``) of the nearest, so a
    dense group that was cut into many lists is searched as a whole.  ``columns``
    ends the column blocks, as shares of the dimensions; ``epsilon`` widens the
    test: a true neighbour is lost with a probability that falls as exp(-c eps^2).
    ``tolerance`` is five standard errors of a cosine of half-precision codes.
    """

    dim: int = 1536
    list_size: int = 1000
    flat: int = 1024
    block: int = 4000
    max_sample: int = 20_000
    per_centre: int = 20
    cell: int = 4096
    max_lists: int = 1_000_000
    leading: int = 64
    margin: float = 0.06
    inner: float = 0.12
    columns: tuple[float, ...] = (1 / 16, 3 / 16, 7 / 16, 1.0)
    epsilon: float = 2.1
    tolerance: float = 1e-4
    tasks: int = 20_000
    seed: int = 7

    def exact(self) -> Scan:
        """Parameters by which every vector meets every other and none is abandoned: the whole set against itself, block by block."""
        return replace(self, margin=4.0, inner=4.0, epsilon=float("inf"))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix that ``seed`` fixes."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable lists: ``dim`` finite numbers, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero((sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ok), dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return ok[good], (x[good] / norm[good, None]).astype(np.float32)


def fit_centres(x: np.ndarray, k: int, seed: int, rounds: int = 12, settle: int = 3, *, spherical: bool = True) -> np.ndarray:
    """At most ``k`` centres by k-means, of unit length if ``spherical``; a vector of the largest list replaces the centre of a nearly empty one.

    None is replaced in the last ``settle`` rounds, which refine the new centres;
    lists that are nearly empty even then are given up, so their vectors fall to
    the neighbouring lists.
    """
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    few = lambda sizes: sizes * 8 * k < len(x)
    homes = lambda: (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
    for left in reversed(range(rounds)):
        home = homes()
        sizes = np.bincount(home, minlength=k)
        order = np.argsort(home, kind="stable")
        filled = np.flatnonzero(sizes)
        sums = np.zeros_like(centres)
        sums[filled] = np.add.reduceat(x[order], np.r_[0, np.cumsum(sizes[filled])[:-1]])
        for c in np.flatnonzero(few(sizes)) if left >= settle else ():  # nearly empty: take half of a large list
            big = int(sizes.argmax())
            sums[c] = x[rng.choice(np.flatnonzero(home == big))] if (home == big).any() else x[rng.integers(len(x))]
            sizes[big] //= 2
            sizes[c] = 1
        size = np.linalg.norm(sums, axis=1) if spherical else sizes.astype(np.float32)
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres).astype(np.float32)
    return centres[~few(np.bincount(homes(), minlength=k))]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class Lists:
    """The lists by their centres: ``first`` alone, or cells of ``first`` with the ``inner`` centres offset[cell] .. offset[cell + 1] each."""

    def __init__(self, first: np.ndarray, inner: np.ndarray | None = None, offset: np.ndarray | None = None) -> None:
        self.first, self.inner, self.offset = first, inner, offset
        self.count = len(first) if inner is None else len(inner)
        self.rows = 1024 if inner is None else 256  # vectors to take at a time

    def _inside(self, lead: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, cosine in the leading dimensions) of all lists in the cells of each row."""
        out = []
        for c in np.unique(cells):
            r = rows[cells == c]
            a, b = self.offset[c], self.offset[c + 1]
            out.append((np.repeat(r, b - a), np.tile(np.arange(a, b), len(r)), (lead[r] @ unit(self.inner[a:b].astype(np.float32)).T).ravel()))
        return tuple(np.concatenate(x) for x in zip(*out))

    def home(self, x: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The list of each unit vector; ``lead`` its leading dimensions, turned."""
        cell = (x @ self.first.T).argmax(1)
        if self.inner is None:
            return cell
        row, at, near = self._inside(unit(lead), np.arange(len(x)), cell)
        order = np.lexsort((at, -near, row))
        return at[order][np.r_[True, np.diff(row[order]) > 0]]

    def visits(self, x: np.ndarray, lead: np.ndarray, held: np.ndarray, how: Scan, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists to search for each vector: those within the margin, further ones until ``least`` ids are held, and its home."""
        near = x @ self.first.T
        if self.inner is None:
            return np.nonzero(visited(near, held, how.margin, least))
        cells = np.nonzero(visited(near, np.add.reduceat(held, self.offset[:-1]), how.margin, least))
        row, at, near = self._inside(unit(lead), *cells)
        order = np.lexsort((at, -near, row))
        row, at, near = row[order], at[order], near[order]
        starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
        sizes = np.diff(np.r_[starts, len(row)])
        before = np.cumsum(held[at]) - held[at]
        before -= np.repeat(before[starts], sizes)  # ids in the nearer lists
        go = (near >= np.repeat(near[starts], sizes) - how.inner) | (before < least)
        home = self.home(x, lead)
        go |= at == home[row]
        return row[go], at[go]


class ListScan:
    """Top ``k`` of queries among the vectors of one list."""

    def __init__(self, stored: np.ndarray, how: Scan, k: int, floor: float | None) -> None:
        dim = stored.shape[1]
        self.how, self.k, self.dim = how, min(k, len(stored)), dim
        self.all = floor is None  # k are wanted, however far
        self.ends = sorted({max(1, round(s * dim)) for s in how.columns} | {dim})
        self.x = stored
        self.squares = np.cumsum(np.stack([(stored[:, a:b] ** 2).sum(1) for a, b in zip([0, *self.ends], self.ends)]), axis=0)
        self.start = np.float32(np.inf) if floor is None else np.float32(2 - 2 * floor + 1e-4)

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, stored, cosine) of at most k stored vectors per query, unordered."""
        d0 = self.ends[0]
        squares = np.cumsum(np.stack([(q[:, a:b] ** 2).sum(1) for a, b in zip([0, *self.ends], self.ends)]), axis=0)
        dots = q[:, :d0] @ self.x[:, :d0].T
        partial = squares[0][:, None] + self.squares[0][None, :] - 2 * dots
        # the nearest by the first block, taken exactly, bound the k-th distance
        near = np.argpartition(partial, self.k - 1, axis=1)[:, : self.k]
        exact = 2 - 2 * np.einsum("qd,qkd->qk", q, self.x[near])
        radius = np.minimum(exact.max(1), self.start) + 1e-5
        sure = np.zeros(partial.shape, bool)
        if self.all:
            np.put_along_axis(sure, near, True, axis=1)  # so that no test leaves fewer than k
        at_q, at_x = np.nonzero((partial * (self.dim / d0) <= (radius * (1 + self.how.epsilon / d0**0.5) ** 2)[:, None]) | sure)
        dot = dots[at_q, at_x]
        for i in range(1, len(self.ends)):
            a, b = self.ends[i - 1], self.ends[i]
            if len(at_q) * DENSE > partial.size:  # so many are left that a matrix product is cheaper than gathering them
                dot += (q[:, a:b] @ self.x[:, a:b].T)[at_q, at_x]
            else:
                step = max(1, 1_000_000 // (b - a))
                for s in range(0, len(at_q), step):
                    e = s + step
                    dot[s:e] += np.einsum("nd,nd->n", q[at_q[s:e], a:b], self.x[at_x[s:e], a:b])
            if b < self.dim:
                far = squares[i][at_q] + self.squares[i][at_x] - 2 * dot
                keep = (far * (self.dim / b) <= radius[at_q] * (1 + self.how.epsilon / b**0.5) ** 2) | sure[at_q, at_x]
                at_q, at_x, dot = at_q[keep], at_x[keep], dot[keep]
        cosine = dot / np.sqrt(squares[-1][at_q] * self.squares[-1][at_x])
        order = np.lexsort((at_x, -cosine, at_q))
        at_q, at_x, cosine = at_q[order], at_x[order], cosine[order]
        rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        return at_q[rank < self.k], at_x[rank < self.k], cosine[rank < self.k]


def _usable(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the rows that count, in slices."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            used, x = matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(used))
            known = np.flatnonzero(~ids.is_null().to_numpy(zero_copy_only=False))
            if len(known):
                yield ids.to_numpy(zero_copy_only=False)[known].astype(np.int64), x[known]


def kinds_of(x: np.ndarray) -> np.ndarray:
    """One 64-bit number per vector; equal vectors share it."""
    return np.array([xxhash.xxh64_intdigest(v.tobytes()) - 2**63 for v in x], np.int64)


def _homes(how: Scan, lists, turn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, lead = lists.value, turn.value[:, : how.leading]
        for ids, x in _usable(batches, how.dim, here.rows):
            home = here.home(x, x @ lead).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kinds_of(x)), pa.array(home)], names=["id", "kind", "list"])

    return run


def visited(near: np.ndarray, held: np.ndarray, margin: float, least: int) -> np.ndarray:
    """Which lists each vector goes to: all within the margin, and the next nearest until they hold ``least`` ids."""
    go = near >= near.max(1)[:, None] - margin
    for r in np.flatnonzero(go @ held < least):
        order = np.argsort(-near[r], kind="stable")
        go[r, order[: np.searchsorted(np.cumsum(held[order]), least) + 1]] = True
    return go


def blocks_of(held: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of blocks, number of the first) of each list; none where nothing is held."""
    n = -(-held // block)
    return n, np.r_[0, np.cumsum(n)[:-1]]


def _codes(how: Scan, lists, turn, held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rot, sizes = lists.value, turn.value, held.value
        n_blocks, start = blocks_of(sizes, how.block)
        for ids, x in _usable(batches, how.dim, here.rows):
            kind = kinds_of(x)
            order = np.lexsort((ids, kind))
            at = order[np.r_[True, np.diff(kind[order]) != 0]]  # one row of each kind, the smallest id
            ends = np.r_[np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0]), len(order)]
            few = [np.unique(ids[order[a:b]])[: k + 1] for a, b in zip(ends[:-1], ends[1:])]
            kind, x = kind[at], x[at]
            turned = x @ rot
            home = here.home(x, turned[:, : how.leading])
            rows, to = here.visits(x, turned[:, : how.leading], sizes, how, k + 1)
            code = [c.tobytes() for c in turned.astype(np.float16)]
            times = n_blocks[to]
            nth = np.arange(times.sum()) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times) if len(times) else np.empty(0, np.int64)
            rows, to = np.repeat(rows, times), np.repeat(to, times)
            stored = (to == home[rows]) & (nth == kind[rows] % np.maximum(n_blocks[to], 1))
            for s in range(0, len(rows), 4096):  # a vector of a dense group visits many lists
                row = rows[s : s + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((start[to] + nth)[s : s + 4096], pa.int64()),
                        pa.array((~stored[s : s + 4096]).astype(np.int8)),
                        pa.array(kind[row]),
                        pa.array([few[r] for r in row], pa.list_(pa.int64())),
                        pa.array([code[r] for r in row], pa.binary()),
                    ],
                    names=["block", "visiting", "kind", "ids", "code"],
                )

    return run


_FOUND = "kind bigint, other bigint, neighbour bigint, cosine double"


def _scan(how: Scan, k: int, floor: float | None):
    want = 2 * k + 1  # itself, the k, and as many again for the check in double precision

    def unpack(codes: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(codes), np.float16).reshape(len(codes), how.dim).astype(np.float32)

    def answer(block: dict, kinds: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(q), 256):
            at_q, at_x, cosine = block["scan"].search(q[s : s + 256])
            n = block["sizes"][at_x]
            ids = block["flat"][np.arange(n.sum()) + np.repeat(block["starts"][at_x] - np.r_[0, np.cumsum(n)[:-1]], n)] if len(n) else np.empty(0, np.int64)
            at_q, other, cosine = np.repeat(at_q, n), np.repeat(block["kinds"][at_x], n), np.repeat(cosine, n)
            order = np.lexsort((ids, -cosine, at_q))
            at_q, other, ids, cosine = at_q[order], other[order], ids[order], cosine[order]
            keep = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < want
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds[s + at_q[keep]]), pa.array(other[keep]), pa.array(ids[keep]), pa.array(cosine[keep].astype(np.float64))],
                names=["kind", "other", "neighbour", "cosine"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, rows, guests = None, None, {}, {}

        def close() -> None:
            """The stored vectors of the block are complete."""
            nonlocal block, rows
            if rows:
                members = [sorted({*ids})[: k + 1] for ids, _ in rows.values()]
                sizes = np.fromiter(map(len, members), np.int64, len(members))
                block = {"kinds": np.fromiter(rows, np.int64, len(rows)), "sizes": sizes, "starts": np.r_[0, np.cumsum(sizes)[:-1]], "flat": np.concatenate(members).astype(np.int64)}
                x = unpack([c for _, c in rows.values()])
                block["scan"] = ListScan(x, how, want, floor)
                block["own"] = x
                rows = {}

        def ask() -> Iterator[pa.RecordBatch]:
            """The guests so far, and the stored vectors once, are searched for in the block."""
            nonlocal guests
            close()
            if block is not None:
                if "own" in block:
                    yield from answer(block, block["kinds"], block.pop("own"))
                if guests:
                    yield from answer(block, np.fromiter(guests, np.int64, len(guests)), unpack(list(guests.values())))
            guests = {}

        for batch in batches:
            for at, visiting, kind, ids, code in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    yield from ask()
                    now, block = at, None
                if not visiting:
                    if kind in rows:
                        rows[kind][0].extend(ids)
                    else:
                        rows[kind] = (ids, code)
                elif kind not in guests:
                    if len(guests) >= 1024:
                        yield from ask()
                    guests[kind] = code
        yield from ask()

    return run


def fit(vectors: DataFrame, how: Scan, turn=None) -> Lists:
    """The lists for ``vectors(id, embedding)``: a hash sample of at most ``max_sample`` rows comes to the driver; cells are divided in tasks."""
    n = vectors.count()
    k = max(1, -(-n // how.list_size))
    side = k if k <= how.flat else min(int(np.ceil(k**0.5)), how.max_sample // how.per_centre)
    want = int(min(n, how.max_sample, max(4096, 32 * side)))
    share = min(1.0, 1.2 * want / max(1, n))
    draw = F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(1 << 30))
    drawn = vectors.where(draw < int(share * (1 << 30))).select("embedding").limit(want).toArrow()
    x = matrix(drawn.column(0), how.dim)[1] if drawn.num_rows else np.empty((0, how.dim), np.float32)
    if not len(x):
        return Lists(np.zeros((1, how.dim), np.float32))
    first = fit_centres(x, side, how.seed)
    if k <= how.flat:
        return Lists(first)
    # lists of each cell by what the sample says it holds, and the share of its vectors to fit them on
    holds = np.bincount((x @ first.T).argmax(1), minlength=len(first)) * (n / len(x))
    parts = np.clip(np.ceil(holds / how.list_size * min(1.0, how.max_lists / k)), 1, how.cell).astype(np.int64)
    shares = np.minimum(1.0, how.per_centre * parts / np.maximum(holds, 1))
    spark = vectors.sparkSession
    cells = spark.sparkContext.broadcast((first, parts, shares))
    turn = spark.sparkContext.broadcast(rotation(how.dim, how.seed)) if turn is None else turn

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, _, shares = cells.value
        for ids, x in _usable(batches, how.dim):
            cell = (x @ first.T).argmax(1)
            u = np.array([xxhash.xxh32_intdigest(i.tobytes()) for i in ids]) / 2**32
            ok = u < shares[cell]
            lead = (x[ok] @ turn.value[:, : how.leading]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(cell[ok].astype(np.int32)), pa.array([v.tobytes() for v in lead], pa.binary())], names=["cell", "lead"])

    def divide(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        x = np.frombuffer(b"".join(table.column("lead").to_pylist()), np.float16).reshape(-1, how.leading).astype(np.float32)
        inner = fit_centres(unit(x), int(cells.value[1][cell]), how.seed)
        return pa.table({"cell": pa.array([cell] * len(inner), pa.int32()), "centre": pa.array([c.tobytes() for c in inner.astype(np.float16)], pa.binary())})

    # a cell's sample is at most per_centre * cell short codes
    fitted = vectors.mapInArrow(sample, "cell int, lead binary").groupBy("cell").applyInArrow(divide, "cell int, centre binary").toArrow()
    at = fitted.column("cell").to_numpy()
    inner = np.frombuffer(b"".join(fitted.column("centre").to_pylist()), np.float16).reshape(-1, how.leading)
    missing = np.setdiff1d(np.arange(len(first)), at)  # cells without a sample have the one list of their centre
    at, inner = np.r_[at, missing], np.r_[inner, (first[missing] @ turn.value[:, : how.leading]).astype(np.float16)]
    order = np.argsort(at, kind="stable")
    return Lists(first, inner[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(first)))])


def _checked(top: DataFrame, rows: DataFrame, members: DataFrame, how: Scan, k: int, floor: float | None) -> DataFrame:
    """``top`` with cosines in double precision where those of the codes leave the choice open.

    Open are candidates within the tolerance of the floor or of the last place,
    unless all of them there are equal.  Vectors are looked up for these alone.
    """
    group = Window.partitionBy("kind")
    last = F.max(F.when(F.col("place") == k + 1, F.col("cosine"))).over(group)
    near = F.abs(F.col("cosine") - F.col("last")) <= how.tolerance
    spread = F.max(F.when(near, F.col("cosine"))).over(group) > F.min(F.when(near, F.col("cosine"))).over(group)
    open_ = near & spread & (F.max("place").over(group) > k + 1)
    if floor is not None:
        open_ |= F.abs(F.col("cosine") - F.lit(floor)) <= how.tolerance
    top = materialize(top.withColumn("last", last).withColumn("open", F.coalesce(open_ & (F.col("kind") != F.col("other")), F.lit(False))).drop("last"), "top")
    pairs = materialize(top.where("open").select("kind", "other").distinct(), "open")
    needed = pairs.select(F.explode(F.array("kind", "other")).alias("kind")).distinct()
    one = members.join(needed, "kind", "left_semi").groupBy("kind").agg(F.min("id").alias("id"))  # a row that holds each vector
    if (n := needed.count()) == 0:
        return top.drop("open", "other", "place")
    held = rows.join(F.broadcast(one) if n <= FEW else one, "id").select("id", "embedding", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, x = matrix(batch.column(1), how.dim)
            kind = batch.column(2).to_numpy()[used]
            ok = kinds_of(x) == kind  # an id may have other vectors too
            yield pa.RecordBatch.from_arrays([pa.array(kind[ok]), pa.array([v.tobytes() for v in x[ok]], pa.binary())], names=["kind", "vector"])

    found = held.mapInArrow(look, "kind bigint, vector binary").groupBy("kind").agg(F.first("vector").alias("vector"))  # equal for one kind

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.float32).reshape(part.num_rows, how.dim).astype(np.float64) for c in ("x", "y"))
                dot = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
                yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("other"), pa.array(dot)], names=["kind", "other", "exact"])

    side = lambda name, to: found.select(F.col("kind").alias(name), F.col("vector").alias(to))
    exact = pairs.join(side("kind", "x"), "kind").join(side("other", "y"), "other").select("kind", "other", "x", "y").mapInArrow(measure, "kind bigint, other bigint, exact double")
    return top.join(exact, ["kind", "other"], "left").select("kind", "neighbour", F.coalesce("exact", "cosine").alias("cosine"))


def nearest(vectors: DataFrame, key: str, embedding: str = "embedding", *, k: int = 5, floor: float | None = None, how: Scan = Scan(), exact: bool = False) -> DataFrame:
    """(id, neighbour, cosine, rank) of the k most similar other ids of every id, the smaller id first on ties.

    With ``floor`` only neighbours of at least that cosine are kept, and the
    scan abandons the others early.  ``exact`` compares everything with
    everything instead, at a cost that is the square of the number of vectors.
    Rows without an id and vectors that are null, of another length, with a null
    or non-finite number, or all zero are left out.  Rows that repeat an id and
    vector count once; an id with several vectors counts by the best of them.
    Every id has k neighbours where there are k others and no floor.
    """
    how = how.exact() if exact else how
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))
    turn = sc.broadcast(rotation(how.dim, how.seed))  # dim x dim, whatever the collection
    lists = fit(rows.where("id IS NOT NULL AND embedding IS NOT NULL"), how, turn)
    here = sc.broadcast(lists)  # at most max_sample / per_centre whole centres and max_lists short ones
    members = materialize(rows.mapInArrow(_homes(how, here, turn), "id bigint, kind bigint, list int").distinct(), "members")
    # an id with several vectors counts in one list, so lists never hold fewer ids than their sum
    own = members.groupBy("id").agg(F.min("list").alias("list"))
    sizes = np.zeros(lists.count, np.int64)
    for r in own.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    held = sc.broadcast(sizes)  # one number per list
    coded = rows.mapInArrow(_codes(how, here, turn, held, k), "block bigint, visiting tinyint, kind bigint, ids array<bigint>, code binary")
    tasks = int(min(how.tasks, max(1, blocks_of(sizes, how.block)[0].sum())))
    listed = coded.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "visiting", "kind")
    found = listed.mapInArrow(_scan(how, k, floor), _FOUND)
    best = found.repartition("kind").groupBy("kind", "neighbour").agg(F.max(F.struct("cosine", "other")).alias("m")).select("kind", "neighbour", "m.*")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cosine"), "neighbour"))
    top = best.withColumn("place", place).where(F.col("place") <= 2 * k + 1)
    top = _checked(top, rows, members, how, k, floor)
    if floor is not None:
        top = top.where(F.col("cosine") >= floor)
    # one row list per kind meets all ids that share it
    each = members.select("id", "kind").join(top.select("kind", "neighbour", "cosine"), "kind").where("id <> neighbour")
    merged = each.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return merged.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
