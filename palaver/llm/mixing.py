"""Mixing sources to target weights, by Poisson replication.

Token totals per source give the repetition rate each source needs to reach its
share of the corpus' size.  Every document is repeated a Poisson number of times
whose truncation at the cap has that rate as its mean; the number is the inverse
of the distribution at a uniform hash of seed and document, so it depends on
nothing else and a lost task repeats it exactly.  Repeated documents are then
ordered by another hash, a global shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SOURCES = 100_000
SALTS = 32
_OWN = ("__mix_base", "__mix_cdf", "__mix_n", "__mix_salt")


def mix_plan(counted: DataFrame, mix: DataFrame) -> DataFrame:
    """One row per source of ``mix``: tokens, total, rate, reachable, short.

    ``counted(source, n_tokens)`` holds all documents; those whose source is
    null or not in ``mix`` take no part.  ``total`` is the tokens of all that
    do, the size to reach; ``rate`` = target_share * total / tokens, at most
    max_repeats; ``short`` marks sources that cannot reach their share.  A
    source without tokens has rate 0; a null share or cap counts as 0 there and
    is never short.  Should a source be listed twice, its largest share and cap
    hold.
    """
    # at most one row per source leaves the aggregation, so the join is small whatever the skew
    tokens = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    wanted = mix.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))
    plan = wanted.join(tokens, "source", "left").na.fill(0, ["tokens", "documents"])
    # one row per source: a single small partition
    plan = plan.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    share, cap = F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))
    need = F.when(F.col("tokens") > 0, share * F.col("total") / F.col("tokens")).otherwise(0.0)
    return plan.withColumns({
        "rate": F.least(need, cap.cast("double")),
        "reachable": F.least(share * F.col("total"), (cap * F.col("tokens")).cast("double")),
        "short": F.coalesce((F.col("max_repeats") * F.col("tokens")).cast("double") < F.col("target_share") * F.col("total"), F.lit(False)),
    })


def truncated_cdf(rate: float, cap: int) -> tuple[int, list[float]]:
    """(base, cdf) of a Poisson number truncated at ``cap`` whose mean is ``rate``: cdf[i] = P(N <= base + i).

    The list starts and ends where the rest is negligible; N at uniform u is
    ``base`` plus the number of entries below u.  A rate of 0 gives no repeats,
    one of the cap or more always the cap.  Probabilities are cumulated from
    logarithms, so no rate is too high.
    """
    if rate <= 0 or cap <= 0:
        return 0, []
    if rate >= cap:
        return cap, []

    def spread(mean: float) -> tuple[int, np.ndarray]:
        reach = 10 * mean**0.5 + 40  # beyond that less than 1e-15 is left
        lo, hi = max(0, int(mean - reach)), min(cap, int(mean + reach) + 1)
        if lo >= hi:
            return cap, np.empty(0)
        k = np.arange(lo, hi)
        start = lo * np.log(mean) - mean - sum_of_logs(lo)
        steps = np.r_[0.0, np.cumsum(np.log(mean) - np.log(k[1:]))]
        return lo, np.minimum(np.cumsum(np.exp(start + steps)), 1.0)

    def got(mean: float) -> float:
        base, cdf = spread(mean)  # E[min(N, cap)] = sum over k < cap of P(N > k), increasing in the Poisson mean
        return base + float((1 - cdf).sum())

    lo, hi = rate, cap + 12 * cap**0.5 + 60.0
    if got(hi) < rate:  # so near the cap that the mean of the cap itself is the rate
        return cap, []
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < rate else (lo, mid)
    base, cdf = spread(hi)
    return base, cdf.tolist()


def sum_of_logs(n: int) -> float:
    """log(n!)."""
    return float(np.log(np.arange(1, n + 1)).sum())


def _uniform(seed: int, *keys: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def replicate(docs: DataFrame, plan: DataFrame, key: str = "doc_id", *, seed: int = 0, max_sources: int = MAX_SOURCES) -> DataFrame:
    """``docs`` repeated by the plan: all columns plus ``copy_no`` from 0; unordered, no shuffle of ``docs``.

    Documents of sources outside the plan are left out; a column ``copy_no`` of
    their own is replaced.  Rows that repeat a key
    draw the same number.  The plan is broadcast only after its size is checked;
    beyond ``max_sources`` the documents are joined by (source, salt) instead.
    """

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            drawn = [truncated_cdf(r, int(c)) for r, c in zip(rows["rate"], rows["cap"])]
            yield pd.DataFrame({"source": rows["source"], "__mix_base": [b for b, _ in drawn], "__mix_cdf": [c for _, c in drawn]})

    own = docs.drop("copy_no", *_OWN)
    draws = plan.select("source", "rate", F.coalesce("max_repeats", F.lit(0)).alias("cap")).mapInPandas(invert, "source string, __mix_base int, __mix_cdf array<double>")
    small = [tuple(r) for r in draws.limit(max_sources + 1).collect()]
    if len(small) <= max_sources:
        joined = own.join(F.broadcast(docs.sparkSession.createDataFrame(small, draws.schema)), "source")
    else:
        salted = draws.withColumn("__mix_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = own.withColumn("__mix_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["source", "__mix_salt"])
    u = _uniform(seed, key)
    times = F.col("__mix_base") + F.size(F.filter("__mix_cdf", lambda c: c < u))
    many = joined.withColumn("__mix_n", times).where("__mix_n > 0")
    return many.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1))).drop(*_OWN)


def shuffled(copies: DataFrame, key: str = "doc_id", *, seed: int = 0) -> DataFrame:
    """``copies`` in a global random order that seed, key and copy number alone fix; ``position`` is the sort key."""
    return copies.withColumn("position", F.xxhash64(F.lit(seed + 1), key, "copy_no")).orderBy("position", key, "copy_no")


def shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: target and reached share, copies, tokens, and whether it is short by what was mixed.

    ``short`` is read off the copies: every token of the source is there as often
    as the cap allows, and still there are fewer than the target.  That holds
    exactly for the sources whose tokens times the cap are fewer, since those
    alone reach the cap with every document; one without tokens is there in full.
    """
    got = copies.groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("mixed_tokens"))
    both = plan.join(got, "source", "left").na.fill(0, ["copies", "mixed_tokens"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    full = F.col("mixed_tokens") == F.col("tokens") * F.coalesce("max_repeats", F.lit(0))
    short = F.col("max_repeats").isNotNull() & full & (F.col("mixed_tokens").cast("double") < F.col("target_share") * F.col("total"))
    return both.select(
        "source", "target_share", "tokens", "rate", F.coalesce(short, F.lit(False)).alias("short"), "copies", "mixed_tokens",
        F.coalesce(F.col("mixed_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("reached_share"),
    )
