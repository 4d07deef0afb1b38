"""Cluster bootstrap, jackknife and power, for many groups at once.

A replicate draws as many clusters as there are, whole, with replacement, and takes the mean
over their cases. Clusters are summed first, once, so that nothing grows with cases. Three ways to draw:

* ``replicates`` of a group of few clusters loops over their array; draws come from SHA-256, so
  that they don't depend on partitioning.
* ``replicates`` of a group of many clusters splits them into blocks by hash. How many of a
  replicate's draws fall to a block follows from binomial draws on the way to it in a tree of
  halves, the same ones for all blocks below; a block draws among its own clusters and sends
  one sum for each replicate. No task holds more than a block, nothing has replicates times
  clusters rows.
* ``exact_bootstrap``: each group's draws from Python's ``random.Random(seed)``, one
  ``randrange`` a draw, for results to the last digit.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence
from statistics import NormalDist, fmean, pstdev

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import draw

RESAMPLES, LEVEL, SEED = 5000, 0.95, 0


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_ppf(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError(f"a probability in (0, 1) is needed, not {p}")
    return NormalDist().inv_cdf(p)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right (unique by keys) on keys, nulls too; without keys, right is one row."""
    keys = list(keys)
    if not keys:
        return left.withColumn("__one", F.lit(0)).join(F.broadcast(right.withColumn("__one", F.lit(0))), "__one", how).drop("__one")
    right = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    on = [left[c].eqNullSafe(right[f"__{c}"]) for c in keys]
    return left.join(right, on, how).drop(*(f"__{c}" for c in keys))


def summed(sums: DataFrame, *keys: str) -> DataFrame:
    """sums of clusters (keys, cluster, total, n), computed once and kept, with the number ``k`` of clusters in each group.

    What is kept spills to disk and is computed again where an executor is lost; unpersist() or clearCache() frees it.
    """
    sums = sums.persist(StorageLevel.MEMORY_AND_DISK)
    return _same(sums, sums.groupBy(*keys).agg(F.count("*").alias("k")), keys)


def clusters(observations: DataFrame, *keys: str) -> DataFrame:
    """total and n of each cluster, and the number ``k`` of clusters in its group."""
    return summed(observations.groupBy(*keys, "cluster").agg(F.sum("value").alias("total"), F.count("*").alias("n")), *keys)


#: Clusters of a group that one row holds (some 50 bytes each) while its replicates are drawn; more are dealt over blocks of about BLOCK_CLUSTERS.
HELD_CLUSTERS, BLOCK_CLUSTERS = 2000, 4096
#: Draws that a block makes at a time.
TOGETHER = 1 << 22


def replicates(sums: DataFrame, resamples: int, seed: int, *keys: str, held_clusters: int = HELD_CLUSTERS) -> DataFrame:
    """The mean of each replicate of each group. sums: as of clusters(), of which some are looked at when this is called."""
    reps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("rep")
    # A group's clusters in one array: a replicate is a loop over it, without a join or a shuffle.
    few = sums.where(F.col("k") <= held_clusters).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", "total", "n"))).alias("c")).where("size(c) > 0").select(*keys, "c", reps)

    def add(acc, j):
        one = F.get("c", draw(F.size("c").cast("long"), F.lit(str(seed)), F.col("rep"), j).cast("int"))
        return F.struct((acc["total"] + one["total"]).alias("total"), (acc["n"] + one["n"]).alias("n"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    mean = F.aggregate(F.sequence(F.lit(0).cast("long"), F.size("c").cast("long") - 1), start, add, lambda acc: acc["total"] / acc["n"])
    looped = few.select(*keys, "rep", mean.alias("mean"))
    many = sums.where(F.col("k") > held_clusters)
    # Whether any group is large is asked of the sums, which are kept: without one the plan is the loop alone.
    return looped if many.isEmpty() else looped.unionByName(_split(many, resamples, seed, keys))


def _generator(*key) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:16], "big")))


def block_sums(total: np.ndarray, n: np.ndarray, path: Sequence[tuple[int, int, int, int]], block: int, clusters_in_all: int, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, cases) that each replicate draws from one block. path: (depth, prefix, clusters below, of these on the left) from the root."""
    left_to_draw = np.full(resamples, clusters_in_all, np.int64)
    for depth, prefix, here, left in path:
        to_left = _generator(seed, depth, prefix).binomial(left_to_draw, left / here)
        goes_left = (block >> (len(path) - depth - 1)) & 1 == 0
        left_to_draw = to_left if goes_left else left_to_draw - to_left
    rng, totals, cases = _generator(seed, len(path), block, "leaf"), np.zeros(resamples), np.zeros(resamples, np.int64)
    ends = np.cumsum(left_to_draw)
    lo = 0
    while lo < resamples:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        drawn = rng.integers(0, len(total), int(ends[hi - 1] - before))
        rep = np.repeat(np.arange(hi - lo), left_to_draw[lo:hi])
        totals[lo:hi] = np.bincount(rep, weights=total[drawn], minlength=hi - lo)
        cases[lo:hi] = np.bincount(rep, weights=n[drawn], minlength=hi - lo)
        lo = hi
    return totals, cases


def _split(many: DataFrame, resamples: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """replicates() of groups of many clusters: blocks are the leaves of a tree over the clusters' hashes."""
    own = [f"__key{i}" for i in range(len(keys))]
    many = many.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), "cluster", "total", "n", "k")
    many = many.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("k") / BLOCK_CLUSTERS))).cast("int"))
    many = many.withColumn("block", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(xxhash64(cluster), 64 - depth)")))
    leaves = many.groupBy(*own, "depth", "block").agg(F.count("*").alias("size"))
    ways = leaves.where("depth > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("d")).withColumn("prefix", F.expr("shiftright(block, depth - d)"))
    on_left = F.expr("shiftright(block, depth - d - 1) % 2 = 0")
    nodes = ways.groupBy(*own, "d", "prefix").agg(F.sum("size").alias("here"), F.sum(F.when(on_left, F.col("size")).otherwise(0)).alias("left"))
    paths = _same(ways.select(*own, "block", "d", "prefix"), nodes, [*own, "d", "prefix"]).groupBy(*own, "block").agg(F.sort_array(F.collect_list(F.struct("d", "prefix", "here", "left"))).alias("path"))

    # Names of its own: both tables come from the same clusters.
    paths = paths.select(*(F.col(c).alias(f"of_{c}") for c in (*own, "block")), "path")

    def drawn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("cluster")
        path = [tuple(step.values()) for step in right["path"][0].as_py()] if right.num_rows else []
        total, n = block_sums(left["total"].to_numpy(), left["n"].to_numpy(), path, left["block"][0].as_py(), left["k"][0].as_py(), resamples, seed) if left.num_rows else (np.empty(0), np.empty(0, np.int64))
        constant = [pa.array([k.as_py()] * len(total), k.type) for k in key[: len(own)]]
        return pa.Table.from_arrays([*constant, pa.array(np.arange(len(total))), pa.array(total), pa.array(n)], [*own, "rep", "total", "n"])

    schema = "".join(f"{o} {many.schema[o].dataType.simpleString()}, " for o in own) + "rep long, total double, n long"
    parts = many.groupBy(*own, "block").cogroup(paths.groupBy(*(f"of_{c}" for c in (*own, "block")))).applyInArrow(drawn, schema)
    means = parts.groupBy(*own, "rep").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), "rep", "mean")


def jackknife(sums: DataFrame, *keys: str) -> DataFrame:
    """The mean without each cluster."""
    whole = sums.groupBy(*keys).agg(F.sum("total").alias("__total"), F.sum("n").alias("__n"))
    n = F.col("__n") - F.col("n")
    return _same(sums, whole, keys).withColumn("without", F.when(n > 0, (F.col("__total") - F.col("total")) / n).otherwise(0.0)).drop("__total", "__n")


def percentile_intervals(sums: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return intervals(sums, resamples, seed, level, keys, "percentile")


def _bca_levels(*columns: Column) -> Column:
    """bca_levels() of a row for each group."""

    @F.pandas_udf("low double, high double")
    def levels(below: pd.Series, squares: pd.Series, cubes: pd.Series, level: pd.Series) -> pd.DataFrame:
        got = [bca_levels(*row) or (None, None) for row in zip(below, squares, cubes, level)]
        return pd.DataFrame(got, columns=["low", "high"], dtype="float64")

    return levels(*columns)


def intervals(sums: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL, keys: Sequence[str] = ("model_id",), method: str = "bca") -> DataFrame:
    """Point, interval and standard error of each group (of all rows, without keys); degenerate with fewer than two clusters.

    method: percentile, or bca with percentiles where it isn't defined. A group's means, ``resamples`` of them, are one array.
    """
    if method not in ("bca", "percentile"):
        raise ValueError(f"method is {method!r}, not bca or percentile")
    by = list(keys) or ["__all"]
    sums = sums if keys else sums.withColumn("__all", F.lit(0))
    tail = (1 - level) / 2
    point = sums.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("point"), F.sum("n").alias("n_units"), F.count("*").alias("n_clusters"))
    spread = replicates(sums.where("k > 1"), resamples, seed, *by).groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("means"), F.stddev_pop("mean").alias("std_error"))
    rows = _same(point, spread, by, "left")
    low, high, used = F.lit(tail), F.lit(1 - tail), F.lit("percentile")
    if method == "bca":
        # Sums of the jackknife's deviations by moments about the point, which is near them.
        near = _same(jackknife(sums, *by), point.select(*by, "point"), by).withColumn("u", F.col("without") - F.col("point"))
        m = [F.avg(F.pow("u", F.lit(float(p)))) for p in (1, 2, 3)]
        n = F.count("*").cast("double")
        sums_of = near.groupBy(*by).agg((n * (m[1] - m[0] * m[0])).alias("squares"), (-n * (m[2] - 3 * m[0] * m[1] + 2 * m[0] * m[0] * m[0])).alias("cubes"))
        # A replicate that draws every cluster once is the point but for the order of its sums: it isn't below.
        near_point = F.col("point") - F.abs("point") * 1e-12
        below = F.size(F.filter("means", lambda x: x < near_point)) / F.size("means")
        rows = _same(rows, sums_of, by, "left").withColumn("levels", _bca_levels(below, F.col("squares"), F.col("cubes"), F.lit(level)))
        used = F.when(F.col("levels.low").isNull(), "percentile").otherwise("bca")
        low, high = F.coalesce("levels.low", low), F.coalesce("levels.high", high)

    def at(q):
        place = q * (F.size("means") - 1)
        lo = F.floor(place).cast("int")
        one = F.get("means", lo)
        return one + (F.get("means", F.least(lo + 1, F.size("means") - 1)) - one) * (place - lo)

    none = F.col("means").isNull()
    return rows.select(
        *keys, "point", F.coalesce(at(low), "point").alias("low"), F.coalesce(at(high), "point").alias("high"),
        F.coalesce("std_error", F.lit(0.0)).alias("std_error"), "n_units", "n_clusters", F.when(F.col("n_clusters") == 0, "empty").when(none, "degenerate").otherwise(used).alias("method"),
    )


def quantile(values: Sequence[float], q: float) -> float:
    """Type 7, of sorted values."""
    at = q * (len(values) - 1)
    lo = math.floor(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)


def bca_levels(below: float | None, squares: float | None, cubes: float | None, level: float) -> tuple[float, float] | None:
    """The two levels of the bias-corrected, accelerated interval, or None where it isn't defined.

    below: the share of replicates under the point; squares and cubes: sums of the jackknife's deviations from its mean.
    """
    if below is None or squares is None or not 0 < below < 1 or not squares > 1e-24:
        return None
    z, a = normal_ppf(below), cubes / (6 * squares**1.5)
    out = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        x = z + normal_ppf(p)
        if abs(1 - a * x) < 1e-12:
            return None
        out.append(normal_cdf(z + x / (1 - a * x)))
    return (out[0], out[1]) if 0 < out[0] < out[1] < 1 else None


def bca_quantiles(means: Sequence[float], point: float, without: Sequence[float], level: float) -> tuple[float, float] | None:
    """bca_levels() of a group's replicates and jackknife."""
    centre = fmean(without)
    d = [centre - w for w in without]
    return bca_levels(sum(m < point for m in means) / len(means), sum(x * x for x in d), sum(x**3 for x in d), level)


def exact_bootstrap(observations: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL, method: str = "bca", keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """The interval of each group by draws of Python's generator; BCa where it is defined, else percentiles.

    observations: keys, cluster, value, and ``ordinal``, by which clusters are numbered in order of first appearance.
    A group's clusters are summed before one task draws among them.
    """
    if method not in ("bca", "percentile"):
        raise ValueError(f"method is {method!r}, not bca or percentile")
    sums = observations.groupBy(*keys, "cluster").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        total, n, k = pdf["total"].tolist(), pdf["n"].tolist(), len(pdf)
        all_total, all_n = math.fsum(total), sum(n)
        point = all_total / all_n
        row = dict(zip(keys, pdf[list(keys)].iloc[0])) | {"point": point, "low": point, "high": point, "std_error": 0.0, "n_units": all_n, "n_clusters": k, "method": "degenerate"}
        if k > 1 and resamples > 1:
            rng = random.Random(seed)
            means = []
            for _ in range(resamples):
                at = [rng.randrange(k) for _ in range(k)]
                means.append(math.fsum(total[i] for i in at) / sum(n[i] for i in at))
            means.sort()
            without = [(all_total - t) / (all_n - m) if all_n > m else 0.0 for t, m in zip(total, n)]
            q = bca_quantiles(means, point, without, level) if method == "bca" else None
            lo, hi = q or ((1 - level) / 2, (1 + level) / 2)
            row |= {"low": quantile(means, lo), "high": quantile(means, hi), "std_error": pstdev(means), "method": "bca" if q else "percentile"}
        return pd.DataFrame([row])

    schema = "".join(f"{observations.schema[c].simpleString().replace(':', ' ', 1)}, " for c in keys) + "point double, low double, high double, std_error double, n_units long, n_clusters long, method string"
    return sums.groupBy(*keys).applyInPandas(interval, schema)


def mde(std_error: Column, level: float = LEVEL, power: float = 0.8) -> Column:
    """The least difference that a paired comparison with this standard error finds with the given power."""
    return std_error * F.lit(normal_ppf((1 + level) / 2) + normal_ppf(power))


def required_cases(sigma: Column, effect: Column, level: float = LEVEL, power: float = 0.8) -> Column:
    """How many cases it takes to find an effect; 0 where effect or sigma isn't over 0."""
    z = normal_ppf((1 + level) / 2) + normal_ppf(power)
    n = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(z) * sigma / effect, 2)))
    return F.when((effect <= 0) | (sigma <= 0), F.lit(0)).otherwise(n).cast("long")
