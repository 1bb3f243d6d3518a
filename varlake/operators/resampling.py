"""Stationary bootstrap: blocks of geometric length from uniform starts, around the end of a sample. Each replicate has a generator of its own, so replicates can be dealt over tasks as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def blocks(n: int, mean_size: float, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the blocks of one resample of n places; no more than n blocks are needed, as each has a place at least."""
    rng = np.random.default_rng(seed)
    ends = np.minimum(np.cumsum(rng.geometric(1 / mean_size, n)), n)
    sizes = np.diff(ends, prepend=0)
    sizes = sizes[sizes > 0]
    return rng.integers(0, n, len(sizes)), sizes


def places(n: int, mean_size: float, seed: list[int]) -> np.ndarray:
    """The places of one resample."""
    starts, sizes = blocks(n, mean_size, seed)
    return (np.arange(n) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)) % n


def edges(n: int, mean_size: float, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights such that the weighted sum of running totals there is the sum over the resample."""
    starts, sizes = blocks(n, mean_size, seed)
    last = starts + sizes - 1
    over = last >= n
    at = np.concatenate([last % n, starts - 1, np.full(over.sum(), n - 1)])
    weight = np.concatenate([np.ones(len(last)), -np.ones(len(starts)), np.ones(over.sum())])
    at, where = np.unique(at, return_inverse=True)
    total = np.bincount(where, weights=weight)
    keep = (at >= 0) & (total != 0)
    return at[keep], total[keep]


def resampled_means(values: DataFrame, replicates: int, size: str, seed: int) -> DataFrame:
    """series, replicate, key and mean of each resample of values(series, key, i, v, n); i numbers a series' n places from 0, and all keys share a resample.

    `size` is the blocks' mean size as a SQL expression of n. A block's sum is the difference of two running totals, so a
    replicate meets each key at its blocks' ends only."""
    total = Window.partitionBy("series", "key").orderBy("i")
    totals = values.select("series", "key", "i", F.sum("v").over(total).alias("upto"))
    drawn = values.groupBy("series").agg(F.max("n").alias("n")).select("series", "n", F.expr(size).cast("double").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))

    def draw(batches):
        for batch in batches:
            found = [edges(n, s, [seed, r]) for n, s, r in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "replicate")))]
            lists = (pa.array([f[j] for f in found], pa.list_(kind)) for j, kind in enumerate((pa.int64(), pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("replicate"), batch.column("n"), *lists], ["series", "replicate", "n", "at", "weight"])

    tasks = values.sparkSession.sparkContext.defaultParallelism
    ends = drawn.repartition(tasks, "series", "replicate").mapInArrow(draw, "series string, replicate int, n long, at array<long>, weight array<double>")
    ends = ends.select("series", "replicate", "n", F.explode(F.arrays_zip("at", "weight")).alias("e")).select("series", "replicate", "n", F.col("e.at").alias("i"), "e.weight")
    return ends.join(totals, ["series", "i"]).groupBy("series", "replicate", "key").agg((F.sum(F.col("weight") * F.col("upto")) / F.max("n")).alias("mean"))
