"""A simulated return series, for tests only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def synthetic_returns(spark: SparkSession, seeds: list[int], n: int = 900, n_train: int = 700) -> DataFrame:
    """series, t, ts, ret, proxy and split of a GARCH(1,1) process for each seed, made in parallel."""
    omega, alpha, beta = 2e-6, 0.08, 0.90  # fixed values of the process

    def make(frames):
        for frame in frames:
            for seed in frame["seed"]:
                rng = np.random.default_rng(int(seed))
                h, ret = np.empty(n), np.empty(n)
                for t in range(n):
                    h[t] = omega + alpha * ret[t - 1] ** 2 + beta * h[t - 1] if t else omega / (1 - alpha - beta)
                    ret[t] = np.sqrt(h[t]) * rng.standard_normal()
                proxy = h * rng.chisquare(df=8, size=n) / 8
                days = pd.date_range("2015-01-01", periods=n)
                yield pd.DataFrame({"series": str(seed), "t": np.arange(n), "ts": days, "ret": ret, "proxy": proxy, "split": np.where(np.arange(n) < n_train, "train", "test")})

    rows = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds))
    return rows.mapInPandas(make, "series string, t int, ts timestamp, ret double, proxy double, split string")
