"""Lag rows, sequences and refit blocks, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import scans


def by_t() -> Window:
    return Window.partitionBy("series").orderBy("t")


def whole() -> Window:
    return Window.partitionBy("series")


def lag_matrix(frame: DataFrame, value: str, target: str, lags: int, more: str | None = None) -> DataFrame:
    """Newest-first lags of the value (and of `more`) up to t, and the target at t + 1, for t from `lags` to the last but one."""
    names = [value] + ([more] if more else [])
    x = F.concat(*(F.reverse(F.collect_list(c).over(by_t().rowsBetween(-(lags - 1), 0))) for c in names))
    rows = frame.select("series", "t", x.alias("x"), F.lead(target).over(by_t()).alias("y"), F.row_number().over(by_t()).alias("rank"), F.count("*").over(whole()).alias("n"))
    return rows.where((F.col("rank") > lags) & (F.col("rank") < F.col("n"))).select("series", "t", "x", "y")


def forecast_row(frame: DataFrame, value: str, lags: int) -> DataFrame:
    """The newest-first lags at the end of each series; only these rows of a series meet."""
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("t")))
    newest = frame.select("series", F.col(value).alias("v"), place.alias("place")).where(F.col("place") <= lags)
    own = newest.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))
    return own.select("series", F.col("s")[0]["v"].alias("newest"), F.transform("s", lambda s: s["v"]).alias("x"))


def sequences(frame: DataFrame, value: str, target: str, lookback: int, channel: str | None = None) -> DataFrame:
    """Oldest-first windows of the value, the target at t + 1, and a channel whose value at t + 1 is repeated over the window."""
    rows = frame.select(
        "series", "t", F.collect_list(value).over(by_t().rowsBetween(-(lookback - 1), 0)).alias("x"), F.lead(target).over(by_t()).alias("y"),
        F.array_repeat(F.lead(channel or target).over(by_t()), lookback).alias("g"), F.row_number().over(by_t()).alias("rank"), F.count("*").over(whole()).alias("n"),
    )
    return rows.where((F.col("rank") > lookback) & (F.col("rank") < F.col("n"))).select("series", "t", "x", "y", *(["g"] if channel else []))


def refit_blocks(spark: SparkSession, n_train: int, n_test: int, every: int = 10, width: int | None = None) -> DataFrame:
    """block, fit_start, fit_end (exclusive), first_step, last_step. A sliding window of `width` keeps its origin within a block; None expands."""
    if width is not None and width > n_train:
        raise ValueError(f"a window of {width} needs as many training rows; there are {n_train}")
    step = F.col("id") * every
    start = F.lit(0).cast("long") if width is None else F.lit(n_train) + step - width
    return spark.range(-(-n_test // every)).select(
        F.col("id").alias("block"), start.alias("fit_start"), (F.lit(n_train) + step).alias("fit_end"), step.alias("first_step"), F.least(step + every - 1, F.lit(n_test - 1)).alias("last_step")
    )


def series_blocks(frame: DataFrame, n_train: int, every: int = 10, width: int | None = None) -> DataFrame:
    """The blocks of refit_blocks for each series, up to its last row."""
    if width is not None and width > n_train:
        raise ValueError(f"a window of {width} needs as many training rows; there are {n_train}")
    blocks = test_counts(frame, n_train).where("n_test > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_test") / every) - 1)))
    step = F.col("block") * every
    start = F.lit(0).cast("long") if width is None else F.lit(n_train) + step - width
    return blocks.select("series", "block", start.alias("fit_start"), (F.lit(n_train) + step).alias("fit_end"), step.alias("first_step"), F.least(step + every - 1, F.col("n_test") - 1).alias("last_step"))


def test_counts(frame: DataFrame, n_train: int) -> DataFrame:
    """series and n_test, its rows after the first n_train."""
    return frame.groupBy("series").agg((F.count("*") - n_train).alias("n_test"))


def block_rows(frame: DataFrame, n_train: int, n_test: int | None, every: int = 10, width: int | None = None) -> DataFrame:
    """frame with a row for each block in whose fitting window or steps it lies, and fit_end; by arithmetic on t. Without n_test, the blocks go on to the last row of each series."""
    if n_test is None:
        rows = frame.join(test_counts(frame, n_train), "series").where("n_test > 0")
        return blocks_of(rows, n_train, F.col("n_test"), every, width).drop("n_test")
    return blocks_of(frame, n_train, F.lit(n_test), every, width)


def blocks_of(frame: DataFrame, n_train: int, n_test: Column, every: int, width: int | None) -> DataFrame:
    last = F.ceil(n_test / every) - 1
    low = F.greatest(F.lit(0), F.floor((F.col("t") - n_train) / every))
    high = last if width is None else F.least(last, F.floor((F.col("t") - n_train + width) / every))
    inside = frame.where((F.col("t") < n_train + n_test) & (low <= high))
    return inside.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long")))).withColumn("fit_end", n_train + F.col("block") * every)


def garch_maps(frame: DataFrame, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    return frame.select("series", F.col("t").cast("long").alias("t"), F.lit(beta).alias("a"), (omega + alpha * F.col("ret") * F.col("ret")).alias("b"), F.lit(start).alias("start"))


def filtered_variance(frame: DataFrame, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """The GARCH(1,1) variance after the last return of each series, with given parameters."""
    rows = garch_maps(frame, omega, alpha, beta, start)
    return scans.last_values(rows, scans.scanned(rows, ["series"]), ["series"])


def variance_path(frame: DataFrame, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """series, t and h: the GARCH(1,1) variance of each time of the series, with given parameters, before its return is known."""
    return scans.scanned(garch_maps(frame, omega, alpha, beta, start), ["series"])
