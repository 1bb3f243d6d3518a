"""Returns, variance proxies, targets and their scaling, all keyed by series and ordered by t."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import exact_quantiles

PROXIES = ("garman_klass", "parkinson", "squared")
LOG_FLOOR, LEVEL_FLOOR = 1e-12, 1e-10


def ordered(*more: str) -> Window:
    return Window.partitionBy("series", *more).orderBy("ts")


def with_returns(frame: DataFrame) -> DataFrame:
    """Bars with the log return since the bar before, without the first of each series, and a dense ordinal t from 0."""
    w = ordered()
    rows = frame.withColumn("ret", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("t", F.row_number().over(w) - 2)
    return rows.where(F.col("ret").isNotNull())


def squared(ret: Column) -> Column:
    return ret * ret


def parkinson(high: Column, low: Column) -> Column:
    return F.pow(F.ln(high / low), 2) / (4 * log(2))


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Not clipped: may be zero or negative."""
    return 0.5 * F.pow(F.ln(high / low), 2) - (2 * log(2) - 1) * F.pow(F.ln(close / open_), 2)


def proxy(name: str) -> Column:
    """The proxy of that name over columns open, high, low, close and ret; any other name means squared returns."""
    if name == "garman_klass":
        return garman_klass(*(F.col(c) for c in ("open", "high", "low", "close")))
    return parkinson(F.col("high"), F.col("low")) if name == "parkinson" else squared(F.col("ret"))


def with_proxies(frame: DataFrame) -> DataFrame:
    return frame.select("*", *(proxy(p).alias(p) for p in PROXIES))


def long_proxies(frame: DataFrame) -> DataFrame:
    return frame.unpivot(["series", "t", "ts"], list(PROXIES), "proxy_name", "proxy")


def split_by_date(frame: DataFrame, train_end: str, test_start: str, test_end: str | None = None) -> DataFrame:
    """Rows with split train or test; rows in neither go."""
    last = F.lit(True) if test_end is None else F.col("ts") <= F.lit(test_end).cast("timestamp")
    kind = F.when(F.col("ts") <= F.lit(train_end).cast("timestamp"), "train").when((F.col("ts") >= F.lit(test_start).cast("timestamp")) & last, "test")
    return frame.withColumn("split", kind).where("split IS NOT NULL")


def moments(frame: DataFrame, value: str, by: str = "series") -> DataFrame:
    """Count, mean, sample deviation, extremes, range, and population skewness and excess kurtosis."""
    v = F.col(value)
    return frame.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )


def summary(frame: DataFrame, values: list[str]) -> DataFrame:
    return frame.groupBy("series").agg(*(f(F.col(v)).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def winsorized(frame: DataFrame, value: str, lower: float = 0.01, upper: float = 0.01) -> DataFrame:
    """The value clipped to its series' interpolated quantiles; one row of bounds for each series is joined to its rows."""
    cut = exact_quantiles(frame, value, (lower, 1 - upper)).select("series", F.col("q")[0].alias("lower_cut"), F.col("q")[1].alias("upper_cut"))
    return frame.join(cut, "series", "left").withColumn("clipped", F.greatest(F.least(F.col(value), F.col("upper_cut")), F.col("lower_cut")))


def robust_scaled(frame: DataFrame, value: str) -> DataFrame:
    """(x - median) / IQR with an IQR of 0 taken as 1, and the way back."""
    q = exact_quantiles(frame, value, (0.25, 0.5, 0.75))
    spread = F.col("q")[2] - F.col("q")[0]
    q = q.select("series", F.col("q")[1].alias("center"), F.when(spread == 0, 1.0).otherwise(spread).alias("spread"))
    rows = frame.join(q, "series", "left").withColumn("scaled", (F.col(value) - F.col("center")) / F.col("spread"))
    return rows.withColumn("restored", F.col("scaled") * F.col("spread") + F.col("center"))


def log_target(frame: DataFrame, value: str, lower: float = 0.01) -> DataFrame:
    """ln of the value, raised to its lower quantile; to the least positive value where that isn't positive, and to 1e-12 where there is none."""
    least = frame.groupBy("series").agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("least"))
    cut = least.join(exact_quantiles(frame, value, (lower,)).select("series", F.col("q")[0].alias("q")), "series", "left")
    floor = F.when(F.col("q") > 0, F.col("q")).otherwise(F.coalesce("least", F.lit(LOG_FLOOR)))
    return frame.join(cut.select("series", floor.alias("floor")), "series").withColumn("target", F.ln(F.greatest(F.col(value), F.col("floor"))))


def resolved_target(frame: DataFrame, value: str) -> DataFrame:
    """The proxy where it covers all rows of a series, squared returns otherwise; a value that isn't finite is an error when the rows are read."""
    x = F.col(value).cast("double")
    covered = frame.groupBy("series").agg(F.every(x.isNotNull()).alias("covered"), F.some(F.isnan(x) | (F.abs(x) == float("inf"))).alias("odd"))
    odd = F.raise_error(F.concat(F.lit(f"{value} is not finite in series "), F.col("series"))).cast("double")
    target = F.when(F.coalesce("odd", F.lit(False)), odd).when(F.col("covered"), x).otherwise(squared(F.col("ret")))
    return frame.join(covered, "series").withColumn("target", target).drop("odd")


def smearing(actual_log: Column, fitted_log: Column) -> Column:
    """The mean of exp(residual), 1 where it isn't finite and positive."""
    s = F.avg(F.exp(actual_log - fitted_log))
    return F.when(F.isnan(s) | (s <= 0) | (s == float("inf")), 1.0).otherwise(F.coalesce(s, F.lit(1.0)))


def retransformed(raw: Column, factor: Column, log_scale: bool) -> Column:
    return F.exp(raw) * factor if log_scale else F.greatest(raw, F.lit(LEVEL_FLOOR))


def recombined(base: Column, correction: Column) -> Column:
    return F.greatest(base + correction, F.lit(LEVEL_FLOOR))


def annualised(h: Column, periods: int = 252) -> Column:
    return F.sqrt(h * periods)


def shading(ret: Column, periods: int = 252) -> Column:
    """For plots only: the root of |r| times the root of the year."""
    return F.sqrt(F.abs(ret) * F.sqrt(F.lit(float(periods))))
