"""Exact quantiles of large groups: ranks are bracketed by histograms until few values are left, so no task holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..streaming.live_bars import new_folder

BINS = 1024
FEW = 10_000  # values of a bracket that are ranked at once


def exact_quantiles(frame: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ("series",), few: int = FEW, bins: int = BINS) -> DataFrame:
    """by and q, an array of the interpolated quantiles of the values that are neither null nor NaN, for each group that has any.

    A quantile lies between two ranks. Each rank's bracket is cut into bins, all groups at once, and replaced by the least and
    greatest value of the bin that holds the rank, until it has `few` values at most or one value only; a pass narrows it by
    the number of bins, so some passes are enough for any doubles."""
    by = list(by)
    x = F.col(value).cast("double")
    own = frame.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("v"))
    facts = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.array(*(F.lit(float(s)) for s in shares))
    at = F.transform(place, lambda s: s * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda a: F.array(F.floor(a), F.ceil(a)))))
    open_ = _held(facts.select(*by, "n", "lo", "hi", F.explode(ranks).alias("k")).select(*by, "n", "k", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")))
    wide = (F.col("held") > few) & (F.col("lo") < F.col("hi"))
    while open_.where(wide).limit(1).count():
        inside = own.join(open_.where(wide), by).where("v BETWEEN lo AND hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as the difference of two doubles may be none
        found = inside.groupBy(*by, "n", "k", "below", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("bin")) - F.col("c") + F.col("below")
        found = found.withColumn("before", before).where("before <= k AND k < before + c")
        open_ = _held(open_.where(~wide).unionByName(found.select(*by, "n", "k", "lo", "hi", F.col("before").alias("below"), F.col("c").alias("held"))))
    few_ = own.join(open_.where("lo < hi"), by).where("v BETWEEN lo AND hi")
    order = F.row_number().over(Window.partitionBy(*by, "k").orderBy("v")) - 1 + F.col("below")
    values = few_.withColumn("rank", order).where("rank = k").select(*by, "n", "k", "v").unionByName(open_.where("lo = hi").select(*by, "n", "k", F.col("lo").alias("v")))
    held = values.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))

    def between(a):
        low, high = F.element_at("m", F.floor(a)), F.element_at("m", F.ceil(a))
        return F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a)))

    return held.select(*by, F.transform(at, between).alias("q"))


def _held(frame: DataFrame) -> DataFrame:
    """The brackets, two for each share and group, as a table."""
    path = new_folder(frame.sparkSession, "brackets")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
