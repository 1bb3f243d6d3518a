"""OHLC bars from event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars(ticks: DataFrame, series: Column, bucket: Column, price: Column, order: list[Column]) -> DataFrame:
    """series, ts, open, high, low, close of the positive prices of each bucket; open and close by the given order within it."""
    rows = ticks.where(price > 0).select(series.alias("series"), bucket.alias("ts"), price.alias("price"), F.struct(*order).alias("at"))
    return rows.groupBy("series", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close")
    )


def hourly_bars(events: DataFrame) -> DataFrame:
    return bars(events, F.lit("all"), F.date_trunc("hour", "ts"), F.col("value"), [F.col("ts"), F.col("event_id")])


def hourly_bars_by_type(events: DataFrame) -> DataFrame:
    return bars(events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), [F.col("ts"), F.col("event_id")])


def hourly_bars_between(events: DataFrame, start: str, end: str) -> DataFrame:
    """hourly_bars() of the hours from start to end, both included; the range is laid on the ticks, so the scan skips what is outside."""
    hours = events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp") + F.expr("interval 1 hour")))
    return between(hourly_bars(hours), start, end)


def daily_bars_by_type(events: DataFrame) -> DataFrame:
    return bars(events, F.col("event_type"), F.date_trunc("day", "ts"), F.col("value"), [F.col("ts"), F.col("event_id")])


def daily_order_bars(orders: DataFrame) -> DataFrame:
    return bars(orders, F.lit("orders"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), [F.col("o_orderkey")])


def between(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of a date range, ends included; the predicate reaches the scan where ts is a stored column."""
    return frame.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
