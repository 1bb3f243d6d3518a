"""OHLC bars of an unbounded tick stream: event-time windows with a watermark, appended once each is complete."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.bars import hourly_bars


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder in the shared one that the session names; only a local master may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
    return f"{base or tempfile.mkdtemp(prefix='varlake-')}/{kind}_{uuid.uuid4().hex}"


def stream_bars(ticks: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """ts, open, high, low and close of each window of positive prices; ticks later than `late` are dropped."""
    rows = ticks.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    made = rows.groupBy(F.window("ts", width).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))
    return made.select(F.col("w.start").alias("ts"), "open", "high", "low", "close")


def appended(spark: SparkSession, ticks: DataFrame, target: str, checkpoint: str, late: str = "2 hours") -> DataFrame:
    """Runs the stream over what is there and appends each window that the watermark has passed to Parquet at target; windows still open stay in the checkpoint's state for the next call."""
    made = stream_bars(ticks, late).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    made.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The stream over a folder's events table: the bars that the watermark closed from files, and the hours after it, still open, from the table."""
    path = f"{folder}/events.parquet"
    events = spark.read.parquet(path)
    ticks = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    name = new_folder(spark, "bars")
    closed = appended(spark, ticks, f"{name}/rows", f"{name}/state")
    last = closed.agg(F.max("ts")).first()[0]
    still = events if last is None else events.where(F.col("ts") >= F.lit(last) + F.expr("interval 1 hour"))
    return closed.select("ts", "open", "high", "low", "close").unionByName(hourly_bars(still).select("ts", "open", "high", "low", "close"))
