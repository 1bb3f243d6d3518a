"""Forecasts scored as their actuals arrive: a stream-stream left outer join under two watermarks, and the losses of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.losses import with_losses
from .live_bars import new_folder

END = "__end__"  # the series of the rows that only move the watermarks on


def stream_scores(forecasts: DataFrame, actuals: DataFrame, wait: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """series, model, t, ts, forecast and actual with the losses, once for each forecast: when its actual has come, or with nulls once both watermarks have passed the time to wait for it.

    forecasts holds series, model, t, ts and forecast, actuals series, t, actual_ts and actual; the actual of a forecast for ts comes from ts on and at most `wait` later. What is later than `late` is dropped, so the state holds that span only."""
    f = forecasts.select("series", "model", "t", F.col("ts").cast("timestamp").alias("ts"), "forecast").withWatermark("ts", late)
    a = actuals.select(F.col("series").alias("series_"), F.col("t").alias("t_"), F.col("actual_ts").cast("timestamp").alias("actual_ts"), "actual").withWatermark("actual_ts", late)
    on = (F.col("series") == F.col("series_")) & (F.col("t") == F.col("t_")) & (F.col("actual_ts") >= F.col("ts")) & (F.col("actual_ts") <= F.col("ts") + F.expr(f"interval {wait}"))
    return with_losses(f.join(a, on, "left_outer").select("series", "model", "t", "ts", "forecast", "actual"))


def running_metrics(scores: DataFrame) -> DataFrame:
    """Of the scores that are there so far: how many forecasts each model has, how many wait for no actual, and the means of the losses."""
    return scores.groupBy("series", "model").agg(F.count("*").alias("n"), F.count("actual").alias("n_scored"), F.sqrt(F.avg("squared")).alias("rmse"), F.avg("absolute").alias("mae"), F.avg("qlike").alias("qlike"))


def replayed(forecasts: DataFrame, actuals: DataFrame, parts: int = 2, wait: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The scores of tables of forecasts and actuals, whose times arrive in `parts` pieces, the actuals of a piece after its forecasts; a last pair of rows closes the join."""
    spark: SparkSession = forecasts.sparkSession
    name = new_folder(spark, "scores")
    sides = {"forecasts": (forecasts.select("series", "model", "t", "ts", "forecast"), "ts"), "actuals": (actuals.select("series", "t", "actual_ts", "actual"), "actual_ts")}
    low, high = forecasts.agg(F.min("ts"), F.max("ts")).first()
    step = (F.unix_timestamp(F.lit(high)) - F.unix_timestamp(F.lit(low))) / parts + 1

    def run() -> None:
        streams = [spark.readStream.schema(frame.schema).parquet(f"{name}/{side}") for side, (frame, _) in sides.items()]
        made = stream_scores(*streams, wait, late).writeStream.outputMode("append").format("parquet").option("path", f"{name}/rows").option("checkpointLocation", f"{name}/state")
        made.trigger(availableNow=True).start().awaitTermination()

    for side, (frame, at) in sides.items():
        piece = F.floor((F.unix_timestamp(at) - F.unix_timestamp(F.lit(low))) / step)
        frame.withColumn("piece", F.least(piece, F.lit(parts - 1))).write.partitionBy("piece").parquet(f"{name}/{side}_table")
    for k in range(parts):
        for side, (frame, _) in sides.items():
            spark.read.schema(T.StructType([*frame.schema.fields, T.StructField("piece", T.IntegerType())])).parquet(f"{name}/{side}_table").where(F.col("piece") == k).drop("piece").write.mode("append").parquet(f"{name}/{side}")
            if side == "forecasts" and k == 0:
                actuals.sparkSession.createDataFrame([], sides["actuals"][0].schema).write.mode("append").parquet(f"{name}/actuals")
            run()
    for side, (frame, at) in sides.items():
        later = F.lit(high) + F.expr("interval 30 days")
        frame.limit(1).withColumn("series", F.lit(END)).withColumn(at, later.cast(frame.schema[at].dataType)).write.mode("append").parquet(f"{name}/{side}")
    run()
    run()
    return spark.read.parquet(f"{name}/rows").where(F.col("series") != END)
