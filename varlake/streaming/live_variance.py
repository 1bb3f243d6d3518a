"""One-step variance forecasts and lag rows of a stream of returns: parameters stay as fitted, and each series and model carries its state: one number, or for FIGARCH the squares of the returns that its sum reaches back to."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import garch
from ..shipping import ship_package
from .live_bars import new_folder

ROWS = "series string, model string, t long, ret double, h double, next_h double, late boolean"
STATE = "state double, t long, past array<double>"


def stream_variance(returns: DataFrame, states: DataFrame) -> DataFrame:
    """series, model, t, ret, h, next_h and late of each return of the stream: the variance expected before the return and the one after it.

    returns holds series, t and ret; states is forecasting.fitted_states(), which the stream is joined to as a table. Returns are
    taken in the order of t within a batch. One whose t the state has passed can't be put in any more: it comes out as late,
    without variances, and leaves the state alone. So does a repeated t. A null or non-finite return does the same but isn't late."""
    ship_package(returns.sparkSession)
    rows = returns.select(F.col("series").cast("string").alias("series"), F.col("t").cast("long").alias("t"), F.col("ret").cast("double").alias("ret"))
    known = states.select("series", "model", "spec", "p", F.col("state").alias("first_state"), F.col("t").alias("first_t"), (F.col("past") if "past" in states.columns else F.lit(None).cast("array<double>")).alias("first_past"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("t", kind="stable")
        spec, p = frame["spec"].iloc[0], np.array(frame["p"].iloc[0], float)
        first = frame["first_past"].iloc[0]
        state, last, past = held.get if held.exists else (float(frame["first_state"].iloc[0]), int(frame["first_t"].iloc[0]), [] if first is None else list(first))
        past = deque(past, garch.TRUNCATION)
        weights = garch.long_memory(*(p[None, i] for i in (2, 3, 4)))[0] if spec == "FIGARCH" else None
        before, after, late = [], [], []
        for t, r in zip(frame["t"].tolist(), frame["ret"].tolist()):
            late.append(t <= last)
            if late[-1] or r is None or not np.isfinite(r):
                before.append(None)
                after.append(None)
                continue
            before.append(garch.variance_of(spec, p, state) / garch.SCALE**2)
            if weights is None:
                state = garch.advance(spec, p, state, r * garch.SCALE)
            else:
                past.append((r * garch.SCALE - p[0]) ** 2)
                state = garch.remembered(p, np.array(past), weights)
            last = t
            after.append(garch.variance_of(spec, p, state) / garch.SCALE**2)
        held.update((float(state), int(last), [float(x) for x in past]))
        yield pd.DataFrame({"series": key[0], "model": key[1], "t": frame["t"], "ret": frame["ret"], "h": pd.array(before, "Float64"), "next_h": pd.array(after, "Float64"), "late": late})

    return rows.join(known, "series").groupBy("series", "model").applyInPandasWithState(run, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


LAGS, LAG_STATE = "series string, t long, x array<double>, late boolean", "recent array<double>, t long"


def stream_lags(returns: DataFrame, lags: int) -> DataFrame:
    """series, t, x and late of each return of the stream: the newest-first squares and then returns of the last `lags` times up to t, null until there are as many.

    The last returns of each series are its state, so a row comes as its return does. A late, repeated or non-finite return has no lags and leaves the state alone."""
    ship_package(returns.sparkSession)
    rows = returns.select(F.col("series").cast("string").alias("series"), F.col("t").cast("long").alias("t"), F.col("ret").cast("double").alias("ret"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("t", kind="stable")
        recent, last = held.get if held.exists else ([], None)
        recent, made, late = deque(recent, lags), [], []
        for t, r in zip(frame["t"].tolist(), frame["ret"].tolist()):
            late.append(last is not None and t <= last)
            if late[-1] or r is None or not np.isfinite(r):
                made.append(None)
                continue
            recent.append(r)
            last = t
            newest = list(recent)[::-1]
            made.append([*(v * v for v in newest), *newest] if len(recent) == lags else None)
        held.update(([float(v) for v in recent], last))
        yield pd.DataFrame({"series": key[0], "t": frame["t"], "x": made, "late": late})

    return rows.groupBy("series").applyInPandasWithState(run, LAGS, LAG_STATE, "append", GroupStateTimeout.NoTimeout)


def appended(returns: DataFrame, states: DataFrame, target: str, checkpoint: str) -> None:
    """Runs the stream over what is there and appends its rows to Parquet at target; a later call with the same checkpoint goes on from the states held there."""
    made = stream_variance(returns, states).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    made.trigger(availableNow=True).start().awaitTermination()


def replayed(returns: DataFrame, states: DataFrame, parts: int = 2) -> DataFrame:
    """The stream over a table of returns, each series' times in `parts` pieces that arrive one after the other, each in a run of its own."""
    spark = returns.sparkSession
    name = new_folder(spark, "variance")
    piece = F.ntile(parts).over(Window.partitionBy("series").orderBy("t"))
    returns.select("series", F.col("t").cast("long").alias("t"), "ret", piece.alias("part")).write.partitionBy("part").parquet(f"{name}/table")
    arrivals = spark.read.schema("series string, t long, ret double, part int").parquet(f"{name}/table")
    for part in range(1, parts + 1):
        arrivals.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{name}/arrived")
        appended(spark.readStream.schema("series string, t long, ret double").parquet(f"{name}/arrived"), states, f"{name}/rows", f"{name}/state")
    return spark.read.parquet(f"{name}/rows")
