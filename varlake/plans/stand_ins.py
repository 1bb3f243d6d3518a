"""Deterministic forecasters by window functions: moving averages of squared returns and the proxy of the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WINDOWS = (5, 20, 60)


def stand_in_forecasts(rows: DataFrame, first: int, actual: str = "garman_klass") -> DataFrame:
    """series, t, model, model_ord, forecast, actual for t from `first`; each forecast only knows rows before t. One window pass and one unpivot."""
    w = Window.partitionBy("series").orderBy("t")
    made = [(f"MA-{k}", F.avg("squared").over(w.rowsBetween(-k, -1))) for k in WINDOWS] + [("LAG-GK", F.lag(actual).over(w))]
    each = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_ord"), c.alias("forecast")) for i, (name, c) in enumerate(made)))
    wide = rows.select("series", "t", F.col(actual).alias("actual"), each.alias("m")).where(F.col("t") >= first)
    return wide.select("series", "t", "actual", F.explode("m").alias("m")).select("series", "t", "m.*", "actual")
