"""Losses, metrics and the screen of degenerate forecasts, over forecasts(series, model, model_ord, t, forecast, actual)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import base_model

NAN, INF = float("nan"), float("inf")


def qlike(f: Column, a: Column) -> Column:
    """ln f + a / f with the values of IEEE arithmetic where f isn't positive."""
    return F.when(f > 0, F.ln(f) + a / f).when((f == 0) & (a < 0), F.lit(-INF)).when(f <= 0, F.lit(NAN)).when(F.isnan(f), F.lit(NAN))


LOSSES = {"squared": lambda f, a: (f - a) * (f - a), "absolute": lambda f, a: F.abs(f - a), "qlike": qlike}


def loss(name: str, f: Column, a: Column) -> Column:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; one of {sorted(LOSSES)}")
    return LOSSES[name](f, a)


def with_losses(forecasts: DataFrame) -> DataFrame:
    f, a = F.col("forecast"), F.col("actual")
    return forecasts.select("*", (f - a).alias("error"), *(loss(n, f, a).alias(n) for n in LOSSES))


def at_their_time(steps: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts of several steps, rows(series, t, ahead, ...), beside the actual of the time t + ahead - 1 that each is for, null where there is none; actuals(series, t, actual), and model where they differ by it."""
    by = [c for c in ("series", "model") if c in actuals.columns]
    known = actuals.select(*by, F.col("t").alias("at"), "actual")
    return steps.withColumn("at", F.col("t") + F.col("ahead") - 1).join(known, [*by, "at"], "left").drop("at")


def metrics(forecasts: DataFrame, by: Sequence[str] = ("series", "model")) -> DataFrame:
    """One aggregation for all: rmse, mae, mse and qlike of each series and model, or of what `by` names."""
    f, a = F.col("forecast"), F.col("actual")
    mse = F.avg(loss("squared", f, a))
    return forecasts.groupBy(*by).agg(F.sqrt(mse).alias("rmse"), F.avg(loss("absolute", f, a)).alias("mae"), mse.alias("mse"), F.avg(qlike(f, a)).alias("qlike"))


def diagnostics(forecasts: DataFrame, ratio: float = 1e4, qlike_cap: float = 1e3, tolerance: float = 2.0) -> DataFrame:
    """The screen of each series and model: counts of odd forecasts, bias, and whether it is degenerate or biased."""
    f, a = F.col("forecast"), F.col("actual")
    finite = F.coalesce(F.abs(f) < INF, F.lit(False))
    known = F.coalesce(F.abs(a) < INF, F.lit(False))
    bounds = forecasts.groupBy("series").agg(F.min(F.when(known & (a > 0), a)).alias("lo"), F.max(F.when(known, a)).alias("hi"))
    rows = forecasts.join(bounds, "series")
    out = rows.groupBy("series", "model").agg(
        F.count("*").alias("n"), F.min(F.when(~F.isnan(f), f)).alias("min_forecast"), F.max(F.when(~F.isnan(f), f)).alias("max_forecast"),
        F.count_if(~finite).alias("n_nonfinite"), F.count_if(finite & (f <= 0)).alias("n_nonpositive"),
        F.count_if(finite & (f > 0) & (f < F.col("lo") / ratio)).alias("n_extreme_low"), F.count_if(finite & (F.col("hi") > 0) & (f > F.col("hi") * ratio)).alias("n_extreme_high"),
        F.avg(F.when(finite, f)).alias("mean_forecast"), F.avg(F.when(known, a)).alias("mean_proxy"), F.sqrt(F.avg((f - a) * (f - a))).alias("rmse"), F.avg(qlike(f, a)).alias("qlike"),
    )
    out = out.withColumn("bias_ratio", F.when(F.col("mean_proxy") > 0, F.col("mean_forecast") / F.col("mean_proxy")))
    wild = F.isnan("qlike") | (F.abs("qlike") > qlike_cap) | F.col("qlike").isNull()
    out = out.withColumn("degenerate", (F.col("n_nonfinite") + F.col("n_nonpositive") + F.col("n_extreme_low") + F.col("n_extreme_high") > 0) | wild)
    return out.withColumn("biased", F.coalesce((F.col("bias_ratio") > tolerance) | (F.col("bias_ratio") < 1 / tolerance), F.lit(False)))


def best_of_group(frame: DataFrame, group: str, by: str) -> DataFrame:
    return frame.groupBy(group).agg(F.min_by("model", F.struct(by, "model")).alias("model"), F.min(by).alias(by))


def merged(*results: DataFrame) -> DataFrame:
    """The union of groups of results; an error if a group is empty or a model is in several."""
    out = results[0].withColumn("part", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("part", F.lit(i)))
    held = out.groupBy("model").agg(F.collect_set("part").alias("parts")).collect()  # a row for each model
    if len({p for r in held for p in r["parts"]}) < len(results):
        raise RuntimeError("a group of results is empty")
    if twice := [r["model"] for r in held if len(r["parts"]) > 1]:
        raise RuntimeError(f"models in several groups: {twice}")
    return out.drop("part")


def overwritten(*results: DataFrame) -> DataFrame:
    """The union of groups of results in which a later group's rows of a model replace the earlier ones'."""
    out = results[0].withColumn("part", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("part", F.lit(i)))
    last = out.groupBy("model").agg(F.max("part").alias("part"))
    return out.join(last, ["model", "part"], "left_semi").drop("part")


def trouble() -> list[Column]:
    """The order of by_trouble(): a qlike that is no number comes last among its like, as one that is missing does."""
    return [F.desc("degenerate"), F.desc("biased"), F.coalesce(F.isnan("qlike"), F.lit(True)), F.desc_nulls_last("qlike"), F.col("series"), F.col("model")]


def by_trouble(screened: DataFrame) -> DataFrame:
    """The rows of diagnostics(), degenerate models first, then biased ones, each by qlike from the highest."""
    return screened.orderBy(*trouble())


def excluded(screened: DataFrame) -> DataFrame:
    """The models of each series to be left out before tests are trusted, by name, as one list."""
    return screened.where("degenerate").groupBy("series").agg(F.array_sort(F.collect_list("model")).alias("models"))


def with_base(hybrids: DataFrame, metrics_: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The metrics of hybrid models beside those of the classical model inside their name (and of alike `more`); null where that one is missing."""
    base = metrics_.select("series", F.col("model").alias("base"), *more, *(F.col(c).alias(f"base_{c}") for c in ("rmse", "qlike")))
    return hybrids.withColumn("base", base_model(F.col("model"))).join(base, ["series", "base", *more], "left")
