"""Boosted-tree forecasters of variance: alone on lagged returns, or with a fitted variance model's path as a feature or as the base that they correct.

All kinds, series and refit blocks are groups of one booster, so their trees grow together. A lag row of time t is a row of
every block that fits it and of the one that forecasts t, so a block's forecasts come out of the same pass as its trees.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators import features, losses, returns
from ..operators.quantiles import exact_quantiles
from ..shipping import ship_package
from . import garch, trees
from .forecasting import model_name, spread

LAGS = 5
STANDALONE = "XGB-Standalone"


def hybrid_name(base: str, mode: str) -> str:
    if mode not in ("features", "residual"):
        raise ValueError(f"mode must be 'features' or 'residual', not {mode!r}")
    return f"XGB-{base}-{'feat' if mode == 'features' else 'resid'}"


def feature_names(lags: int = LAGS, use_returns: bool = True, hybrid: bool = False) -> list[str]:
    names = [f"sq_lag{i}" for i in range(1, lags + 1)] + ([f"r_lag{i}" for i in range(1, lags + 1)] if use_returns else [])
    return names + (["garch_fc"] if hybrid else [])


def lag_rows(rows: DataFrame, target: str, lags: int = LAGS, use_returns: bool = True) -> DataFrame:
    """series, t, x and y: newest-first lags of squared returns (and returns) before t, and the target at t, from the first t that has them on; rows(series, t, ret, target)."""
    w = features.by_t()
    columns = [F.col("ret") * F.col("ret")] + ([F.col("ret")] if use_returns else [])
    x = F.array(*(F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)))
    return rows.select("series", F.col("t").cast("long").alias("t"), x.alias("x"), F.col(target).cast("double").alias("y")).where(F.col("x")[lags - 1].isNotNull())


def in_blocks(lagged: DataFrame, rows: DataFrame, n_train: int, every: int, width: int | None, lags: int) -> DataFrame:
    """lagged with block and fit, a row for each block that fits or forecasts its t. A window's first lags + 1 times aren't fitted, as their lags begin before it."""
    counted = lagged.join(features.test_counts(rows, n_train), "series").where("n_test > 0")
    own = features.blocks_of(counted, n_train, F.col("n_test"), every, width).drop("n_test")
    start = F.lit(0) if width is None else F.col("fit_end") - width
    fit = F.col("t") < F.col("fit_end")
    return own.where(~fit | (F.col("t") >= start + lags + 1)).withColumn("fit", fit).drop("fit_end")


def base_paths(rows: DataFrame, specs: Sequence[tuple], n_train: int, every: int, width: int | None) -> DataFrame:
    """series, block, base, t and h: the variances of each block's window and steps by models that are fitted to the window; h is what is expected before t's return."""
    ship_package(rows.sparkSession)
    named = F.array(*(F.struct(F.lit(model_name(*m)).alias("base"), F.lit(m[0]).alias("spec"), F.lit(m[1]).alias("dist")) for m in specs))
    own = features.block_rows(rows.select("series", F.col("t").cast("long").alias("t"), "ret"), n_train, None, every, width).withColumn("m", F.explode(named)).select("series", "block", "fit_end", "t", "ret", "m.*")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        fitted, ret = int((f["t"] < f["fit_end"]).sum()), f["ret"].to_numpy()
        p, _ = garch.fit(f["spec"].iloc[0], f["dist"].iloc[0], ret[:fitted])
        h = garch.variances(f["spec"].iloc[0], p[None], ret * garch.SCALE, fitted)[0, :-1] / garch.SCALE**2
        return pd.DataFrame({"series": f["series"], "block": f["block"], "base": f["base"], "t": f["t"], "h": h})

    return spread(own, "series", "block", "base").groupBy("series", "block", "base").applyInPandas(run, "series string, block long, base string, t long, h double")


def model_rows(
    rows: DataFrame, n_train: int, every: int = 10, width: int | None = None, actual: str = "proxy", bases: Sequence[tuple] = (), standalone: bool = True, lags: int = LAGS, use_returns: bool = True,
    modes: Sequence[str] = ("features", "residual"), log_target: bool = True, floor: float = 0.01,
) -> DataFrame:
    """g, i, fit, x and y for the booster, with model, model_ord, series, block, t, target, h and logged.

    The target's logarithm is fitted where `log_target` is set, but never in residual mode, whose differences may be negative."""
    if n_train < lags + 3:
        raise ValueError(f"{lags} lags need {lags + 3} training rows at least; there are {n_train}")
    lagged = in_blocks(lag_rows(returns.resolved_target(rows, actual), "target", lags, use_returns), rows, n_train, every, width, lags)
    kinds = []
    if standalone:
        kinds.append(lagged.withColumn("h", F.lit(None).cast("double")).withColumn("model", F.lit(STANDALONE)).withColumn("logged", F.lit(log_target)))
    if bases:
        paths = trees.written(base_paths(rows, bases, n_train, every, width), "paths")
        joined = lagged.join(paths, ["series", "block", "t"]).withColumn("x", F.concat("x", F.array("h")))
        for mode in modes:
            name = F.concat(F.lit("XGB-"), "base", F.lit("-feat" if mode == "features" else "-resid")) if hybrid_name("", mode) else None
            kinds.append(joined.select(*lagged.columns, "h", name.alias("model"), F.lit(log_target and mode == "features").alias("logged")))
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    out = trees.written(out, "kinds")  # the floors are found in several passes
    names = ([STANDALONE] if standalone else []) + [hybrid_name(model_name(*b), mode) for mode in modes for b in bases]
    by = ["model", "series", "block"]
    least = out.where("fit AND logged").groupBy(*by).agg(F.min(F.when(F.col("y") > 0, F.col("y"))).alias("least"))
    cut = least.join(exact_quantiles(out.where("fit AND logged"), "y", (floor,), by).select(*by, F.col("q")[0].alias("q")), by, "left")
    cut = cut.select(*by, F.when(F.col("q") > 0, F.col("q")).otherwise(F.coalesce("least", F.lit(returns.LOG_FLOOR))).alias("floor"))
    out = out.withColumnRenamed("y", "target").join(cut, by, "left")
    resid = F.col("model").endswith("-resid")
    y = F.when(F.col("logged"), F.ln(F.greatest("target", "floor"))).when(resid, F.col("target") - F.col("h")).otherwise(F.col("target"))
    order = F.array_position(F.lit(names), F.col("model")) - 1
    return out.select(F.concat_ws("/", *by).alias("g"), F.col("t").alias("i"), "fit", "x", y.alias("y"), "model", order.cast("int").alias("model_ord"), "series", "block", "t", "target", "h", "logged")


def forecasts_of(forest: trees.Forest, rows: DataFrame, n_train: int, every: int, smear: bool = True) -> DataFrame:
    """evaluate_models()' columns from a booster's predictions of model_rows()."""
    pred = forest.rows.select("g", "i", F.col("pred"), F.col("y").alias("fitted"), F.col("fit").alias("was_fit"))
    factor = pred.where("was_fit").groupBy("g").agg(returns.smearing(F.col("fitted"), F.col("pred")).alias("factor"))
    out = rows.where("NOT fit").join(pred.where("NOT was_fit").select("g", "i", "pred"), ["g", "i"]).join(factor, "g")
    level = F.when(F.col("logged"), F.exp("pred") * (F.col("factor") if smear else F.lit(1.0))).otherwise(returns.recombined(F.coalesce(F.when(F.col("model").endswith("-resid"), F.col("h")), F.lit(0.0)), F.col("pred")))
    step = F.col("t") - n_train
    return out.select("series", "model", "model_ord", step.alias("step"), "t", level.alias("forecast"), F.col("target").alias("actual"), (step % every == 0).alias("is_refit"))


def evaluate(rows: DataFrame, n_train: int, every: int = 10, width: int | None = None, actual: str = "proxy", bases: Sequence[tuple] = (), parameters: dict | None = None, seed: int = 42, retransform: str = "smearing", **options) -> DataFrame:
    """One-step forecasts of the tree models over all test rows, as forecasting.evaluate_models() gives them.

    bases lists (specification, distribution) of the models that hybrids rest on, each in both modes; rows(series, t, ret, actual)."""
    if retransform not in ("smearing", "none"):
        raise ValueError(f"retransform must be 'smearing' or 'none', not {retransform!r}")
    own = trees.written(model_rows(rows, n_train, every, width, actual, bases, **options), "tree_rows")
    groups = trees.with_parameters(own.select("g").distinct(), parameters)
    forest = trees.Booster(own, groups, seed).run()
    return forecasts_of(forest, own, n_train, every, retransform == "smearing")


def repeated(forecasts: DataFrame, horizon: int) -> DataFrame:
    """The forecasts of `horizon` steps from each origin t, all alike, as trees give one value: a row for each step ahead, with the actual of the time t + ahead - 1 that it is for, null beyond the last row."""
    steps = forecasts.drop("actual").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return losses.at_their_time(steps, forecasts.select("series", "model", "t", "actual")).select(*forecasts.columns, "ahead")


# Tuning: candidates are rows, each with trees of its own.
# The space of candidates; the third value tells that a logarithm is uniform.
SPACE = {
    "n_estimators": (50, 500, False), "max_depth": (2, 7, False), "learning_rate": (0.01, 0.3, True), "subsample": (0.5, 1.0, False), "colsample_bytree": (0.5, 1.0, False),
    "min_child_weight": (1, 20, False), "reg_alpha": (1e-4, 10.0, True), "reg_lambda": (1e-4, 10.0, True),
}
WHOLE = ("n_estimators", "max_depth", "min_child_weight")


def candidates(n: int, seed: int = 42) -> list[dict]:
    """Random candidates of the space."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        one = {}
        for k, (low, high, log) in SPACE.items():
            if k in WHOLE:
                one[k] = int(rng.integers(low, high + 1))
            else:
                one[k] = float(np.exp(rng.uniform(np.log(low), np.log(high))) if log else rng.uniform(low, high))
        out.append(one)
    return out


def tune(rows: DataFrame, trials: Sequence[dict], rungs: Sequence[int] = (), keep: int = 3, share: float = 0.8, seed: int = 42) -> DataFrame:
    """g, trial, mse and the parameters of each group's best trial, for rows(g, i, x, y) that are all to be fitted.

    Trials are fitted to the first `share` of a group's rows in the order of i and judged by their squared error on the rest.
    After each rung, a number of trees, only every keep-th of a group's trials goes on, the best ones (ties to the smaller
    number); without rungs every trial grows all its trees. The winner is refitted by refit()."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, *(float(t.get(p, trees.DEFAULTS[p])) for p in trees.DEFAULTS)) for k, t in enumerate(trials)], "trial int, " + ", ".join(f"{p} double" for p in trees.DEFAULTS))
    by = Window.partitionBy("g")
    ranked = rows.select("g", "i", "x", "y", F.row_number().over(by.orderBy("i")).alias("place"), F.count("*").over(by).alias("n"))
    own = trees.written(ranked.select(F.col("g").alias("of"), "i", "x", "y", (F.col("place") <= F.floor(F.col("n") * share)).alias("fit")), "to_tune")
    named = F.concat_ws("#", "of", "trial")
    booster = trees.Booster(own.crossJoin(F.broadcast(table.select("trial"))).withColumn("g", named), own.select("of").distinct().crossJoin(F.broadcast(table)).withColumn("g", named), seed)

    def judged() -> DataFrame:
        error = booster.state.where("NOT fit").groupBy("g").agg(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2))).alias("mse"))
        split = error.select(F.regexp_extract("g", r"^(.*)#\d+$", 1).alias("of"), F.regexp_extract("g", r"#(\d+)$", 1).cast("int").alias("trial"), "g", "mse")
        return split.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("mse", "trial"))).withColumn("held", F.count("*").over(Window.partitionBy("of")))

    for rung in rungs:
        booster.run(rung)
        booster.keep(judged().where(F.col("place") <= F.ceil(F.col("held") / keep)).select("g"))
    booster.run()
    return judged().where("place = 1").select(F.col("of").alias("g"), "trial", "mse").join(F.broadcast(table), "trial")


def refit(rows: DataFrame, best: DataFrame, seed: int = 42) -> trees.Forest:
    """Trees of all of each group's rows by the parameters of tune()."""
    return trees.Booster(rows.select("g", "i", F.lit(True).alias("fit"), "x", "y"), best.select("g", *trees.DEFAULTS), seed).run()
