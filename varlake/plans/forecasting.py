"""Fits and rolling forecasts as grouped tasks over (series, model, refit block): blocks are refitted from scratch, so all run in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.special import normal_tail
from ..operators import losses
from ..operators.features import block_rows
from ..operators.scans import affine, scanned
from ..shipping import ship_package
from . import garch

BLOCKS = 4  # neighbouring refit blocks of a task
FITS = "series string, model string, model_type string, parameter string, coef double, std_err double, t_stat double, p_value double, loglik double, n long"


def model_name(spec: str, dist: str, order: int | None = None) -> str:
    return f"{spec}-{dist.upper()}" if order is None else f"{spec}-{dist.upper()}-o{order}"


def with_models(rows: DataFrame, specs: list[tuple]) -> DataFrame:
    """Each row once for each model of the list, which is the driver's own and short: (specification, distribution), and the asymmetric order where it isn't the specification's own."""
    for one in specs:
        garch.estimated(*one)
    each = [F.struct(F.lit(model_name(*m)).alias("model"), F.lit(i).alias("model_ord"), F.lit(m[0]).alias("spec"), F.lit(m[1]).alias("dist"), F.lit(m[2] if len(m) > 2 else None).cast("int").alias("o")) for i, m in enumerate(specs)]
    return rows.withColumn("m", F.explode(F.array(*each))).select(*rows.columns, "m.*")


def order_of(frame: pd.DataFrame) -> int | None:
    o = frame["o"].iloc[0]
    return None if pd.isna(o) else int(o)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys into a fixed number of partitions, four a core: fits take long over few bytes, which adaptive execution would put into one task."""
    return rows.repartition(4 * max(1, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def fit_table(rows: DataFrame, specs: list[tuple]) -> DataFrame:
    """A row for each series, model and parameter, with robust errors and the log-likelihood; rows(series, t, ret)."""
    ship_package(rows.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        spec, dist, order = f["spec"].iloc[0], f["dist"].iloc[0], order_of(f)
        own = garch.estimated(spec, dist, order)
        p, loglik = garch.fit(spec, dist, f["ret"].to_numpy(), order=order)
        err = garch.standard_errors(spec, dist, p, f["ret"].to_numpy(), order)
        p, parameters = p[own], [garch.names(spec, dist)[i] for i in own]
        t = p / err
        return pd.DataFrame({
            "series": f["series"].iloc[0], "model": f["model"].iloc[0], "model_type": spec, "parameter": parameters, "coef": p, "std_err": err,
            "t_stat": t, "p_value": [2 * normal_tail(abs(x)) for x in t], "loglik": loglik, "n": len(f),
        })

    return spread(with_models(rows.select("series", "t", "ret"), specs), "series", "model").groupBy("series", "model").applyInPandas(run, FITS)


def fitted_states(rows: DataFrame, specs: list[tuple]) -> DataFrame:
    """series, model, spec, p (parameters of returns in percent), t (the last one fitted), state, what the model's recursion carries into the next return, and past, the squares that FIGARCH carries (null for others); rows(series, t, ret)."""
    ship_package(rows.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        spec, dist, ret = f["spec"].iloc[0], f["dist"].iloc[0], f["ret"].to_numpy()
        p, _ = garch.fit(spec, dist, ret, order=order_of(f))
        (state,), past = carried(spec, p, ret, len(ret))
        return pd.DataFrame({"series": f["series"].iloc[:1], "model": f["model"].iloc[:1], "spec": spec, "p": [p.tolist()], "t": int(f["t"].iloc[-1]), "state": state, "past": past})

    return spread(with_models(rows.select("series", "t", "ret"), specs), "series", "model").groupBy("series", "model").applyInPandas(run, "series string, model string, spec string, p array<double>, t long, state double, past array<double>")


def carried(spec: str, p: np.ndarray, ret: np.ndarray, fitted: int) -> tuple[list[float], list]:
    """The states that the model's recursion carries into each return from `fitted` on and into the one after the last, and the squares that FIGARCH carries there (None for others)."""
    states = [garch.state_of(spec, p, h) for h in garch.one_step(spec, p, ret, fitted) * garch.SCALE**2]
    if spec != "FIGARCH":
        return states, [None] * len(states)
    e = (ret * garch.SCALE - p[0])[None]
    squares = np.concatenate([np.repeat(garch.backcast(e[:, :fitted]), garch.TRUNCATION), e[0] ** 2])
    return states, [squares[i : i + garch.TRUNCATION].tolist() for i in range(fitted, len(ret) + 1)]


def origin_states(rows: DataFrame, specs: list[tuple], n_train: int, every: int = 10, width: int | None = None) -> DataFrame:
    """fitted_states() before the return of each test row t, by parameters fitted to its block's window, with model_ord; the blocks go on to the end of each series."""
    ship_package(rows.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        spec, dist, ret, fitted = f["spec"].iloc[0], f["dist"].iloc[0], f["ret"].to_numpy(), int((f["t"] < f["fit_end"]).sum())
        p, _ = garch.fit(spec, dist, ret[:fitted], order=order_of(f))
        states, past = carried(spec, p, ret, fitted)
        test = f.iloc[fitted:]
        return pd.DataFrame({"series": test["series"], "model": test["model"], "model_ord": test["model_ord"], "spec": spec, "p": [p.tolist()] * len(test), "t": test["t"], "state": states[:-1], "past": past[:-1]})

    own = block_rows(rows.select("series", F.col("t").cast("long").alias("t"), "ret"), n_train, None, every, width)
    schema = "series string, model string, model_ord int, spec string, p array<double>, t long, state double, past array<double>"
    return spread(with_models(own, specs), "series", "model", "block").groupBy("series", "model", "block").applyInPandas(run, schema)


def evaluate_ahead(rows: DataFrame, specs: list[tuple], n_train: int, horizon: int, every: int = 10, width: int | None = None, actual: str = "proxy") -> DataFrame:
    """Forecasts of each step up to the horizon from each test row t: series, model, t, ahead, forecast and the actual of the time t + ahead - 1 that it is for, null beyond the last row. At the first step they are those of evaluate()."""
    steps = term_structure(origin_states(rows, specs, n_train, every, width), horizon, by=("series", "model", "t")).withColumnRenamed("h", "forecast")
    return losses.at_their_time(steps, rows.select("series", F.col("t").cast("long").alias("t"), F.col(actual).cast("double").alias("actual"))).select("series", "model", "t", "ahead", "forecast", "actual")


LINEAR = ("GARCH", "GJR-GARCH", "APARCH")  # the specifications whose recursion is linear in what it carries


def insample_variance(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """series, model, t and h: the variance of each return of the series by each fitted model, before the return is known.

    rows holds series, t and ret; fits is fit_table(), of which GARCH, GJR-GARCH and APARCH are read. All series and models are one prefix scan over maps of the returns."""
    keys = ["series", "model"]
    own = fits.where(F.col("model_type").isin(*LINEAR)).groupBy(*keys, "model_type").agg(F.map_from_entries(F.collect_list(F.struct("parameter", "coef"))).alias("p"))
    e = F.col("ret") * garch.SCALE - F.try_element_at("p", F.lit("mu"))
    joined = rows.select("series", F.col("t").cast("long").alias("t"), "ret").join(own, "series").withColumn("e", e)
    # The start: squares of the first rows, weighted by age.
    w = Window.partitionBy(*keys).orderBy("t")
    first = joined.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") < garch.BACKCAST)
    weight = F.pow(F.lit(garch.DECAY), F.col("i"))
    back = first.groupBy(*keys).agg((F.sum(weight * F.col("e") * F.col("e")) / F.sum(weight)).alias("back"))
    at = lambda name: F.coalesce(F.try_element_at("p", F.lit(name)), F.lit(0.0))
    power = F.when(F.col("model_type") == "APARCH", F.pow("back", at("delta") / 2)).otherwise(F.col("back"))
    half = F.when(F.col("model_type") == "GJR-GARCH", at("gamma[1]") / 2).otherwise(0.0)
    a, b = affine(F.col("model_type"), F.col("e"), F.col("p"))
    maps = joined.join(back, keys).select(*keys, "t", a.alias("a"), b.alias("b"), (at("omega") + (at("alpha[1]") + half + at("beta[1]")) * power).alias("start"))
    found = scanned(maps, keys).join(own, keys)
    h = F.when(F.col("model_type") == "APARCH", F.pow(F.greatest("h", F.lit(1e-12)), 2 / at("delta"))).otherwise(F.col("h"))
    return found.select(*keys, "t", (F.greatest(F.least(h, F.lit(1e12)), F.lit(1e-12)) / garch.SCALE**2).alias("h"))


class Kernel:
    """A model of garch by the protocol that evaluate_models() asks for."""

    def __init__(self, spec: str, dist: str, order: int | None = None):
        garch.estimated(spec, dist, order)
        self.spec, self.dist, self.order = spec, dist, order

    def fit(self, returns: np.ndarray, actual: np.ndarray) -> None:
        self.p, _ = garch.fit(self.spec, self.dist, returns, order=self.order)
        self.past, self.fitted = np.asarray(returns, float), len(returns)

    def update(self, returns: np.ndarray, actual: np.ndarray) -> None:
        self.past = np.concatenate([self.past, returns])

    def forecast_variance(self) -> float:
        return float(garch.one_step(self.spec, self.p, self.past, self.fitted)[-1])

    def path(self, returns: np.ndarray) -> np.ndarray:
        """The forecasts of all of returns, which update() would take one by one, in one pass."""
        return garch.one_step(self.spec, self.p, np.concatenate([self.past, returns]), self.fitted)[len(self.past) - self.fitted :][: len(returns)]


def evaluate(rows: DataFrame, specs: list[tuple], n_train: int, n_test: int | None, every: int = 10, width: int | None = None, actual: str = "proxy") -> DataFrame:
    """evaluate_models() of the models of garch."""
    return evaluate_models(rows, {model_name(*m): partial(Kernel, *m) for m in specs}, n_train, n_test, every, width, actual)


def evaluate_models(rows: DataFrame, models: dict[str, Callable], n_train: int, n_test: int | None, every: int = 10, width: int | None = None, actual: str = "proxy", n_ahead: int = 1) -> DataFrame:
    """One-step forecasts of all test rows: series, model, model_ord, step, t, forecast, actual, is_refit.

    models names functions without arguments that make a model with fit(returns, actual), update(returns, actual) and
    forecast_variance(); models with path(returns) give a block's forecasts at once. They go to the tasks pickled, so a module that defines them must be known there.
    The forecast of t only uses returns and actuals before t. A block's parameters come from its window's end; from there on its
    state alone advances. Without n_test, tests go on to the end of each series. A model without update() is a TypeError,
    a failing fit a RuntimeError that names the model and the step, and more than one step ahead a NotImplementedError."""
    if n_ahead != 1:
        raise NotImplementedError("only forecasts of one step ahead can be evaluated")
    if width is not None and width > n_train:
        raise ValueError(f"a window of {width} needs as many training rows; there are {n_train}")
    for name, make in models.items():
        if not callable(getattr(make(), "update", None)):
            raise TypeError(f"[{name}] has no update(), so its forecasts would stand still between refits")
    ship_package(rows.sparkSession)
    # A task takes BLOCKS neighbouring blocks, so a row goes to each task once and not to each block; every block is still fitted from scratch.
    size = every * BLOCKS
    chunks = block_rows(rows.select("series", "t", "ret", F.col(actual).cast("double").alias("actual")), n_train, n_test, size, width).drop("fit_end")
    each = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_ord")) for i, name in enumerate(models)))
    chunks = chunks.withColumn("m", F.explode(each)).select(*chunks.columns, "m.*")

    def one(f: pd.DataFrame, end: int) -> pd.DataFrame:
        name = f["model"].iloc[0]
        f = f[(f["t"] < end + every) & (f["t"] >= (end - width if width is not None else 0))]
        fitted = int((f["t"] < end).sum())
        ret, known = f["ret"].to_numpy(), f["actual"].to_numpy()
        model = models[name]()
        try:
            model.fit(ret[:fitted], known[:fitted])
        except Exception as error:
            raise RuntimeError(f"[{name}] fitting failed at test step {end - n_train}") from error
        if hasattr(model, "path"):
            made = model.path(ret[fitted:])
        else:
            made = []
            for i in range(fitted, len(ret)):
                made.append(float(model.forecast_variance()))
                model.update(ret[i : i + 1], known[i : i + 1])
        test = f.iloc[fitted:]
        step = test["t"].to_numpy() - n_train
        return pd.DataFrame({
            "series": test["series"], "model": name, "model_ord": test["model_ord"], "step": step, "t": test["t"], "forecast": np.asarray(made, float),
            "actual": test["actual"], "is_refit": step % every == 0,
        })

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t", ignore_index=True)
        first = n_train + int(f["block"].iloc[0]) * size
        return pd.concat([one(f, end) for end in range(first, min(first + size, int(f["t"].iloc[-1]) + 1), every)])

    schema = "series string, model string, model_ord int, step long, t long, forecast double, actual double, is_refit boolean"
    return spread(chunks, "series", "model", "block").groupBy("series", "model", "block").applyInPandas(run, schema)


def term_structure(states: DataFrame, horizon: int, replicates: int = 2000, seed: int = 42, by: Sequence[str] = ("series", "model")) -> DataFrame:
    """series, model, ahead and h: the variance that fitted_states() expects at each step up to the horizon, on the returns' own scale; `by` names what tells states apart.

    GARCH and GJR-GARCH have a closed form. For the others replicates are rows, dealt over tasks, which draw normal deviations and go on from the state; Spark averages them."""
    ship_package(states.sparkSession)
    p, k = F.col("p"), F.col("ahead")
    steps = states.where(F.col("spec").isin("GARCH", "GJR-GARCH")).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    persistence = F.when(F.col("spec") == "GARCH", p[2] + p[3]).otherwise(p[2] + p[3] / 2 + p[4])
    power = F.pow(persistence, k - 1)
    closed = power * F.col("state") + p[1] * F.when(persistence == 1, k - 1).otherwise((1 - power) / (1 - persistence))
    own = steps.select(*by, k, (closed / garch.SCALE**2).alias("h"))
    drawn = states.where(~F.col("spec").isin("GARCH", "GJR-GARCH")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                q, state = np.asarray(r.p, float), float(r.state)
                z = np.random.default_rng([seed, r.replicate]).standard_normal(horizon)
                past = None if r.past is None else list(r.past)
                weights = garch.long_memory(*(q[None, i] for i in (2, 3, 4)))[0] if r.spec == "FIGARCH" else None
                for step in range(horizon):
                    h = garch.variance_of(r.spec, q, state)
                    rows.append((*(getattr(r, c) for c in by), step + 1, h / garch.SCALE**2))
                    e = z[step] * np.sqrt(h)
                    if weights is None:
                        state = garch.advance(r.spec, q, state, q[0] + e)
                    else:
                        past = [*past[1:], e * e]
                        state = garch.remembered(q, np.array(past), weights)
            yield pd.DataFrame(rows, columns=[*by, "ahead", "h"])

    named = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in by)
    paths = spread(drawn.select(*by, "spec", "p", "state", "past", "replicate"), *by, "replicate").mapInPandas(run, f"{named}, ahead int, h double")
    return own.unionByName(paths.groupBy(*by, "ahead").agg(F.avg("h").alias("h")))
