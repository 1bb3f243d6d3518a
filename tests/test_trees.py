"""Boosted trees against a plain booster, tuning against exhaustive search, and the forecasters that rest on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlake import catalog
from varlake.operators import returns
from varlake.plans import forecasting, garch, tree_levels, tree_models, trees

from . import simulated

SIMPLE = {"subsample": 1.0, "colsample_bytree": 1.0}


def plain_boost(x, y, fit, trees_, depth, rate=0.05, least=5.0, alpha=0.1, reg=1.0):
    """Predictions of all rows and the (node, feature, threshold, gain) of each tree, by trying every threshold."""
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    score = lambda g, n: soft(g) ** 2 / (n + reg)
    pred, made = np.full(len(y), y[fit].mean()), []
    for _ in range(trees_):
        d, node, value, splits = pred - y, np.zeros(len(y), int), np.zeros(len(y)), []
        value[:] = -soft(d[fit].sum()) / (fit.sum() + reg)
        for level in range(depth):
            for k in [k for k in np.unique(node) if k >= 0]:
                own = node == k
                g, n = d[own & fit].sum(), (own & fit).sum()
                best = (0, 0, 0, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[own & fit, f])[:-1]:
                        left = own & fit & (x[:, f] <= cut)
                        gl, nl = d[left].sum(), left.sum()
                        if nl >= least and n - nl >= least:
                            gain = score(gl, nl) + score(g - gl, n - nl) - score(g, n)
                            if gain > 1e-6 and (gain, -f, -cut) > best[:3]:
                                best = (gain, -f, -cut, (gl, nl))
                if best[3] is None:
                    node[own] = -1
                    continue
                gain, f, cut = best[0], -best[1], -best[2]
                gl, nl = best[3]
                splits.append((k, f, round(gain, 6)))
                right = own & (x[:, f] > cut)
                value[own], node[own] = -soft(gl) / (nl + reg), 2 * k + 1
                value[right], node[right] = -soft(g - gl) / (n - nl + reg), 2 * k + 2
        pred = pred + rate * value
        made.append(splits)
    return pred, made


def grid_rows(rng, n):
    x = rng.integers(0, 9, (n, 3)) / 4
    return x, 2.0 * (x[:, 0] > 1) + x[:, 1] * (x[:, 0] <= 1) + rng.normal(0, 0.1, n)


def test_trees_are_those_of_a_plain_booster(spark):
    rng = np.random.default_rng(0)
    data, want = [], {}
    for g, n in (("a", 150), ("b", 90), ("c", 7)):
        x, y = grid_rows(rng, n)
        fit = np.arange(n) % 4 != 3
        want[g] = plain_boost(x, y, fit, 3, 3, 0.3)
        data += [(g, i, bool(fit[i]), x[i].tolist(), float(y[i])) for i in range(n)]
    rows = spark.createDataFrame(data, "g string, i long, fit boolean, x array<double>, y double").repartition(5)
    groups = trees.with_parameters(rows.select("g").distinct(), {**SIMPLE, "n_estimators": 3, "max_depth": 3, "learning_rate": 0.3})
    booster = trees.Booster(rows, groups)
    plan = booster.level(booster.state.selectExpr("*", "0 AS node", "true AS taken", "array(0, 1, 2) AS draw"), 0)._jdf.queryExecution().toString()
    assert "Aggregate" in plan and "Window" in plan and "Python" not in plan and "Pandas" not in plan
    forest = booster.run()
    got = {(r.g, r.i): r.pred for r in forest.rows.collect()}
    for g, (pred, _) in want.items():
        assert [got[g, i] for i in range(len(pred))] == pytest.approx(pred.tolist())
    splits = {(r.g, r.tree, r.node, r.f, round(r.gain, 6)) for r in forest.trees.where("f IS NOT NULL").collect()}
    assert splits == {(g, t, *s) for g, (_, made) in want.items() for t, own in enumerate(made) for s in own} and len(splits) > 20
    best = trees.importances(forest.trees).where("place = 1").collect()
    assert {(r.g, r.f) for r in best} == {("a", 0), ("b", 0)}
    total = trees.importances(forest.trees).groupBy("g").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in total)


def few_rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for g, n in (("a", 120), ("b", 60)):
        x, y = grid_rows(rng, n)
        data += [(g, i, i % 5 != 4, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "g string, i long, fit boolean, x array<double>, y double")


def test_plans_do_not_grow_with_the_trees(spark):
    rows = few_rows(spark)
    groups = trees.with_parameters(rows.select("g").distinct(), {"n_estimators": 3, "max_depth": 2})
    booster, sizes = trees.Booster(rows, groups), []
    for k in (1, 2, 3):
        kept = booster.run(k).rows
        sizes.append(len(kept._jdf.queryExecution().analyzed().toString().splitlines()))
    assert sizes[0] == sizes[1] == sizes[2] and kept.count() == 180
    # A walk of several levels has each condition once, not once for each way to it.
    tree = spark.createDataFrame([], "g string, nodes map<int, struct<f: int, bin: int, value: double, left: double, right: double>>")
    moved = booster.moved(booster.state.selectExpr("g", "y", "pred", "bins", "drawn", "true AS taken", "array(0, 1, 2) AS draw"), tree, 3)
    assert booster.level(moved, 3)._jdf.queryExecution().optimizedPlan().toString().count("try_element_at") <= 3


def test_splits_beyond_the_driver_make_the_same_trees(spark, monkeypatch):
    rows, found = few_rows(spark), []
    for small in (trees.SMALL, 2, 0):
        monkeypatch.setattr(trees, "SMALL", small)
        forest = trees.Booster(rows, rows.select("g").distinct().withColumn("n_estimators", F.when(F.col("g") == "a", 4).otherwise(2)), 7).run()
        found.append(({(r.g, r.i): r.pred for r in forest.rows.collect()}, {(r.g, r.tree, r.node, r.f, r.bin) for r in forest.trees.collect()}))
    assert len(found[0][0]) == 180 and {t for g, t, *_ in found[0][1] if g == "b"} == {0, 1}
    for pred, nodes in found[1:]:
        assert pred == pytest.approx(found[0][0]) and nodes == found[0][1]


def test_chunks_of_a_group_make_the_same_trees(spark, monkeypatch):
    """Rows that stay in memory: a group in one chunk or in many, features of several numbers, targets that are missing; against levels as queries."""
    rows = few_rows(spark)
    rows = rows.withColumn("x", F.when(F.col("g") == "a", F.slice("x", 1, 2)).otherwise(F.col("x"))).withColumn("y", F.when(F.col("i") == 10, None).otherwise(F.col("y")))
    groups, found = rows.select("g").distinct().withColumn("n_estimators", F.lit(12)).withColumn("max_depth", F.when(F.col("g") == "a", 1).otherwise(3)).withColumn("subsample", F.lit(0.6)), []
    for many, chunk in ((0, 4096), (4, 4096), (4, 7)):
        monkeypatch.setattr(trees, "MANY", many)
        monkeypatch.setattr(tree_levels, "CHUNK", chunk)
        forest = trees.Booster(rows, groups, 3).run()
        found.append(({(r.g, r.i): r.pred for r in forest.rows.collect()}, {(r.g, r.tree, r.node, r.f, r.bin, r.n) for r in forest.trees.where("f IS NOT NULL").collect()}))
    assert len(found[0][0]) == 180 and {t for _, t, *_ in found[0][1]} == set(range(12))
    for pred, nodes in found[1:]:
        assert pred == pytest.approx(found[0][0]) and nodes == found[0][1]


@pytest.mark.parametrize("many", [0, 4])
def test_ties_go_to_the_first_feature(spark, monkeypatch, many):
    """Features that part the same rows, mirrored: the sums' last digits don't choose between them."""
    monkeypatch.setattr(trees, "MANY", many)
    rng = np.random.default_rng(5)
    r, y = rng.integers(1, 40, 90) / 8, rng.normal(0, 1, 90) + np.pi
    rows = spark.createDataFrame([(g, i, True, [float(r[i] ** 2), float(-r[i])], float(y[i] * k)) for k, g in enumerate("abcdef", 1) for i in range(90)], "g string, i long, fit boolean, x array<double>, y double").repartition(7)
    forest = trees.Booster(rows, trees.with_parameters(rows.select("g").distinct(), {**SIMPLE, "n_estimators": 2, "max_depth": 3})).run()
    made = forest.trees.where("f IS NOT NULL").toPandas()
    assert len(made) > 20 and set(made["f"]) == {0}


def test_rows_are_drawn_by_the_same_hash(spark):
    rows = spark.range(-50, 50).selectExpr("id * 977777777777 AS i", "xxhash64(7, 3, 'g') AS seed", "xxhash64(7, 3, 'g', id * 977777777777) AS h").toPandas()
    with np.errstate(over="ignore"):
        got = tree_levels.hashed(rows["i"].to_numpy(), rows["seed"].to_numpy().astype(np.uint64))
    assert (got.astype(np.int64) == rows["h"].to_numpy()).all()


def test_the_tuning_query_tries_whole_candidates(spark, monkeypatch):
    """All of the reference's 50 trials, with the numbers of trees and depths that they draw, to the end."""
    given = []

    def stopped(rows, trials, rungs=(), *_, **__):
        given.extend([trials, rungs])
        raise Stop

    monkeypatch.setattr(tree_models, "tune", stopped)
    with pytest.raises(Stop):
        catalog.QUERIES["MDL12_tuning"](spark, "/root/testdata/sf0.001")
    trials, rungs = given
    assert len(trials) == 50 and not rungs
    for name, (low, high, _) in tree_models.SPACE.items():
        values = [t[name] for t in trials]
        assert low <= min(values) and max(values) <= high and max(values) - min(values) > (high - low) / 2


class Stop(Exception):
    pass


@pytest.mark.parametrize("key, place", [
    ("MDL10_MDL11_MDL13_tree_forecasts", (tree_models, "evaluate")), ("MDL20_MDL11_JOIN7_hybrids_ahead", (tree_models, "evaluate")), ("MDL12_tuning", (trees, "Booster")),
    ("MDL14_SRT7_importances", (trees, "Booster")), ("MDL21_to_23_evaluate", (forecasting, "evaluate")),
])
def test_events_are_read_once(spark, monkeypatch, key, place):
    """What is read again and again is a table of bars, returns or lags."""
    given = []

    def stopped(rows, *_, **__):
        given.extend(rows.inputFiles())
        raise Stop

    monkeypatch.setattr(*place, stopped)
    with pytest.raises(Stop):
        catalog.QUERIES[key](spark, "/root/testdata/sf0.001")
    assert given and not any("events.parquet" in f for f in given)


def test_unknown_parameters_are_an_error(spark):
    with pytest.raises(ValueError, match="unknown"):
        trees.with_parameters(spark.createDataFrame([("a",)], "g string"), {"depth": 3})


def test_tuning_equals_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    x, y = grid_rows(rng, 160)
    rows = spark.createDataFrame([("a", i, x[i].tolist(), float(y[i])) for i in range(160)], "g string, i long, x array<double>, y double")
    trials = [{**SIMPLE, "n_estimators": n, "max_depth": d, "learning_rate": r} for n, d, r in ((2, 1, 0.1), (4, 2, 0.3), (4, 1, 0.3), (3, 2, 0.05))]
    fit = np.arange(160) < 128
    error = [float(((plain_boost(x, y, fit, t["n_estimators"], t["max_depth"], t["learning_rate"])[0] - y)[~fit] ** 2).mean()) for t in trials]
    for rungs in ((), (2,)):
        best = tree_models.tune(rows, trials, rungs, 2).first()
        assert best.trial == int(np.argmin(error)) and best.mse == pytest.approx(min(error))
    forest = tree_models.refit(rows, tree_models.tune(rows, trials[:1]))
    pred = plain_boost(x, y, np.ones(160, bool), 2, 1, 0.1)[0]
    assert [r.pred for r in forest.rows.orderBy("i").collect()] == pytest.approx(pred.tolist())
    found = tree_models.candidates(50)
    assert len(found) == 50 and all(50 <= c["n_estimators"] <= 500 and 1e-4 <= c["reg_alpha"] <= 10 for c in found)


@pytest.fixture(scope="module")
def rows(spark):
    return simulated.synthetic_returns(spark, [0]).where("t < 260").cache()


@pytest.mark.parametrize("width", [None, 150])
def test_hybrids_see_the_path_of_their_base(spark, rows, width):
    """Every value that the booster is given, put together by hand."""
    got = tree_models.model_rows(rows, 200, 30, width, "proxy", [("GARCH", "normal")]).collect()
    local = rows.orderBy("t").toPandas()
    r, proxy = local["ret"].to_numpy(), local["proxy"].to_numpy()
    assert {x.model for x in got} == {"XGB-Standalone", "XGB-GARCH-NORMAL-feat", "XGB-GARCH-NORMAL-resid"}
    for block in (0, 1):
        end = 200 + 30 * block
        start = 0 if width is None else end - width
        p, _ = garch.fit("GARCH", "normal", r[start:end])
        h = garch.variances("GARCH", p[None], r[start:] * garch.SCALE, end - start)[0] / garch.SCALE**2
        floor = np.quantile(proxy[start + 6 : end], 0.01)
        for model in ("XGB-Standalone", "XGB-GARCH-NORMAL-feat", "XGB-GARCH-NORMAL-resid"):
            own = {x.t: x for x in got if x.model == model and x.block == block}
            assert sorted(t for t, x in own.items() if x.fit) == list(range(start + 6, end)) and sorted(t for t, x in own.items() if not x.fit) == list(range(end, min(end + 30, 260)))
            for t in (start + 6, end - 1, end, end + 20):
                lags = [*(r[t - 5 : t][::-1] ** 2), *r[t - 5 : t][::-1]]
                assert own[t].x == pytest.approx(lags + ([] if model == "XGB-Standalone" else [h[t - start]]))
                y = proxy[t] - h[t - start] if model.endswith("resid") else math.log(max(proxy[t], floor))
                assert own[t].y == pytest.approx(y)


def test_tree_forecasts(spark, rows):
    out = tree_models.evaluate(rows, 200, 30, None, "proxy", [("GARCH", "normal")], {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3})
    got = out.toPandas()
    assert len(got) == 180 and (got["forecast"] > 0).all() and got.groupby("model")["forecast"].nunique().min() > 5
    assert set(got[got.is_refit]["t"]) == {200, 230} and set(got["model_ord"]) == {0, 1, 2}
    assert out.columns == ["series", "model", "model_ord", "step", "t", "forecast", "actual", "is_refit"]
    h = forecasting.evaluate(rows, [("GARCH", "normal")], 200, None, 30).toPandas().set_index("t")["forecast"]
    resid = got[got.model.str.endswith("resid")].set_index("t")["forecast"]
    assert np.corrcoef(np.log(resid), np.log(h.loc[resid.index]))[0, 1] > 0.5
    ahead = tree_models.repeated(out, 3)
    assert ahead.count() == 540 and ahead.groupBy("model", "t").agg(F.count_distinct("forecast").alias("n")).where("n > 1").count() == 0


def test_steps_ahead_are_scored_at_their_own_time(spark, rows, monkeypatch):
    """Each step's metrics are those of its own actuals, for the hybrids and for their base, whose variance differs by step."""
    local = rows.orderBy("t").toPandas()
    r, proxy = local["ret"].to_numpy(), local["proxy"].to_numpy()
    made = rows.where("t >= 200").selectExpr("series", "'XGB-GARCH-NORMAL-feat' AS model", "0 AS model_ord", "cast(t - 200 AS long) AS step", "cast(t AS long) AS t", "abs(ret) AS forecast", "proxy AS actual", "false AS is_refit")
    ahead = tree_models.repeated(made, 3)
    assert ahead.columns == [*made.columns, "ahead"]
    for x in ahead.collect():
        assert x.forecast == abs(r[x.t]) and x.actual == (proxy[x.t + x.ahead - 1] if x.t + x.ahead <= 260 else None)
    base = {(x.t, x.ahead): x for x in forecasting.evaluate_ahead(rows, [("GARCH", "normal")], 200, 3, 30).collect()}
    assert set(base) == {(t, k) for t in range(200, 260) for k in (1, 2, 3)}
    for end in (200, 230):
        p, _ = garch.fit("GARCH", "normal", r[:end])
        h = garch.variances("GARCH", p[None], r * garch.SCALE, end)[0]
        for t in range(end, end + 30):
            v = h[t]
            for k in (1, 2, 3):
                assert base[t, k].forecast == pytest.approx(v / garch.SCALE**2) and base[t, k].actual == (proxy[t + k - 1] if t + k <= 260 else None)
                v = p[1] + (p[2] + p[3]) * v
    own = rows.withColumnRenamed("proxy", "garman_klass")
    monkeypatch.setattr(catalog, "rets", lambda *_: own)
    monkeypatch.setattr(tree_models, "evaluate", lambda *_, **__: made)
    monkeypatch.setattr(forecasting, "evaluate_ahead", lambda *_, **__: spark.createDataFrame(list(base.values())).withColumn("model", F.lit("GARCH-NORMAL")))
    got = {x.ahead: x for x in catalog.QUERIES["MDL20_MDL11_JOIN7_hybrids_ahead"](spark, "").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k in got:
        f, a = np.abs(r[200 : 261 - k]), proxy[199 + k : 260]
        assert got[k].rmse == pytest.approx(float(np.sqrt(((f - a) ** 2).mean()))) and got[k].mae == pytest.approx(float(np.abs(f - a).mean()))
        if k <= 3:
            v = np.array([base[t, k].forecast for t in range(200, 261 - k)])
            assert got[k].base_rmse == pytest.approx(float(np.sqrt(((v - a) ** 2).mean())))
    assert len({round(x.rmse, 12) for x in got.values()}) == 5 and got[5].base_rmse is None


def test_states_of_other_models_before_each_row(spark, rows):
    """At one step the forecasts are those of the evaluator, for every specification."""
    specs = [("EGARCH", "normal"), ("APARCH", "normal"), ("FIGARCH", "normal")]
    one = {(x.model, x.t): x.forecast for x in forecasting.evaluate(rows.where("t < 204"), specs, 200, None, 30).collect()}
    states = forecasting.origin_states(rows.where("t < 204"), specs, 200, 30)
    got = {(x.model, x.t): x.h for x in forecasting.term_structure(states, 1, 2, by=("series", "model", "t")).collect()}
    assert set(got) == set(one) and len(got) == 12 and all(got[k] == pytest.approx(one[k]) for k in got)


def test_bad_options_are_errors(rows):
    with pytest.raises(ValueError, match="mode"):
        tree_models.hybrid_name("GARCH-T", "both")
    with pytest.raises(ValueError, match="retransform"):
        tree_models.evaluate(rows, 200, retransform="half")
    with pytest.raises(ValueError, match="training rows"):
        tree_models.model_rows(rows, 7)
    with pytest.raises(Exception, match="not finite"):
        returns.resolved_target(rows.withColumn("proxy", F.when(F.col("t") == 5, float("inf")).otherwise(F.col("proxy"))), "proxy").collect()
