"""Behaviour of the variance models, the rolling evaluation and the tests on simulated data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlake.functions import special
from varlake import catalog
from varlake.operators import confidence, features, losses, normality, resampling, returns
from varlake.plans import forecasting, garch

from varlake.streaming import live_bars, live_variance

from . import simulated


@pytest.fixture(scope="module")
def rows(spark):
    return simulated.synthetic_returns(spark, [0]).cache()


def test_parameters_recovered():
    rng = np.random.default_rng(1)
    r, h = np.empty(4000), 1.0
    for t in range(4000):
        r[t] = np.sqrt(h) * rng.standard_normal() / 100
        h = 0.05 + 0.1 * (100 * r[t]) ** 2 + 0.85 * h
    p, _ = garch.fit("GARCH", "normal", r)
    assert abs(p[2] - 0.1) < 0.04 and abs(p[3] - 0.85) < 0.06


def test_batched_filter_equals_recursion():
    rng = np.random.default_rng(2)
    r = rng.standard_normal(50)
    p = np.array([[0.0, 0.1, 0.05, 0.9], [0.1, 0.2, 0.1, 0.7]])
    got = garch.variances("GARCH", p, r, 50)
    for row, (mu, w, a, b) in zip(got, p):
        e = r - mu
        h = w + (a + b) * garch.backcast(e[None])[0]
        for t in range(50):
            assert row[t] == pytest.approx(h, rel=1e-12)
            h = w + a * e[t] ** 2 + b * h


@pytest.mark.parametrize("spec", garch.SPECS)
@pytest.mark.parametrize("dist", garch.DISTS)
def test_all_specifications_fit(spec, dist):
    r = np.random.default_rng(3).standard_normal(400) / 100
    p, loglik = garch.fit(spec, dist, r, rounds=8)
    assert np.isfinite(loglik) and len(p) == len(garch.names(spec, dist))
    assert (garch.one_step(spec, p, r, 380) > 0).all()


@pytest.mark.parametrize("width", [None, 400])
def test_forecasts_move_every_day_and_refit_on_schedule(rows, width):
    out = forecasting.evaluate(rows, [("GARCH", "normal")], 700, 45, 10, width).toPandas().sort_values("step")
    assert len(out) == 45 == out["forecast"].nunique() and (out["forecast"] > 0).all()
    assert out["is_refit"].sum() == 5


def test_forecast_on_refit_day_is_plain_fit_then_forecast(rows):
    out = forecasting.evaluate(rows, [("GARCH", "normal")], 700, 12, 10).toPandas().set_index("step")["forecast"]
    r = rows.orderBy("t").toPandas()["ret"].to_numpy()
    p, _ = garch.fit("GARCH", "normal", r[:710])
    assert out[10] == pytest.approx(garch.one_step("GARCH", p, r[:710], 710)[0], rel=1e-10)


def test_a_second_series_changes_nothing(spark, rows):
    one = forecasting.evaluate(rows, [("GARCH", "normal")], 700, 12, 10).toPandas()
    both = forecasting.evaluate(simulated.synthetic_returns(spark, [0, 5]), [("GARCH", "normal")], 700, 12, 10).where("series = '0'").toPandas()
    assert sorted(one["forecast"]) == sorted(both["forecast"])


def test_unknown_names_fail():
    with pytest.raises(ValueError):
        garch.fit("NOPE", "normal", np.zeros(10))
    with pytest.raises(ValueError):
        garch.fit("GARCH", "nope", np.zeros(10))
    with pytest.raises(ValueError):
        losses.loss("nope", None, None)


def test_garman_klass_can_be_zero_or_negative(spark):
    f = spark.createDataFrame([(50.0, 50.0, 50.0, 50.0), (50.0, 50.2, 50.1, 49.0)], "open double, high double, low double, close double")
    a, b = [r[0] for r in f.select(returns.garman_klass(*map(F.col, ("open", "high", "low", "close")))).collect()]
    assert a == 0 and b < 0


def test_qlike_follows_ieee_arithmetic(spark):
    f = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0), (-1.0, 1.0), (1.0, 2.0)], "f double, a double")
    got = [r[0] for r in f.select(losses.qlike(F.col("f"), F.col("a"))).collect()]
    assert np.isnan(got[0]) and got[1] == -np.inf and np.isnan(got[2]) and got[3] == 2.0


def test_tails_against_tables():
    assert special.t_tail(2.042, 30) == pytest.approx(0.025, abs=1e-4)
    assert special.t_tail(12.706, 1) == pytest.approx(0.025, abs=1e-5)
    assert special.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.gamma_tail(5, 18.307 / 2) == pytest.approx(0.05, abs=1e-5)


def test_bad_model_leaves_the_confidence_set(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((300, 1)) ** 2
    matrix = np.concatenate([good, good + 0.01 * rng.standard_normal((300, 1)), good + 1 + rng.random((300, 1))], axis=1)
    rows = [("a", f"m{j}", j, i, float(matrix[i, j])) for i in range(300) for j in range(3)] + [("a", "m0", 0, 300, 9.0), ("b", "m0", 0, 0, 1.0)]
    losses_ = spark.createDataFrame(rows, "series string, model string, model_ord int, t int, loss double")
    out = {(r.series, r.model): r for r in confidence.confidence_set(losses_, replicates=200).collect()}
    assert out["a", "m2"].eliminated == 1 and not out["a", "m2"].in_set and out["a", "m0"].in_set and out["a", "m0"].early_stop and out["b", "m0"].pval == 1
    graded = sorted((r.eliminated, r.pval) for r in confidence.confidence_set(losses_.where("series = 'a'"), replicates=200, to_the_end=True).collect() if r.eliminated)
    assert len(graded) == 2 and graded[0][1] <= graded[1][1]


def test_resampled_means_are_those_of_the_places(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(50)
    frame = spark.createDataFrame([("a", 0, i, float(v), 50) for i, v in enumerate(x)], "series string, key int, i long, v double, n long")
    got = {r.replicate: r["mean"] for r in resampling.resampled_means(frame, 40, "4", 7).collect()}
    assert got == pytest.approx({i: x[resampling.places(50, 4.0, [7, i])].mean() for i in range(40)})
    sizes = np.concatenate([resampling.blocks(5000, 4.0, [i])[1] for i in range(20)])
    assert sizes.mean() == pytest.approx(4, rel=0.05) and all(len(resampling.places(n, 3.0, [n])) == n for n in range(1, 30))


def test_stream_appends_closed_windows_and_drops_late_ticks(spark, tmp_path):
    def write(name, rows):
        frame = spark.createDataFrame([(i, t, v) for i, t, v in rows], "event_id long, ts string, value double").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        ticks = spark.readStream.schema("event_id long, ts timestamp, value double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return sorted((r.ts.hour, r.open, r.high, r.low, r.close) for r in live_bars.appended(spark, ticks, str(tmp_path / "out"), str(tmp_path / "state")).collect())

    write("1", [(1, "2024-01-01 01:10:00", 5.0), (2, "2024-01-01 01:50:00", 7.0), (3, "2024-01-01 04:30:00", 3.0), (4, "2024-01-01 02:00:00", -1.0)])
    assert run() == [(1, 5.0, 7.0, 5.0, 7.0)]
    write("2", [(5, "2024-01-01 01:20:00", 99.0), (6, "2024-01-01 04:10:00", 4.0), (7, "2024-01-01 09:00:00", 1.0)])
    assert run() == [(1, 5.0, 7.0, 5.0, 7.0), (4, 4.0, 4.0, 3.0, 3.0)]


def test_short_series_can_be_an_error(spark):
    f = spark.createDataFrame([("a", i, float(i)) for i in range(40)] + [("b", 0, 1.0)], "series string, t int, v double")
    assert normality.clean(f, "v").count() == 40
    with pytest.raises(Exception, match="fewer than 30"):
        normality.clean(f, "v", short="raise").collect()


def test_report_has_all_tests_of_each_series(spark):
    rng = np.random.default_rng(3)
    f = spark.createDataFrame([(s, i, float(v)) for s, x in (("normal", rng.standard_normal(400)), ("skewed", rng.exponential(size=400))) for i, v in enumerate(x)], "series string, t int, x double")
    out = {(r.series, r.test): r for r in normality.report(f, 200).collect()}
    assert len(out) == 14 and all(out["normal", t].p_value > 0.01 and out["skewed", t].p_value < 0.05 for t in ("Jarque-Bera", "Bai-Ng joint (HAC)", "KS vs Normal", "KS vs Normal (block-bootstrap)"))
    assert out["skewed", "Anderson-Darling"].p_value is None and out["skewed", "Anderson-Darling"].statistic > 0.75


def test_merging_refuses_repeated_models(spark):
    f = spark.createDataFrame([("a",)], "model string")
    with pytest.raises(RuntimeError):
        losses.merged(f, f)


@pytest.mark.parametrize("width", [None, 4])
def test_blocks_end_at_the_last_row_of_each_series(spark, width):
    f = spark.createDataFrame([(s, t) for s, n in (("a", 27), ("b", 6), ("c", 13), ("d", 16)) for t in range(n)], "series string, t long")
    out = features.block_rows(f, 6, None, 5, width).where("t >= fit_end").groupBy("series").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max("block").alias("b"))
    assert sorted(map(tuple, out.collect())) == [("a", 21, 26, 4), ("c", 7, 12, 1), ("d", 10, 15, 1)]
    last = features.series_blocks(f, 6, 5, width).groupBy("series").agg(F.max("block"), F.max("last_step"))
    assert sorted(map(tuple, last.collect())) == [("a", 4, 20), ("c", 1, 6), ("d", 1, 9)]


def test_whole_block_queries_cover_all_bars(spark):
    folder = "/root/testdata/sf0.001"
    bars_ = catalog.rets(spark, folder).count()
    assert catalog.QUERIES["WIN6_7_block_windows_whole"](spark, folder).agg(F.sum("n_steps")).first()[0] == bars_ - 200
    assert catalog.QUERIES["WIN7_8_refit_blocks_whole"](spark, folder).agg(F.max("last_step")).first()[0] == bars_ - 201


def test_fits_cover_all_models_and_series_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    counts = {r.series: r["count"] for r in catalog.typed_rets(spark, folder).groupBy("series").count().collect()}
    out = catalog.QUERIES["MDL3_MDL9_garch_fits"](spark, folder).groupBy("series", "model").agg(F.max("n").alias("n"), F.max("loglik").alias("loglik")).collect()
    assert len(counts) > 1 and {(r.series, r.model, r.n) for r in out} == {(s, forecasting.model_name(*m), n) for s, n in counts.items() for m in catalog.ALL_MODELS}
    assert len(out) == 15 * len(counts) and all(np.isfinite(r.loglik) for r in out)


def test_bootstrap_draws_all_replicates(spark):
    out = catalog.QUERIES["TST11_ks_bootstrap"](spark, "/root/testdata/sf0.001").first()
    assert out.replicates == 2000 and out.p_boot * 2001 == pytest.approx(round(out.p_boot * 2001), abs=1e-9) and out.p_boot > 0


def test_moment_tests_take_their_lags_from_each_length(spark):
    folder = "/root/testdata/sf0.01"
    got, x = catalog.QUERIES["TST10_moment_pvalues"](spark, folder).first(), catalog.values(spark, folder)
    assert normality.plug_in_lags(got.n) == 6 and got.stat_skew == pytest.approx(normality.moment_tests(x, 6).first().stat_skew, rel=1e-9)
    two = normality.moment_tests(x.unionByName(x.where("t < 531").withColumn("series", F.lit("short")))).where("series = 'short'").first()
    assert two.stat_kurt == pytest.approx(normality.moment_tests(x.where("t < 531"), 5).first().stat_kurt, rel=1e-9)


def test_long_memory_weights_are_those_of_the_recursion():
    rng = np.random.default_rng(5)
    phi, d, beta = rng.uniform(0, 0.4, 6), rng.uniform(0, 1, 6), rng.uniform(0, 0.98, 6)
    for got, f, x, b in zip(garch.long_memory(phi, d, beta), phi, d, beta):
        delta, weight = x, f - b + x
        for k in range(garch.TRUNCATION):
            assert got[k] == pytest.approx(weight, abs=1e-12)
            new = delta * (k + 1 - x) / (k + 2)
            weight, delta = b * weight + new - f * delta, new


def test_streamed_variances_are_those_of_the_whole_series(spark, rows):
    specs = [(s, "t") for s in garch.SPECS if s != "FIGARCH"]
    train = rows.where("t < 700")
    states = forecasting.fitted_states(train, specs).cache()
    out = live_variance.replayed(rows.where("t >= 700"), states, parts=3).toPandas()
    ret = rows.orderBy("t").toPandas()["ret"].to_numpy()
    assert len(out) == 200 * 4 and not out["late"].any()
    for r in states.collect():
        mine = out[out["model"] == r["model"]].sort_values("t")
        want = garch.one_step(r["spec"], np.array(r["p"]), ret, 700)
        np.testing.assert_allclose(mine["h"].to_numpy(float), want[:200], rtol=1e-9)
        np.testing.assert_allclose(mine["next_h"].to_numpy(float), want[1:], rtol=1e-9)


def test_late_and_unknown_returns_leave_the_streamed_state_alone(spark, tmp_path):
    given = ["'a' AS series", "'G' AS model", "'GARCH' AS spec", "array(0.0D, 0.1D, 0.05D, 0.9D) AS p", "1.0D AS state", "0L AS t"]
    states, table = spark.range(1).selectExpr(*given), str(tmp_path / "in")

    def arrive(values):
        spark.createDataFrame(values, "series string, t long, ret double").write.mode("append").parquet(table)
        live_variance.appended(spark.readStream.schema("series string, t long, ret double").parquet(table), states, str(tmp_path / "out"), str(tmp_path / "state"))

    arrive([("a", 2, 0.02), ("a", 1, 0.01), ("other", 1, 0.01)])
    arrive([("a", 2, 0.5), ("a", 1, 0.5), ("a", 3, None), ("a", 4, float("nan")), ("a", 5, 0.0)])
    out = sorted((r["t"], r["late"], r["h"], r["next_h"]) for r in spark.read.parquet(str(tmp_path / "out")).where("NOT late AND h IS NOT NULL").collect())
    h1 = 0.1 + 0.05 + 0.9
    h2 = 0.1 + 0.05 * 4 + 0.9 * h1
    want = [(1, False, 1.0, h1), (2, False, h1, h2), (5, False, h2, 0.1 + 0.9 * h2)]
    assert [x[:2] for x in out] == [x[:2] for x in want]
    np.testing.assert_allclose([x[2:] for x in out], [(a * 1e-4, b * 1e-4) for *_, a, b in want], rtol=1e-9)
    rest = spark.read.parquet(str(tmp_path / "out")).where("late OR h IS NULL").groupBy("late").count().collect()
    assert sorted((r["late"], r["count"]) for r in rest) == [(False, 2), (True, 2)]


class Mean:
    """A model of one's own: the mean of the squared returns so far."""

    def fit(self, returns, actual):
        self.n, self.sum = len(returns), float((returns**2).sum())

    def update(self, returns, actual):
        self.n, self.sum = self.n + len(returns), self.sum + float((returns**2).sum())

    def forecast_variance(self):
        return self.sum / self.n


class Still:
    fit = forecast_variance = lambda self, *_: 1.0


class Broken(Mean):
    def fit(self, returns, actual):
        raise ValueError("no")


def test_models_of_ones_own_are_evaluated(spark):
    both = simulated.synthetic_returns(spark, [1, 2], 130, 100).cache()
    ret = {s: g.sort_values("t")["ret"].to_numpy() for s, g in both.toPandas().groupby("series")}
    out = forecasting.evaluate_models(both, {"mean": Mean, "again": Mean}, 100, None, 7).toPandas()
    assert len(out) == 2 * 2 * 30 and out["is_refit"].sum() == 2 * 2 * 5
    for s, t, f in zip(out["series"], out["t"], out["forecast"]):
        assert f == pytest.approx((ret[s][:t] ** 2).mean(), rel=1e-9)


def test_the_evaluator_refuses_what_it_cannot_do(spark):
    one = simulated.synthetic_returns(spark, [1], 110, 100)
    with pytest.raises(TypeError, match="Still"):
        forecasting.evaluate_models(one, {"Still": Still}, 100, 10)
    with pytest.raises(NotImplementedError):
        forecasting.evaluate_models(one, {"mean": Mean}, 100, 10, n_ahead=2)
    with pytest.raises(Exception, match=r"\[Broken\] fitting failed at test step 0"):
        forecasting.evaluate_models(one, {"Broken": Broken}, 100, 10).collect()
    assert [len(r.past) for r in forecasting.fitted_states(one, [("FIGARCH", "t")]).collect()] == [garch.TRUNCATION]


@pytest.mark.parametrize("spec", garch.ORDERED)
def test_order_zero_leaves_the_asymmetric_term_out(spark, rows, spec):
    got = forecasting.fit_table(rows.where("t < 300"), [(spec, "t", 0), (spec, "t")]).toPandas()
    plain, whole = (got[got["model"] == forecasting.model_name(spec, "t", *o)] for o in ((0,), ()))
    assert set(whole["parameter"]) - set(plain["parameter"]) == {"gamma[1]"}
    assert plain["loglik"].iloc[0] <= whole["loglik"].iloc[0] + 0.05
    ret = rows.where("t < 300").orderBy("t").toPandas()["ret"].to_numpy()
    p, _ = garch.fit(spec, "t", ret, order=0)
    flipped, _ = garch.fit(spec, "t", -ret, order=0)
    assert p[3] == 0 and garch.one_step(spec, p, ret, 300) == pytest.approx(garch.one_step(spec, flipped, -ret, 300), rel=1e-2)


def test_orders_that_do_not_exist_are_refused():
    for spec, order in (("GARCH", 0), ("GJR-GARCH", 0), ("FIGARCH", 1), ("EGARCH", 2)):
        with pytest.raises(ValueError, match=spec):
            garch.estimated(spec, "t", order)


def test_scan_is_a_fold_of_any_length(spark):
    from varlake.operators import scans

    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 2), ("c", 64), ("d", 65), ("e", 700), ("f", 27)):
        h = start = float(rng.normal())
        for t in range(n):
            a, b = float(rng.normal(0, 0.7)), float(rng.normal())
            rows.append((key, 3 * t, a, b, start))
            want[key, 3 * t] = h
            h = a * h + b
    frame = spark.createDataFrame(rows, "k string, t long, a double, b double, start double").repartition(4)
    for chunk in (3, 64):
        got = {(r.k, r.t): r.h for r in scans.scanned(frame, ["k"], chunk).collect()}
        assert got == pytest.approx(want) and len(got) == len(rows)
    assert scans.scanned(frame.limit(0), ["k"]).count() == 0


def test_insample_variances_are_those_of_the_fits(spark, rows):
    specs = [("GARCH", "normal"), ("GJR-GARCH", "t"), ("APARCH", "normal"), ("EGARCH", "normal")]
    fits = forecasting.fit_table(rows, specs).cache()
    got = forecasting.insample_variance(rows, fits).toPandas()
    r = rows.orderBy("t").toPandas()["ret"].to_numpy()
    assert set(got["model"]) == {"GARCH-NORMAL", "GJR-GARCH-T", "APARCH-NORMAL"}
    for spec, dist in specs[:3]:
        p, _ = garch.fit(spec, dist, r)
        want = garch.variances(spec, p[None], r * garch.SCALE, len(r))[0, :-1] / garch.SCALE**2
        assert got[got.model == forecasting.model_name(spec, dist)].sort_values("t")["h"].to_numpy() == pytest.approx(want)


def test_lags_fit_each_series(spark):
    """Series of 31 and 700 rows in one call: valid lags only, one lag where none is valid, and fewer ARCH lags for the short one."""
    rng = np.random.default_rng(2)
    series = {"short": rng.normal(size=31), "long": rng.normal(size=700)}
    f = spark.createDataFrame([(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "series string, t int, x double")
    got = {(r.series, r.test, r.lag): r.statistic for r in normality.dependence(f, (20, 40), 20).collect()}
    assert {k[2] for k in got if k[0] == "short" and k[1] == "Ljung-Box r"} == {20} and {k[2] for k in got if k[0] == "long" and k[1] == "Ljung-Box r"} == {20, 40}
    assert ("short", "ARCH-LM", 10) in got and ("long", "ARCH-LM", 20) in got
    assert {r.lag for r in normality.ljung_box(f, (5000,)).collect()} == {10}
    for s, k in (("short", 10), ("long", 20)):
        v = series[s] ** 2
        x = np.column_stack([np.ones(len(v) - k)] + [v[k - j : len(v) - j] for j in range(1, k + 1)])
        y = v[k:]
        fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[s, "ARCH-LM", k] == pytest.approx(len(y) * (1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()), rel=1e-6)


def test_equations_and_unfitted_models(spark):
    from varlake.operators import reporting

    rows = [("GARCH-T", "GARCH", p, c) for p, c in (("mu", 0.05), ("omega", 0.02), ("alpha[1]", 0.08), ("beta[1]", 0.9), ("nu", 6.5))] + [("EGARCH-NORMAL-o0", "EGARCH", p, c) for p, c in (("mu", -0.1), ("omega", 0.0), ("alpha[1]", 0.2), ("beta[1]", 0.97))]
    rows += [("APARCH-GED", "APARCH", p, c) for p, c in (("mu", 0.0), ("omega", 0.1), ("alpha[1]", 0.1), ("gamma[1]", 0.3), ("beta[1]", 0.8), ("delta", 1.5))] + [("GJR-GARCH-T", "GJR-GARCH", "mu", None), ("GJR-GARCH-T", "GJR-GARCH", "omega", float("nan"))]
    got = {r.model: r.lines for r in reporting.equations(spark.createDataFrame(rows, "model string, model_type string, parameter string, coef double")).collect()}
    assert set(got) == {"GARCH-T", "EGARCH-NORMAL-o0", "APARCH-GED"}
    assert got["GARCH-T"] == [r"\textbf{GARCH-T}", r"r_t = 0.0500 + \varepsilon_t, \qquad \varepsilon_t = \sigma_t z_t, \qquad z_t \sim t_{\nu}", r"\sigma_t^2 = 0.0200 + 0.0800\,\varepsilon_{t-1}^2 + 0.9000\,\sigma_{t-1}^2", r"\nu = 6.5000"]
    assert got["EGARCH-NORMAL-o0"][2] == r"\ln \sigma_t^2 = 0.0000 + 0.2000\left(|z_{t-1}| - \mathbb{E}|z_{t-1}|\right) + 0.9700\,\ln \sigma_{t-1}^2" and r"\mathcal{N}(0,1)" in got["EGARCH-NORMAL-o0"][1]
    assert got["APARCH-GED"][2] == r"\sigma_t^{1.5000} = 0.1000 + 0.1000\,\left(|\varepsilon_{t-1}| - 0.3000\,\varepsilon_{t-1}\right)^{1.5000} + 0.8000\,\sigma_{t-1}^{1.5000}"


def test_exact_quantiles_at_any_size(spark):
    """Brackets of few values, heavy ties, extreme doubles and small groups; no bracket may hold more than a few values at the end."""
    from varlake.operators import quantiles

    rng = np.random.default_rng(8)
    groups = {"normal": rng.normal(size=5000), "ties": np.repeat([1.0, 2.0, 2.0, 3.0], 1000), "tails": np.exp(rng.normal(0, 30, 3000)), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "huge": np.array([-1.7e308, 0.0, 1.7e308] * 50)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("normal", None), ("normal", float("nan"))]
    frame = spark.createDataFrame(rows, "series string, v double").repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)
    for few, bins in ((20, 7), (20, 1024), (10_000, 1024)):
        got = {r.series: r.q for r in quantiles.exact_quantiles(frame, "v", shares, few=few, bins=bins).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            if g != "huge":
                assert got[g] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
        assert got["huge"][:1] == [-1.7e308] and got["huge"][3] == 0.0 and got["huge"][-1] == 1.7e308


def test_long_memory_is_streamed(spark, tmp_path):
    """FIGARCH carries its squares from run to run: what it expects is what the batch recursion expects, with more and with fewer returns than the sum reaches back to."""
    frame = simulated.synthetic_returns(spark, [3], n=1300, n_train=1200).select("series", F.col("t").cast("long").alias("t"), "ret").cache()
    states = forecasting.fitted_states(frame.where("t < 300"), [("FIGARCH", "normal"), ("GARCH", "normal")]).cache()
    for i, (low, high) in enumerate(((300, 420), (420, 1300))):
        frame.where(f"t >= {low} AND t < {high}").write.parquet(str(tmp_path / "in" / str(i)))
        live_variance.appended(spark.readStream.schema("series string, t long, ret double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), states, str(tmp_path / "out"), str(tmp_path / "state"))
    r = np.array([x.ret for x in frame.orderBy("t").collect()])
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    for row in states.collect():
        want = garch.one_step(row.spec, np.array(row.p), r, 300)
        own = got[got.model == row.model]
        assert len(own) == 1000 and own["h"].to_numpy() == pytest.approx(want[:-1], rel=1e-9) and own["next_h"].to_numpy() == pytest.approx(want[1:], rel=1e-9)


def test_lag_rows_are_streamed(spark, rows, tmp_path):
    small = rows.where("t < 60").select("series", F.col("t").cast("long").alias("t"), "ret")
    for i, (low, high) in enumerate(((0, 3), (3, 30), (30, 60))):
        small.where(f"t >= {low} AND t < {high}").write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("series string, t long, ret double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        made = live_variance.stream_lags(stream, 5).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        made.trigger(availableNow=True).start().awaitTermination()
        got = {r.t: r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        last = features.forecast_row(small.where(f"t < {high}").withColumn("sq", F.col("ret") * F.col("ret")), "sq", 5).first().x
        assert len(got) == high and (got[high - 1] is None if high < 5 else got[high - 1][:5] == pytest.approx(last))


def test_term_structures(spark, rows):
    specs = [("GARCH", "normal"), ("GJR-GARCH", "normal"), ("EGARCH", "normal"), ("APARCH", "normal"), ("FIGARCH", "normal")]
    states = forecasting.fitted_states(rows.where("t < 500"), specs).cache()
    got = {(r.model, r.ahead): r.h for r in forecasting.term_structure(states, 5, 300).collect()}
    assert len(got) == 25 and all(h > 0 for h in got.values())
    for s in states.collect():
        assert got[s.model, 1] == pytest.approx(garch.variance_of(s.spec, np.array(s.p), s.state) / garch.SCALE**2)
        if s.spec in ("GARCH", "GJR-GARCH"):
            h, own = s.state, []
            for _ in range(5):
                own.append(h / garch.SCALE**2)
                h = s.p[1] + (s.p[2] + (s.p[3] if s.spec == "GARCH" else s.p[3] / 2 + s.p[4])) * h
            assert [got[s.model, k] for k in range(1, 6)] == pytest.approx(own)
        else:
            assert 0.3 < got[s.model, 5] / got[s.model, 1] < 3


def test_scores_wait_for_their_actuals(spark):
    """Actuals that come in time, that never come and that come too late; each forecast is scored once."""
    import datetime as dt

    from varlake.streaming import live_scores

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    f = spark.createDataFrame([("a", m, t, at(t), float(t)) for m in ("x", "y") for t in range(1, 9)], "series string, model string, t long, ts timestamp, forecast double")
    a = spark.createDataFrame([("a", t, at(t, 20), t + 1.0) for t in (1, 2, 4, 5, 8)] + [("a", 3, at(6), 9.0), ("b", 1, at(1), 1.0)], "series string, t long, actual_ts timestamp, actual double")
    out = live_scores.replayed(f, a).cache()
    got = {(r.model, r.t): (r.forecast, r.actual, r.squared) for r in out.collect()}
    assert out.count() == 16 == len(got)
    assert all(got[m, t] == ((t, t + 1.0, 1.0) if t in (1, 2, 4, 5, 8) else (t, None, None)) for m in ("x", "y") for t in range(1, 9))
    assert {(r.model, r.n, r.n_scored, r.rmse) for r in live_scores.running_metrics(out).collect()} == {("x", 8, 5, 1.0), ("y", 8, 5, 1.0)}
