"""All queries over the operators of this package, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import names, special
from .operators import accuracy, confidence, features, losses, normality, reporting, returns
from .sources import bars, daily_files
from .plans import forecasting, garch, stand_ins, tree_models, trees
from .streaming import live_bars, live_scores, live_variance

QUERIES: dict = {}
ORACLE: dict = {}

# Shared parts of the SQL: bars, returns with proxies, stand-in forecasts and their losses.
BARS = """bars AS (
  SELECT 'all' AS series, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close
  FROM events WHERE value > 0 GROUP BY 2)"""
RETS = BARS + """, r0 AS (
  SELECT *, ln(close / lag(close) OVER (ORDER BY ts)) AS ret, row_number() OVER (ORDER BY ts) - 2 AS t FROM bars
), rets AS (
  SELECT *, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS garman_klass, ln(high / low) ** 2 / (4 * ln(2)) AS parkinson, ret * ret AS squared FROM r0 WHERE ret IS NOT NULL)"""
FORECASTS = RETS + """, ma AS (
  SELECT series, t, garman_klass AS actual, avg(squared) OVER w5 AS ma5, avg(squared) OVER w20 AS ma20, avg(squared) OVER w60 AS ma60, lag(garman_klass) OVER (ORDER BY t) AS gk1
  FROM rets WINDOW w5 AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w60 AS (ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)
), fc AS (
  SELECT series, t, 'MA-5' AS model, 0 AS model_ord, ma5 AS forecast, actual FROM ma WHERE t >= 200
  UNION ALL SELECT series, t, 'MA-20', 1, ma20, actual FROM ma WHERE t >= 200
  UNION ALL SELECT series, t, 'MA-60', 2, ma60, actual FROM ma WHERE t >= 200
  UNION ALL SELECT series, t, 'LAG-GK', 3, gk1, actual FROM ma WHERE t >= 200
), ls AS (
  SELECT *, forecast - actual AS error, (forecast - actual) ** 2 AS squared, abs(forecast - actual) AS absolute, CASE WHEN forecast > 0 THEN ln(forecast) + actual / forecast WHEN forecast = 0 AND actual < 0 THEN CAST('-inf' AS DOUBLE) WHEN forecast IS NOT NULL THEN CAST('nan' AS DOUBLE) END AS qlike FROM fc)"""
PAIRS = FORECASTS + """, dm AS (
  SELECT a.series, a.model AS model_i, b.model AS model_j, count(*) AS n, avg(a.squared - b.squared) AS mean_d,
    avg(a.squared - b.squared) / sqrt(var_pop(a.squared - b.squared) / count(*)) * sqrt((count(*) + 1.0 - 2) / count(*)) AS stat
  FROM ls a JOIN ls b ON a.series = b.series AND a.t = b.t AND a.model_ord < b.model_ord GROUP BY ALL)"""


def query(key: str, sql: str | None = None):
    """Registers a query under its key, with its SQL if there is any."""

    def add(run):
        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return run

    return add


def rounded(frame: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, as sums over rows differ in their last digits by order."""
    return frame.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


def round_sql(columns: str, source: str, with_: str, digits: int = 8, rest: str = "") -> str:
    """SELECT of the columns in parentheses rounded: 'series, (ret), n'."""
    parts = [p.strip() for p in columns.split(",")]
    cols = ", ".join(f"round({p[1:-1]}, {digits}) AS {p[1:-1]}" if p.startswith("(") else p for p in parts)
    return f"WITH {with_} SELECT {cols} FROM {source} {rest}"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return bars.hourly_bars(bars.table(spark, d, "events"))


def rets(spark: SparkSession, d: str) -> DataFrame:
    return returns.with_proxies(returns.with_returns(hourly(spark, d)))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    return stand_ins.stand_in_forecasts(rets(spark, d), 200)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return losses.with_losses(forecasts(spark, d))


def pairs(spark: SparkSession, d: str, h: int = 1) -> DataFrame:
    return accuracy.compare(scored(spark, d).withColumn("loss", F.col("squared")), h)


@query("SRC4_hourly_bars", f"WITH {BARS} SELECT * FROM bars")
def _(spark, d):
    return hourly(spark, d)


@query("SRC1_bars_between", f"WITH {BARS} SELECT ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(spark, d):
    return bars.hourly_bars_between(bars.table(spark, d, "events"), "2024-01-05", "2024-01-20").select("ts", "close")


@query("SRC1_days_of_a_source", f"WITH {BARS} SELECT CAST(ts AS DATE) AS day, ts, close FROM bars WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, d):
    daily_files.register(spark)
    path = live_bars.new_folder(spark, "days")
    daily_files.write_days(hourly(spark, d).select("ts", "close", F.to_date("ts").alias("day")), path)
    return spark.read.format(daily_files.FORMAT).schema("day date, ts timestamp, close double").load(path).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")


@query("SRC4_daily_bars_by_type", """SELECT event_type AS series, date_trunc('day', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close
FROM events WHERE value > 0 GROUP BY ALL""")
def _(spark, d):
    return bars.daily_bars_by_type(bars.table(spark, d, "events"))


@query("SRC4_daily_order_bars", """SELECT 'orders' AS series, date_trunc('day', o_orderdate) AS ts, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close
FROM orders WHERE o_totalprice > 0 GROUP BY ALL""")
def _(spark, d):
    return bars.daily_order_bars(bars.table(spark, d, "orders"))


@query("PRJ1_returns", round_sql("series, t, ts, (ret)", "rets", RETS))
def _(spark, d):
    return rounded(rets(spark, d).select("series", F.col("t").cast("long").alias("t"), "ts", "ret"))


@query("PRJ2_to_5_proxies", round_sql("series, ts, (garman_klass), (parkinson), (squared)", "rets", RETS))
def _(spark, d):
    return rounded(rets(spark, d).select("series", "ts", "garman_klass", "parkinson", "squared"))


@query("PRJ5_long_proxies", round_sql("ts, proxy_name, (proxy)", "(UNPIVOT (SELECT ts, garman_klass, parkinson, squared FROM rets) ON garman_klass, parkinson, squared INTO NAME proxy_name VALUE proxy)", RETS))
def _(spark, d):
    return rounded(returns.long_proxies(rets(spark, d)).select("ts", "proxy_name", "proxy"))


@query("AGG7_proxy_summary", f"""WITH {RETS} SELECT series, {", ".join(f"round({f}({v}), 8) AS {n}_{v}" for v in returns.PROXIES for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))} FROM rets GROUP BY series""")
def _(spark, d):
    return rounded(returns.summary(rets(spark, d), list(returns.PROXIES)))


@query("AGG6_moments", f"""WITH {RETS}, m AS (SELECT avg(ret) AS mu FROM rets), c AS (SELECT ret, ret - mu AS x FROM rets, m)
SELECT 'all' AS series, count(*) AS n, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, round(min(ret), 8) AS min, round(max(ret), 8) AS max, round(max(ret) - min(ret), 8) AS range,
  round(avg(x ** 3) / avg(x ** 2) ** 1.5, 8) AS skew, round(avg(x ** 4) / avg(x ** 2) ** 2 - 3, 8) AS kurtosis FROM c""")
def _(spark, d):
    return rounded(returns.moments(rets(spark, d), "ret"))


@query("FLT2_3_split", f"""WITH {RETS} SELECT ts, CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM rets WHERE ts <= TIMESTAMP '2024-01-15' OR ts BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-25'""")
def _(spark, d):
    return returns.split_by_date(rets(spark, d), "2024-01-15", "2024-01-16", "2024-01-25").select("ts", "split")


@query("PRJ14_AGG8_winsorized", f"""WITH {RETS}, q AS (SELECT quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM rets)
SELECT ts, round(greatest(least(ret, hi), lo), 8) AS clipped FROM rets, q""")
def _(spark, d):
    return rounded(returns.winsorized(rets(spark, d), "ret").select("ts", "clipped"))


@query("PRJ15_log_target", f"""WITH {RETS}, q AS (SELECT quantile_cont(garman_klass, 0.01) AS q, min(garman_klass) FILTER (WHERE garman_klass > 0) AS least FROM rets)
SELECT ts, round(ln(greatest(garman_klass, CASE WHEN q > 0 THEN q ELSE coalesce(least, 1e-12) END)), 8) AS target FROM rets, q""")
def _(spark, d):
    return rounded(returns.log_target(rets(spark, d), "garman_klass").select("ts", "target"))


@query("PRJ16_JOIN2_target", f"WITH {RETS} SELECT ts, round(CASE WHEN (SELECT bool_and(parkinson IS NOT NULL) FROM rets) THEN parkinson ELSE squared END, 8) AS target FROM rets")
def _(spark, d):
    return rounded(returns.resolved_target(rets(spark, d), "parkinson").select("ts", "target"))


@query("PRJ17_AGG10_scaled", f"""WITH {RETS}, q AS (SELECT quantile_cont(ret, 0.5) AS m, quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS s FROM rets)
SELECT ts, round((ret - m) / s, 8) AS scaled, round(ret, 8) AS restored FROM rets, q""")
def _(spark, d):
    return rounded(returns.robust_scaled(rets(spark, d), "ret").select("ts", "scaled", "restored"))


@query("PRJ11_12_18_scales", f"WITH {RETS} SELECT ts, round(sqrt(squared * 252), 8) AS year, round(sqrt(abs(ret) * sqrt(252)), 8) AS shade, round(ln(squared + 1e-12), 8) AS logged FROM rets")
def _(spark, d):
    return rounded(rets(spark, d).select("ts", returns.annualised(F.col("squared")).alias("year"), returns.shading(F.col("ret")).alias("shade"), F.ln(F.col("squared") + returns.LOG_FLOOR).alias("logged")))


@query("PRJ6_to_10_losses", round_sql("model, t, (error), (squared), (absolute), (qlike)", "ls", FORECASTS))
def _(spark, d):
    return rounded(scored(spark, d).select("model", F.col("t").cast("long").alias("t"), "error", "squared", "absolute", "qlike"))


@query("AGG1_to_5_metrics", f"WITH {FORECASTS} SELECT series, model, round(sqrt(avg(squared)), 8) AS rmse, round(avg(absolute), 8) AS mae, round(avg(squared), 8) AS mse, round(avg(qlike), 8) AS qlike FROM ls GROUP BY ALL")
def _(spark, d):
    return rounded(losses.metrics(forecasts(spark, d)))


@query("SRT1_TOP1_best_model", f"WITH {FORECASTS} SELECT model, round(sqrt(avg(squared)), 8) AS rmse FROM ls GROUP BY model ORDER BY rmse LIMIT 1")
def _(spark, d):
    return rounded(losses.metrics(forecasts(spark, d)).select("model", "rmse").orderBy("rmse").limit(1))


@query("WIN12_best_of_group", f"""WITH {FORECASTS}, m AS (SELECT regexp_extract(model, '^(.*)-[^-]*$', 1) AS family, model, sqrt(avg(squared)) AS rmse FROM ls GROUP BY ALL)
SELECT family, arg_min(model, rmse) AS model, round(min(rmse), 8) AS rmse FROM m GROUP BY family""")
def _(spark, d):
    return rounded(losses.best_of_group(losses.metrics(forecasts(spark, d)).withColumn("family", names.family(F.col("model"))), "family", "rmse"))


@query("PRJ19_20_hybrid", f"WITH {FORECASTS} SELECT model, t, round(actual - forecast, 8) AS residual, round(greatest(forecast + lag(actual - forecast) OVER (PARTITION BY model ORDER BY t), 1e-10), 8) AS hybrid FROM fc")
def _(spark, d):
    from pyspark.sql import Window

    f = forecasts(spark, d).withColumn("residual", F.col("actual") - F.col("forecast"))
    last = F.lag("residual").over(Window.partitionBy("series", "model").orderBy("t"))
    return rounded(f.select("model", F.col("t").cast("long").alias("t"), "residual", F.when(last.isNotNull(), returns.recombined(F.col("forecast"), last)).otherwise(F.lit(returns.LEVEL_FLOOR)).alias("hybrid")))


@query("AGG9_PRJ21_smearing", f"""WITH {FORECASTS}, s AS (SELECT model, avg(exp(ln(actual) - ln(forecast))) AS factor FROM fc WHERE actual > 0 AND forecast > 0 GROUP BY model)
SELECT fc.model, t, round(factor, 8) AS factor, round(exp(ln(forecast)) * factor, 8) AS level FROM fc JOIN s ON s.model = fc.model WHERE actual > 0 AND forecast > 0""")
def _(spark, d):
    f = forecasts(spark, d).where("actual > 0 AND forecast > 0")
    s = f.groupBy("model").agg(returns.smearing(F.ln("actual"), F.ln("forecast")).alias("factor"))
    return rounded(f.join(s, "model").select("model", F.col("t").cast("long").alias("t"), "factor", returns.retransformed(F.ln("forecast"), F.col("factor"), True).alias("level")))


# Forecasters that the screen has to find: multiples of a plain one, and the line through the last two proxies, which may fall below 0.
ODD = {"CLEAN": "1.0", "ZERO": "0.0", "NEGATIVE": "-1.0", "TINY": "0.000000001", "HUGE": "1000000.0", "LOW": "0.2", "HIGH": "3.0"}
ODD_SQL = FORECASTS + """, od AS (
  SELECT series, t, m.model || '-GK' AS model, m.k * forecast AS forecast, actual FROM fc JOIN (VALUES """ + ", ".join(f"('{m}', {k}::DOUBLE)" for m, k in ODD.items()) + """) AS m(model, k) ON true WHERE fc.model = 'LAG-GK'
  UNION ALL SELECT series, t, 'LINE-GK', 2 * forecast - lag(forecast) OVER (PARTITION BY series ORDER BY t), actual FROM fc WHERE model = 'LAG-GK'),
bd AS (SELECT series, min(actual) FILTER (WHERE actual > 0) AS lo, max(actual) AS hi FROM od GROUP BY series),
dg AS (SELECT od.series, model, count(*) AS n, count(*) FILTER (WHERE forecast IS NULL) AS n_nonfinite, count(*) FILTER (WHERE forecast <= 0) AS n_nonpositive, count(*) FILTER (WHERE forecast > 0 AND forecast < lo / 1e4) AS n_extreme_low,
  count(*) FILTER (WHERE forecast > hi * 1e4) AS n_extreme_high, avg(forecast) / avg(actual) AS bias_ratio,
  avg(CASE WHEN forecast > 0 THEN ln(forecast) + actual / forecast WHEN forecast = 0 AND actual < 0 THEN CAST('-inf' AS DOUBLE) WHEN forecast IS NOT NULL THEN CAST('nan' AS DOUBLE) END) AS qlike FROM od JOIN bd ON bd.series = od.series GROUP BY ALL),
sd AS (SELECT *, n_nonfinite + n_nonpositive + n_extreme_low + n_extreme_high > 0 OR isnan(qlike) OR abs(qlike) > 1e3 AS degenerate, coalesce(bias_ratio > 2 OR bias_ratio < 0.5, false) AS biased FROM dg)"""


def odd_forecasts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    plain = forecasts(spark, d).where("model = 'LAG-GK'")
    each = F.array(*(F.struct(F.lit(f"{m}-GK").alias("model"), (F.lit(float(k)) * F.col("forecast")).alias("forecast")) for m, k in ODD.items()))
    line = F.struct(F.lit("LINE-GK").alias("model"), (2 * F.col("forecast") - F.lag("forecast").over(Window.partitionBy("series").orderBy("t"))).alias("forecast"))
    return plain.select("series", "t", "actual", F.concat(each, F.array(line)).alias("m")).select("series", "t", "actual", F.inline("m"))


@query("AGG11_diagnostics", f"WITH {ODD_SQL} SELECT model, n, n_nonfinite, n_nonpositive, n_extreme_low, n_extreme_high, round(bias_ratio, 6) AS bias_ratio, degenerate, biased FROM sd")
def _(spark, d):
    return rounded(losses.diagnostics(odd_forecasts(spark, d)).select("model", "n", "n_nonfinite", "n_nonpositive", "n_extreme_low", "n_extreme_high", "bias_ratio", "degenerate", "biased"), 6)


@query("SRT3_by_trouble_with_nan", f"WITH {ODD_SQL} SELECT series, model, row_number() OVER (PARTITION BY series ORDER BY degenerate DESC, biased DESC, isnan(qlike), qlike DESC, model) AS place FROM sd")
def _(spark, d):
    from pyspark.sql import Window

    return losses.diagnostics(odd_forecasts(spark, d)).select("series", "model", F.row_number().over(Window.partitionBy("series").orderBy(*losses.trouble())).cast("long").alias("place"))


@query("FLT11_excluded_forecasters", f"WITH {ODD_SQL} SELECT series, string_agg(model, ',' ORDER BY model) AS models FROM sd WHERE degenerate GROUP BY series")
def _(spark, d):
    return losses.excluded(losses.diagnostics(odd_forecasts(spark, d))).select("series", F.array_join("models", ",").alias("models"))


@query("WIN2_lag_matrix", f"""WITH {RETS}, x AS (SELECT t, [squared, lag(squared) OVER w, lag(squared, 2) OVER w, ret, lag(ret) OVER w, lag(ret, 2) OVER w] AS x, lead(squared) OVER w AS y, count(*) OVER () AS n FROM rets WINDOW w AS (ORDER BY t))
SELECT t, array_to_string(list_transform(x, lambda v: printf('%.6f', v)), ',') AS x, round(y, 8) AS y FROM x WHERE t >= 3 AND t < n - 1""")
def _(spark, d):
    m = features.lag_matrix(rets(spark, d), "squared", "squared", 3, "ret")
    return m.select(F.col("t").cast("long").alias("t"), F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"), F.round("y", 8).alias("y"))


@query("WIN4_5_sequences", f"""WITH {RETS}, x AS (SELECT t, list(ret) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x, lead(squared) OVER (ORDER BY t) AS y, lead(parkinson) OVER (ORDER BY t) AS g, count(*) OVER () AS n FROM rets)
SELECT t, array_to_string(list_transform(x, lambda v: printf('%.6f', v)), ',') AS x, round(y, 8) AS y, 4 * round(g, 8) AS g FROM x WHERE t >= 4 AND t < n - 1""")
def _(spark, d):
    s = features.sequences(rets(spark, d), "ret", "squared", 4, "parkinson")
    return s.select(F.col("t").cast("long").alias("t"), F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"), F.round("y", 8).alias("y"), (4 * F.round(F.get("g", F.lit(0)), 8)).alias("g"))


@query("WIN3_MDL19_forecast_row", f"WITH {RETS} SELECT series, array_to_string(list_transform(list(squared ORDER BY t DESC)[1:5], lambda v: printf('%.6f', v)), ',') AS x FROM rets GROUP BY series")
def _(spark, d):
    return features.forecast_row(rets(spark, d), "squared", 5).select("series", F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"))


WHOLE_BLOCKS = RETS + """, n AS (SELECT series, count(*) AS n FROM rets GROUP BY series),
b AS (SELECT series, n, unnest(range(CAST(ceil((n - 200) / 10.0) AS BIGINT))) AS block FROM n WHERE n > 200)"""


@query("WIN7_8_refit_blocks_whole", f"WITH {WHOLE_BLOCKS} SELECT series, block, 100 + 10 * block AS fit_start, 200 + 10 * block AS fit_end, 10 * block AS first_step, least(10 * block + 9, n - 201) AS last_step FROM b")
def _(spark, d):
    return features.series_blocks(rets(spark, d), 200, 10, 100)


@query("WIN6_7_block_windows_whole", f"""WITH {WHOLE_BLOCKS}
SELECT block, count(*) FILTER (WHERE t < 200 + 10 * block) AS n_fit, count(*) FILTER (WHERE t >= 200 + 10 * block) AS n_steps, round(avg(squared) FILTER (WHERE t < 200 + 10 * block), 8) AS mean
FROM b JOIN rets ON b.series = rets.series AND t >= 100 + 10 * block AND t < 210 + 10 * block GROUP BY block""")
def _(spark, d):
    fit = F.col("t") < F.col("fit_end")
    rows = features.block_rows(rets(spark, d), 200, None, 10, 100).groupBy("block")
    return rounded(rows.agg(F.count_if(fit).alias("n_fit"), F.count_if(~fit).alias("n_steps"), F.avg(F.when(fit, F.col("squared"))).alias("mean")))


EXPANDING = RETS + """, n AS (SELECT count(*) AS n FROM rets), b AS (SELECT unnest(range(CAST(ceil((n - 200) / 10.0) AS BIGINT))) AS block FROM n)"""


@query("WIN6_expanding_windows", f"WITH {EXPANDING} SELECT block, count(*) AS n_fit, round(avg(squared), 8) AS mean FROM b JOIN rets ON t < 200 + 10 * block GROUP BY block")
def _(spark, d):
    rows = features.block_rows(rets(spark, d), 200, None, 10, None).where("t < fit_end")
    return rounded(rows.groupBy("block").agg(F.count("*").alias("n_fit"), F.avg("squared").alias("mean")))


@query("MDL5_variance_path", f"""WITH RECURSIVE {RETS}, x AS (SELECT t, ret FROM rets), f AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0.5 AS DOUBLE) AS h UNION ALL SELECT f.t + 1, 0.01 + 0.05 * x.ret * x.ret + 0.9 * f.h FROM f JOIN x ON x.t = f.t)
SELECT 'all' AS series, f.t, round(h, 8) AS h FROM f JOIN x ON x.t = f.t""")
def _(spark, d):
    return rounded(features.variance_path(rets(spark, d), 0.01, 0.05, 0.9, 0.5))


# Parameters of three specifications, of returns in percent, as rows of a table of fits.
GIVEN = {"GARCH": {"mu": 0.5, "omega": 400.0, "alpha[1]": 0.05, "beta[1]": 0.9}, "GJR-GARCH": {"mu": 0.5, "omega": 400.0, "alpha[1]": 0.03, "gamma[1]": 0.06, "beta[1]": 0.88}, "APARCH": {"mu": 0.5, "omega": 5.0, "alpha[1]": 0.05, "gamma[1]": 0.2, "beta[1]": 0.9, "delta": 1.4}}
PATHS = """tb AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, last(value ORDER BY ts, event_id) AS close FROM events WHERE value > 0 GROUP BY ALL),
tr AS (SELECT series, row_number() OVER w - 2 AS t, ln(close / lag(close) OVER w) AS ret FROM tb WINDOW w AS (PARTITION BY series ORDER BY ts)),
g(model, mu, omega, alpha, gamma, beta, delta) AS (VALUES """ + ", ".join(f"('{m}', {p['mu']}::DOUBLE, {p['omega']}::DOUBLE, {p['alpha[1]']}::DOUBLE, {p.get('gamma[1]', 0.0)}::DOUBLE, {p['beta[1]']}::DOUBLE, {p.get('delta', 2.0)}::DOUBLE)" for m, p in GIVEN.items()) + """),
x AS (SELECT series, t, g.*, 100 * ret - mu AS e FROM tr JOIN g ON true WHERE ret IS NOT NULL),
b AS (SELECT series, model, sum(0.94 ** t * e * e) / sum(0.94 ** t) AS b0 FROM x WHERE t < 75 GROUP BY ALL),
m AS (SELECT x.series, x.model, t, beta, delta, CASE model WHEN 'APARCH' THEN omega + alpha * greatest(abs(e) - gamma * e, 1e-12) ** delta WHEN 'GJR-GARCH' THEN omega + (alpha + CASE WHEN e < 0 THEN gamma ELSE 0 END) * e * e ELSE omega + alpha * e * e END AS c,
  omega + (alpha + CASE model WHEN 'GJR-GARCH' THEN gamma / 2 ELSE 0 END + beta) * b0 ** (delta / 2) AS s0 FROM x JOIN b USING (series, model)),
f AS (SELECT series, model, CAST(0 AS BIGINT) AS t, s0 AS s, delta FROM m WHERE t = 0 UNION ALL SELECT f.series, f.model, f.t + 1, m.c + m.beta * f.s, f.delta FROM f JOIN m ON m.series = f.series AND m.model = f.model AND m.t = f.t),
h AS (SELECT series, model, t, s ** (2 / delta) / 10000 AS h FROM f WHERE EXISTS (SELECT 1 FROM m WHERE m.series = f.series AND m.model = f.model AND m.t = f.t))"""


@query("MDL5_insample_variance", f"WITH RECURSIVE {PATHS} SELECT series, model, t, round(h, 6) AS h FROM h")
def _(spark, d):
    rows = typed_rets(spark, d)
    given = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(m).alias("model_type"), F.lit(k).alias("parameter"), F.lit(float(v)).alias("coef")) for m, p in GIVEN.items() for k, v in p.items()))
    fits = rows.select("series").distinct().select("series", F.inline(given))
    return rounded(forecasting.insample_variance(rows, fits), 6)


@query("WIN14_MDL4_to_6_filter", f"""WITH RECURSIVE {RETS}, x AS (SELECT t, ret FROM rets), f AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0.5 AS DOUBLE) AS h UNION ALL SELECT f.t + 1, 0.01 + 0.05 * x.ret * x.ret + 0.9 * f.h FROM f JOIN x ON x.t = f.t)
SELECT 'all' AS series, round(arg_max(h, t), 8) AS h FROM f""")
def _(spark, d):
    return rounded(features.filtered_variance(rets(spark, d), 0.01, 0.05, 0.9, 0.5))


@query("TST1_to_4_JOIN5_compare", round_sql("series, model_i, model_j, n, (mean_d), (stat)", "dm", PAIRS))
def _(spark, d):
    return rounded(pairs(spark, d))


@query("TST3_WIN9_AGG18_compare_h3", f"""WITH {FORECASTS}, p AS (SELECT a.model AS model_i, b.model AS model_j, a.t, a.squared - b.squared AS d FROM ls a JOIN ls b ON a.t = b.t AND a.model_ord < b.model_ord),
c AS (SELECT model_i, model_j, d, d - avg(d) OVER k AS c, row_number() OVER (PARTITION BY model_i, model_j ORDER BY t) - 1 AS i, count(*) OVER k AS n FROM p WINDOW k AS (PARTITION BY model_i, model_j)),
g AS (SELECT x.model_i, x.model_j, max(x.n) AS n, avg(x.d) AS mean_d, avg(x.c * x.c) AS g0, avg(x.c * y.c) AS g1, avg(x.c * z.c) AS g2 FROM c x
  JOIN c y ON y.model_i = x.model_i AND y.model_j = x.model_j AND y.i = (x.i - 1 + x.n) % x.n JOIN c z ON z.model_i = x.model_i AND z.model_j = x.model_j AND z.i = (x.i - 2 + x.n) % x.n GROUP BY ALL)
SELECT model_i, model_j, round(mean_d / sqrt(CASE WHEN g0 + 2 * (g1 + g2) > 0 THEN g0 + 2 * (g1 + g2) ELSE g0 END / n) * sqrt((n + 1.0 - 6 + 6.0 / n) / n), 6) AS stat FROM g""")
def _(spark, d):
    return rounded(pairs(spark, d, 3).select("model_i", "model_j", "stat"), 6)


@query("TST4_pvalues")
def _(spark, d):
    return accuracy.with_pvalues(pairs(spark, d))


PSEUDO = PAIRS + ", pp AS (SELECT *, exp(-abs(stat)) AS p FROM dm)"


@query("AGG12_family_split", f"""WITH {PSEUDO}, f AS (SELECT *, regexp_extract(model_i, '^(.*)-[^-]*$', 1) = regexp_extract(model_j, '^(.*)-[^-]*$', 1) AS same_family FROM pp)
SELECT same_family, count(*) FILTER (WHERE p < 0.3) AS n_significant, count(*) AS n_total, round(avg(CASE WHEN p < 0.3 THEN 1.0 ELSE 0.0 END), 8) AS rate, coalesce(string_agg(model_i || '|' || model_j, ';' ORDER BY p) FILTER (WHERE p < 0.3), '') AS pairs FROM f GROUP BY same_family""")
def _(spark, d):
    out = accuracy.family_split(pairs(spark, d).withColumn("p", F.exp(-F.abs("stat"))), "p", 0.3)
    return rounded(out.select("same_family", "n_significant", "n_total", "rate", F.array_join("pairs", ";").alias("pairs")))


@query("AGG13_TOP2_degrees", f"WITH {PSEUDO}, e AS (SELECT unnest([model_i, model_j]) AS model FROM pp WHERE p < 0.3) SELECT model, count(*) AS degree FROM e GROUP BY model ORDER BY degree DESC, model LIMIT 5")
def _(spark, d):
    return accuracy.rejection_degrees(pairs(spark, d).withColumn("p", F.exp(-F.abs("stat"))), "p", 0.3).select("model", "degree").orderBy(F.desc("degree"), "model").limit(5)


@query("AGG12_family_split_pvalues")
def _(spark, d):
    return accuracy.family_split(accuracy.with_pvalues(pairs(spark, d)))


@query("AGG13_degrees_pvalues")
def _(spark, d):
    return accuracy.rejection_degrees(accuracy.with_pvalues(pairs(spark, d)))


SCREEN = FORECASTS + """, bounds AS (SELECT series, min(actual) FILTER (WHERE actual > 0) AS lo, max(actual) AS hi FROM ls GROUP BY series),
dg AS (SELECT ls.series, model, count(*) FILTER (WHERE forecast IS NULL OR NOT isfinite(forecast)) + count(*) FILTER (WHERE forecast <= 0) + count(*) FILTER (WHERE forecast > 0 AND forecast < lo / 1e4) + count(*) FILTER (WHERE hi > 0 AND forecast > hi * 1e4) AS odd,
  avg(qlike) AS qlike, avg(forecast) / nullif(greatest(avg(actual), 0), 0) AS bias FROM ls JOIN bounds ON ls.series = bounds.series GROUP BY ALL),
sc AS (SELECT series, model, qlike, odd > 0 OR qlike IS NULL OR isnan(qlike) OR abs(qlike) > 1e3 AS degenerate, coalesce(bias > 2 OR bias < 0.5, false) AS biased FROM dg)"""


@query("SRT3_by_trouble", f"WITH {SCREEN} SELECT series, model, degenerate, biased, row_number() OVER (PARTITION BY series ORDER BY degenerate DESC, biased DESC, isnan(qlike), qlike DESC, model) AS place FROM sc")
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("series").orderBy(*losses.trouble())
    return losses.by_trouble(losses.diagnostics(forecasts(spark, d))).select("series", "model", "degenerate", "biased", F.row_number().over(order).cast("long").alias("place"))


@query("FLT11_exclusion_list", f"WITH {SCREEN} SELECT series, string_agg(model, ',' ORDER BY model) AS models FROM sc WHERE degenerate GROUP BY series")
def _(spark, d):
    return losses.excluded(losses.diagnostics(forecasts(spark, d))).select("series", F.array_join("models", ",").alias("models"))


GROUPED = FORECASTS + """, gm AS (SELECT series, model, 'GARCH' AS "group", sqrt(avg(squared)) AS rmse FROM ls GROUP BY ALL)"""


@query("SRT4_by_group_and_rmse", f"""WITH {GROUPED} SELECT "group", model, row_number() OVER (PARTITION BY series ORDER BY "group", rmse, model) AS place FROM gm""")
def _(spark, d):
    from pyspark.sql import Window

    rows = losses.metrics(forecasts(spark, d)).withColumn("group", names.group(F.col("model")))
    return rows.select("group", "model", F.row_number().over(Window.partitionBy("series").orderBy("group", "rmse", "model")).cast("long").alias("place"))


@query("SET2_later_overwrites", f"WITH {FORECASTS} SELECT model, count(*) AS n, round(avg(CASE WHEN model LIKE 'MA-%' THEN 2 * forecast ELSE forecast END), 8) AS mean FROM fc GROUP BY model")
def _(spark, d):
    f = forecasts(spark, d)
    later = f.where(F.col("model").startswith("MA-")).withColumn("forecast", 2 * F.col("forecast"))
    return rounded(losses.overwritten(f, later).groupBy("model").agg(F.count("*").alias("n"), F.avg("forecast").alias("mean")))


@query("JOIN7_hybrids_beside_their_base", f"""WITH {FORECASTS}, lg AS (SELECT *, lag(actual - forecast) OVER (PARTITION BY series, model ORDER BY t) AS last FROM fc),
hm AS (SELECT series, 'XGB-' || model || '-resid' AS model, sqrt(avg((greatest(forecast + last, 1e-10) - actual) ** 2)) AS rmse FROM lg WHERE last IS NOT NULL GROUP BY ALL),
bm AS (SELECT series, model, sqrt(avg(squared)) AS rmse FROM ls WHERE model <> 'LAG-GK' GROUP BY ALL)
SELECT hm.model, bm.model AS base, round(hm.rmse, 8) AS rmse, round(bm.rmse, 8) AS base_rmse FROM hm LEFT JOIN bm ON bm.series = hm.series AND hm.model = 'XGB-' || bm.model || '-resid'""")
def _(spark, d):
    from pyspark.sql import Window

    f = forecasts(spark, d)
    last = F.lag(F.col("actual") - F.col("forecast")).over(Window.partitionBy("series", "model").orderBy("t"))
    hybrids = f.withColumn("last", last).where("last IS NOT NULL").withColumn("forecast", returns.recombined(F.col("forecast"), F.col("last"))).withColumn("model", F.concat(F.lit("XGB-"), "model", F.lit("-resid")))
    base = losses.metrics(f.where("model <> 'LAG-GK'"))
    out = losses.with_base(losses.metrics(hybrids), base)
    return rounded(out.select("model", F.when(F.col("base_rmse").isNotNull(), F.col("base")).alias("base"), "rmse", "base_rmse"))


@query("JOIN6_both_confidence_sets")
def _(spark, d):
    own = scored(spark, d).withColumn("loss", F.col("squared"))
    return confidence.side_by_side(confidence.confidence_set(own), confidence.confidence_set(own, to_the_end=True))


@query("TST13_normality_report")
def _(spark, d):
    return normality.report(normality.clean(typed_rets(spark, d), "ret"))


@query("TST12_AGG6_ks_pvalue")
def _(spark, d):
    own = values(spark, d)
    return normality.ks_statistic(own).join(own.groupBy("series").agg(F.count("*").alias("n")), "series").withColumn("p_iid", normality.ks_pvalue(F.col("ks"), F.col("n")))


@query("TST5_TST6_confidence_set")
def _(spark, d):
    return confidence.summary(confidence.confidence_set(scored(spark, d).withColumn("loss", F.col("squared"))))


@query("TST7_SET4_graded_set")
def _(spark, d):
    return confidence.confidence_set(scored(spark, d).withColumn("loss", F.col("qlike")), to_the_end=True)


@query("PRJ23_demeaned", f"WITH {FORECASTS} SELECT model, t, round(squared - avg(squared) OVER (PARTITION BY t), 8) AS d FROM ls")
def _(spark, d):
    from pyspark.sql import Window

    return rounded(scored(spark, d).select("model", F.col("t").cast("long").alias("t"), (F.col("squared") - F.avg("squared").over(Window.partitionBy("series", "t"))).alias("d")))


def values(spark: SparkSession, d: str) -> DataFrame:
    return normality.clean(rets(spark, d), "ret")


LAGS = range(1, 21)
CENTRED = RETS + ", c AS (SELECT t, ret - avg(ret) OVER () AS x FROM rets), l AS (SELECT x, " + ", ".join(f"lag(x, {j}) OVER (ORDER BY t) AS x{j}" for j in LAGS) + " FROM c), s AS (SELECT count(*) AS n, sum(x * x) AS g0, " + ", ".join(f"sum(x * x{j}) AS g{j}" for j in LAGS) + " FROM l)"


@query("TST9_AGG20_ljung_box", "WITH " + CENTRED + " " + " UNION ALL ".join(f"SELECT {m} AS lag, round(n * (n + 2) * ({' + '.join(f'(g{j} / g0) ** 2 / (n - {j})' for j in range(1, m + 1))}), 6) AS statistic FROM s" for m in (10, 20)))
def _(spark, d):
    return rounded(normality.ljung_box(values(spark, d)).select("lag", "statistic"), 6)


@query("AGG19_WIN10_long_run_variance", "WITH " + CENTRED + f" SELECT 'all' AS series, n, round(greatest((g0 + {' + '.join(f'2 * (1 - {j} / 6.0) * g{j}' for j in range(1, 6))}) / n, 1e-12), 8) AS lrv FROM s")
def _(spark, d):
    return rounded(normality.long_run_variance(normality.lag_sums(normality.centred(values(spark, d)), F.col("x"), 5), 5))


@query("TST9_dependence")
def _(spark, d):
    return normality.dependence(values(spark, d))


HERMITE = RETS + """, z AS (SELECT t, (ret - avg(ret) OVER ()) / stddev_pop(ret) OVER () AS z FROM rets), h AS (SELECT t, z, z ** 3 - 3 * z AS h3, z ** 4 - 6 * z * z + 3 AS h4 FROM z),
l AS (SELECT *, lag(h3, 1) OVER o AS a1, lag(h3, 2) OVER o AS a2, lag(h4, 1) OVER o AS b1, lag(h4, 2) OVER o AS b2 FROM h WINDOW o AS (ORDER BY t)),
m AS (SELECT count(*) AS n, avg(z ** 3) AS skew, avg(z ** 4) - 3 AS kurt, greatest((sum(h3 * h3) + 2 * (2 / 3.0) * sum(h3 * a1) + 2 * (1 / 3.0) * sum(h3 * a2)) / count(*), 1e-12) AS v3, greatest((sum(h4 * h4) + 2 * (2 / 3.0) * sum(h4 * b1) + 2 * (1 / 3.0) * sum(h4 * b2)) / count(*), 1e-12) AS v4 FROM l)"""


@query("TST10_PRJ24_25_moment_tests", f"""WITH {HERMITE} SELECT n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(sqrt(n) * skew / sqrt(v3), 6) AS stat_skew, round(sqrt(n) * kurt / sqrt(v4), 6) AS stat_kurt,
round(n * (skew ** 2 / 6 + kurt ** 2 / 24), 6) AS jarque_bera, round(exp(-n * (skew ** 2 / 6 + kurt ** 2 / 24) / 2), 6) AS p_jarque_bera FROM m""")
def _(spark, d):
    return rounded(normality.moment_tests(values(spark, d), 2).select("n", "skew", "kurt", "stat_skew", "stat_kurt", "jarque_bera", "p_jarque_bera"), 6)


@query("TST10_moment_pvalues")
def _(spark, d):
    return normality.with_normal_tails(normality.moment_tests(values(spark, d)))


@query("TST11_ks_bootstrap")
def _(spark, d):
    return normality.ks_bootstrap(values(spark, d))


@query("TST12_ks")
def _(spark, d):
    return normality.ks_statistic(values(spark, d))


@query("WIN11_ecdf", f"WITH {RETS} SELECT ts, round(cume_dist() OVER (ORDER BY ret), 8) AS ecdf FROM rets")
def _(spark, d):
    from pyspark.sql import Window

    return rounded(rets(spark, d).select("ts", F.cume_dist().over(Window.partitionBy("series").orderBy("ret")).alias("ecdf")))


# Names of models of the types of events, in all shapes that names have.
SHAPES = ["GARCH-{}", "GJR-GARCH-{}", "XGB-{}", "XGB-GARCH-{}-feat", "XGB-EGARCH-{}-resid", "LSTM-{}", "LSTM-GARCH-{}-feat", "LSTM-FIGARCH-{}-resid", "plain {}"]
NAMED = "n AS (SELECT replace(shape, '{}', upper(event_type)) AS model FROM (SELECT DISTINCT event_type FROM events) JOIN (VALUES " + ", ".join(f"('{n}')" for n in SHAPES) + ") AS s(shape) ON true)"


def named(spark: SparkSession, d: str) -> DataFrame:
    shapes = F.explode(F.array(*map(F.lit, SHAPES))).alias("shape")
    return bars.table(spark, d, "events").select("event_type").distinct().select("event_type", shapes).select(F.replace("shape", F.lit("{}"), F.upper("event_type")).alias("model"))


@query("FN_STRING_FAMILY_JOIN7", f"WITH {NAMED} SELECT model, CASE WHEN contains(model, '-') THEN regexp_extract(model, '^(.*)-[^-]*$', 1) ELSE model END AS family, regexp_extract(model, '^[^-]+-(.*)-[^-]+$', 1) AS base FROM n")
def _(spark, d):
    return named(spark, d).select("model", names.family(F.col("model")).alias("family"), names.base_model(F.col("model")).alias("base"))


@query("FN_STRING_GROUP_AGG14", f"""WITH {NAMED}, g AS (SELECT CASE WHEN split_part(model, '-', 1) IN ('XGB', 'LSTM') THEN
  CASE WHEN contains(model, '-feat') THEN split_part(model, '-', 1) || ' Hybrid (features)' WHEN contains(model, '-resid') THEN split_part(model, '-', 1) || ' Hybrid (residual)' ELSE 'Standalone ' || split_part(model, '-', 1) END ELSE 'GARCH' END AS "group" FROM n)
SELECT "group", count(*) AS n FROM g GROUP BY ALL""")
def _(spark, d):
    return named(spark, d).groupBy(names.group(F.col("model")).alias("group")).agg(F.count("*").alias("n"))


@query("FN_SPECIAL")
def _(spark, d):
    own = normality.standardised(values(spark, d))
    x = F.abs("z")
    return own.select("series", "t", special.t_two_sided(x, F.lit(30)).alias("student_t"), special.normal_sf(x).alias("normal"), special.chi2_sf(x, 2).alias("chi2_2"), special.chi2_sf(x, 7).alias("chi2_7"))


# Coefficients by moments of each type's returns: the mean, and correlations of squares with what came before; exp(-|t|) stands for the p-value, which SQL can express.
COEFS = """tb AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, last(value ORDER BY ts, event_id) AS close FROM events WHERE value > 0 GROUP BY ALL
), tr AS (SELECT series, ts, ln(close / lag(close) OVER (PARTITION BY series ORDER BY ts)) AS r FROM tb),
tl AS (SELECT series, r, r * r AS s, lag(r) OVER w AS r1, lag(r * r) OVER w AS s1, lag(r * r, 2) OVER w AS s2 FROM tr WHERE r IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)),
tm AS (SELECT series, count(*) AS n, avg(r) AS mu, stddev_samp(r) / sqrt(count(*)) AS mu_se, corr(s, s1) AS a, corr(s, s2) AS b, corr(s, r1) AS g FROM tl GROUP BY series),
tk(model, model_type, parameter, coef, std_err) AS (
  SELECT 'GARCH-' || upper(series), 'GARCH', 'mu', mu, mu_se FROM tm UNION ALL SELECT 'GARCH-' || upper(series), 'GARCH', 'alpha[1]', a, 1 / sqrt(n) FROM tm UNION ALL SELECT 'GARCH-' || upper(series), 'GARCH', 'beta[1]', b, 1 / sqrt(n) FROM tm
  UNION ALL SELECT 'GJR-GARCH-' || upper(series), 'GJR-GARCH', 'alpha[1]', a, 1 / sqrt(n) FROM tm UNION ALL SELECT 'GJR-GARCH-' || upper(series), 'GJR-GARCH', 'beta[1]', b, 1 / sqrt(n) FROM tm UNION ALL SELECT 'GJR-GARCH-' || upper(series), 'GJR-GARCH', 'gamma[1]', g, 1 / sqrt(n) FROM tm
  UNION ALL SELECT 'FIGARCH-' || upper(series), 'FIGARCH', 'd', a, 1 / sqrt(n) FROM tm UNION ALL SELECT 'FIGARCH-' || upper(series), 'FIGARCH', 'phi', NULL, NULL FROM tm),
k AS (SELECT model, model_type, parameter, round(coef, 8) AS coef, round(std_err, 8) AS std_err, round(coef / std_err, 6) AS t_stat, round(exp(-abs(coef / std_err)), 6) AS p_value FROM tk)"""
STARS = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END"


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_t()
    rows = typed_rets(spark, d).select("series", "ret", "squared", F.lag("ret").over(w).alias("r1"), F.lag("squared").over(w).alias("s1"), F.lag("squared", 2).over(w).alias("s2"))
    unit = 1 / F.sqrt(F.count("*"))
    m = rows.groupBy("series").agg(F.avg("ret").alias("mu"), (F.stddev_samp("ret") * unit).alias("mu_se"), unit.alias("se"), F.corr("squared", "s1").alias("a"), F.corr("squared", "s2").alias("b"), F.corr("squared", "r1").alias("g"))
    given = [("GARCH", "mu", "mu", "mu_se"), ("GARCH", "alpha[1]", "a", "se"), ("GARCH", "beta[1]", "b", "se"), ("GJR-GARCH", "alpha[1]", "a", "se"), ("GJR-GARCH", "beta[1]", "b", "se"), ("GJR-GARCH", "gamma[1]", "g", "se"), ("FIGARCH", "d", "a", "se"), ("FIGARCH", "phi", None, None)]
    null = F.lit(None).cast("double")
    each = F.array(*(F.struct(F.lit(kind).alias("model_type"), F.lit(p).alias("parameter"), (F.col(c) if c else null).alias("coef"), (F.col(e) if e else null).alias("std_err")) for kind, p, c, e in given))
    k = m.select("series", F.inline(each)).withColumn("t_stat", F.col("coef") / F.col("std_err"))
    return k.select(F.concat("model_type", F.lit("-"), F.upper("series")).alias("model"), "model_type", "parameter", F.round("coef", 8).alias("coef"), F.round("std_err", 8).alias("std_err"), F.round("t_stat", 6).alias("t_stat"), F.round(F.exp(-F.abs("t_stat")), 6).alias("p_value"))


@query("RPT1_FN_STARS_param_table", f"WITH {COEFS} SELECT model, parameter, coef, std_err, t_stat, p_value, {STARS} AS stars FROM k")
def _(spark, d):
    return reporting.param_table(coefficients(spark, d))


@query("RPT2_AGG15_param_matrix", f"WITH {COEFS}, c AS (SELECT model, parameter, printf('%.4f', coef) || {STARS} || ' (' || printf('%.4f', std_err) || ')' AS cell FROM k) SELECT model, coalesce(max(cell) FILTER (WHERE parameter = 'mu'), '') AS mu, coalesce(max(cell) FILTER (WHERE parameter = 'beta[1]'), '') AS \"beta[1]\" FROM c GROUP BY model")
def _(spark, d):
    return reporting.param_matrix(coefficients(spark, d), ["mu", "beta[1]"])


@query("RPT3_pvalue_matrix", f"WITH {COEFS} SELECT model, round_even(max(p_value) FILTER (WHERE parameter = 'mu'), 4) AS mu, round_even(max(p_value) FILTER (WHERE parameter = 'gamma[1]'), 4) AS \"gamma[1]\" FROM k GROUP BY model")
def _(spark, d):
    return reporting.pvalue_matrix(coefficients(spark, d), ["mu", "gamma[1]"])


@query("RPT4_AGG17_asymmetry", f"""WITH {COEFS}, a AS (SELECT model, bool_or(parameter = 'gamma[1]') AS has_asymmetry, max(coef) FILTER (WHERE parameter = 'gamma[1]') AS coef, max(p_value) FILTER (WHERE parameter = 'gamma[1]') AS p_value FROM k GROUP BY model)
SELECT model, has_asymmetry, coef, p_value, coalesce(p_value < 0.05, false) AS significant, CASE WHEN NOT has_asymmetry THEN 'no asymmetry parameter estimated' WHEN p_value < 0.05 THEN 'leverage effect supported' ELSE 'not distinguishable from 0 -> effectively symmetric' END AS verdict FROM a""")
def _(spark, d):
    return reporting.asymmetry(coefficients(spark, d)).select("model", "has_asymmetry", "coef", "p_value", "significant", "verdict")


@query("AGG17_asymmetry_counts", f"WITH {COEFS}, a AS (SELECT model, bool_or(parameter = 'gamma[1]') AS has, coalesce(max(p_value) FILTER (WHERE parameter = 'gamma[1]') < 0.05, false) AS sig FROM k GROUP BY model) SELECT count(*) AS n_models, count(*) FILTER (WHERE has) AS n_asymmetric, count(*) FILTER (WHERE sig) AS n_significant FROM a")
def _(spark, d):
    return reporting.asymmetry_counts(reporting.asymmetry(coefficients(spark, d)))


@query("SET5_JOIN9_parameter_order", f"""WITH {COEFS}, p AS (SELECT DISTINCT parameter FROM k UNION SELECT DISTINCT event_type FROM events),
o(parameter, pos) AS (VALUES ('mu', 1), ('omega', 2), ('alpha[1]', 3), ('gamma[1]', 4), ('beta[1]', 5), ('phi', 6), ('d', 7), ('beta', 8), ('delta', 9), ('eta', 10), ('nu', 11), ('lambda', 12))
SELECT p.parameter, row_number() OVER (ORDER BY coalesce(pos, 13), p.parameter) AS place, pos IS NOT NULL AS known FROM p LEFT JOIN o ON o.parameter = p.parameter""")
def _(spark, d):
    more = bars.table(spark, d, "events").select(F.col("event_type").alias("parameter")).distinct()
    return reporting.ordered_parameters(coefficients(spark, d).select("parameter").unionByName(more))


@query("AGG14_groups_and_families", f"""WITH {NAMED}, g AS (SELECT CASE WHEN contains(model, '-') THEN regexp_extract(model, '^(.*)-[^-]*$', 1) ELSE model END AS family, split_part(model, '-', 1) AS learner FROM n)
SELECT learner, count(*) AS n, count(DISTINCT family) AS n_families FROM g GROUP BY learner""")
def _(spark, d):
    return named(spark, d).groupBy(F.split_part("model", F.lit("-"), F.lit(1)).alias("learner")).agg(F.count("*").alias("n"), F.count_distinct(names.family(F.col("model"))).alias("n_families"))


@query("RPT5_persistence", f"""WITH {COEFS}, p AS (SELECT model, model_type, max(coef) FILTER (WHERE parameter = 'alpha[1]') AS a, max(coef) FILTER (WHERE parameter = 'beta[1]') AS b, max(coef) FILTER (WHERE parameter = 'gamma[1]') AS g, max(coef) FILTER (WHERE parameter = 'd') AS d FROM k GROUP BY ALL)
SELECT model, CASE model_type WHEN 'GARCH' THEN 'alpha+beta' WHEN 'GJR-GARCH' THEN 'alpha+beta+gamma/2' WHEN 'EGARCH' THEN 'beta (log-variance AR)' WHEN 'FIGARCH' THEN 'd (long memory)' ELSE 'n/a (no closed form)' END AS measure,
round(CASE model_type WHEN 'GARCH' THEN a + b WHEN 'GJR-GARCH' THEN a + b + g / 2 WHEN 'EGARCH' THEN b WHEN 'FIGARCH' THEN d END, 8) AS value FROM p""")
def _(spark, d):
    return rounded(reporting.persistence(coefficients(spark, d)))


@query("RPT6_FLT6_FN_MAP_equations", f"""WITH {COEFS}, v AS (SELECT model, model_type, map_from_entries(list((parameter, coef))) AS p FROM k GROUP BY ALL HAVING count(coef) > 0),
f AS (SELECT model, model_type, p, printf('%.4f', p['alpha[1]']) AS a, printf('%.4f', p['beta[1]']) AS b, CASE WHEN p['gamma[1]'] < 0 THEN '- ' ELSE '+ ' END || printf('%.4f', abs(p['gamma[1]'])) AS g FROM v)
SELECT model, CASE model_type WHEN 'FIGARCH' THEN 4 ELSE 3 END - CASE model_type WHEN 'FIGARCH' THEN 1 ELSE 0 END AS n_lines, CASE model_type
  WHEN 'GARCH' THEN '\\sigma_t^2 = nan + ' || a || '\\,\\varepsilon_{{t-1}}^2 + ' || b || '\\,\\sigma_{{t-1}}^2'
  WHEN 'GJR-GARCH' THEN '\\sigma_t^2 = nan + ' || a || '\\,\\varepsilon_{{t-1}}^2 ' || g || '\\,\\varepsilon_{{t-1}}^2\\,\\mathbb{{1}}_{{\\{{\\varepsilon_{{t-1}} < 0\\}}}} + ' || b || '\\,\\sigma_{{t-1}}^2'
  ELSE '\\sigma_t^2 = nan + nan\\,\\sigma_{{t-1}}^2 + \\left[1 - nanL - (1 - nanL)(1-L)^{{' || printf('%.4f', p['d']) || '}}\\right]\\varepsilon_t^2' END AS variance FROM f""")
def _(spark, d):
    return reporting.equations(coefficients(spark, d)).select("model", F.size("lines").alias("n_lines"), F.get("lines", F.lit(2)).alias("variance"))


@query("SET1_2_3_merged", f"WITH {FORECASTS} SELECT model, count(*) AS n FROM fc GROUP BY model")
def _(spark, d):
    f = forecasts(spark, d)
    parts = [f.where(F.col("model").startswith(p)) for p in ("MA", "LAG")]
    return losses.merged(*parts).groupBy("model").agg(F.count("*").alias("n"))


def typed_rets(spark: SparkSession, d: str) -> DataFrame:
    """Returns and proxies of the hourly bars of each type of events."""
    return returns.with_proxies(returns.with_returns(bars.hourly_bars_by_type(bars.table(spark, d, "events"))))


def written(frame: DataFrame, kind: str) -> DataFrame:
    """The frame as a table in the session's shared folder, for what is costly and read more than once."""
    path = live_bars.new_folder(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


ALL_MODELS = [(spec, dist) for spec in garch.SPECS for dist in garch.DISTS]


@query("MDL3_MDL9_garch_fits")
def _(spark, d):
    return forecasting.fit_table(typed_rets(spark, d), ALL_MODELS)


@query("AGG16_SRT2_criteria")
def _(spark, d):
    fits = forecasting.fit_table(typed_rets(spark, d), ALL_MODELS)
    return reporting.information_criteria(fits.groupBy("series", "model").agg(F.first("loglik").alias("loglik"), F.count("*").alias("k"), F.first("n").alias("n"))).orderBy("series", "bic")


ORDERED = [*ALL_MODELS, ("EGARCH", "t", 0), ("APARCH", "ged", 0), ("EGARCH", "normal", 1)]
ORDERS = "m(model, model_type, given) AS (VALUES " + ", ".join(f"('{forecasting.model_name(*m)}', '{m[0]}', {'NULL' if len(m) < 3 else m[2]}::INT)" for m in ORDERED) + "), o AS (SELECT * FROM m JOIN (SELECT DISTINCT event_type AS series FROM events) ON true)"


@query("MDL2_asymmetric_order", f"WITH {ORDERS} SELECT series, model, coalesce(given, CASE WHEN model_type IN ('GJR-GARCH', 'EGARCH', 'APARCH') THEN 1 ELSE 0 END) AS asym_order FROM o")
def _(spark, d):
    models = forecasting.with_models(bars.table(spark, d, "events").select(F.col("event_type").alias("series")).distinct(), ORDERED)
    return models.select("series", "model", reporting.asymmetry_order(F.col("spec"), F.col("o")).alias("asym_order"))


@query("MDL2_MDL3_symmetric_fits")
def _(spark, d):
    return forecasting.fit_table(typed_rets(spark, d), [(spec, dist, 0) for spec in garch.ORDERED for dist in garch.DISTS])


@query("RPT4_RPT5_of_fits")
def _(spark, d):
    fits = written(forecasting.fit_table(typed_rets(spark, d), ALL_MODELS).withColumn("model", F.concat_ws("/", "series", "model")), "fits")
    return reporting.asymmetry(fits).join(reporting.persistence(fits), "model")


@query("MDL21_to_23_evaluate")
def _(spark, d):
    return forecasting.evaluate(written(rets(spark, d), "returns"), ALL_MODELS, 400, None, actual="garman_klass")


FEW_TREES = {"n_estimators": 20, "learning_rate": 0.3}  # the library's defaults are 200 trees of rate 0.05


@query("MDL10_MDL11_MDL13_tree_forecasts")
def _(spark, d):
    return tree_models.evaluate(written(rets(spark, d), "returns"), 400, actual="garman_klass", bases=[("GARCH", "normal")], parameters=FEW_TREES)


@query("MDL20_MDL11_JOIN7_hybrids_ahead")
def _(spark, d):
    own = written(rets(spark, d), "returns")
    f = written(tree_models.evaluate(own, 400, every=100, actual="garman_klass", bases=[("GARCH", "normal")], parameters=FEW_TREES), "hybrids")
    by = ["series", "model", "ahead"]  # each step ahead is scored on the actuals of its own time
    base = losses.metrics(forecasting.evaluate_ahead(own, [("GARCH", "normal")], 400, 5, every=100, actual="garman_klass").where("actual IS NOT NULL"), by)
    return losses.with_base(losses.metrics(tree_models.repeated(f, 5).where("actual IS NOT NULL"), by), base, ["ahead"])


@query("MDL14_SRT7_importances")
def _(spark, d):
    lagged = tree_models.lag_rows(typed_rets(spark, d), "garman_klass")
    own = written(lagged.select(F.col("series").alias("g"), F.col("t").alias("i"), F.lit(True).alias("fit"), "x", "y"), "lagged")
    forest = trees.Booster(own, trees.with_parameters(own.select("g").distinct(), FEW_TREES)).run()
    return trees.importances(forest.trees).select(F.col("g").alias("series"), F.get(F.array(*map(F.lit, tree_models.feature_names())), F.col("f")).alias("feature"), "n_splits", "gain", "importance", "place").orderBy("series", "place")


@query("MDL12_tuning")
def _(spark, d):
    lagged = tree_models.lag_rows(typed_rets(spark, d), "garman_klass")
    # Every one of the 50 candidates grows all the trees that it asks for.
    return tree_models.tune(lagged.select(F.col("series").alias("g"), F.col("t").alias("i"), "x", "y"), tree_models.candidates(50))


@query("STREAM_MDL4_MDL6_variance", f"""WITH RECURSIVE {RETS}, x AS (SELECT t, ret FROM rets), f AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0.5 AS DOUBLE) AS h UNION ALL SELECT f.t + 1, 0.000001 + 0.05 * x.ret * x.ret + 0.9 * f.h FROM f JOIN x ON x.t = f.t)
SELECT f.t, round(f.h, 8) AS h, round(0.000001 + 0.05 * x.ret * x.ret + 0.9 * f.h, 8) AS next_h FROM f JOIN x ON x.t = f.t""")
def _(spark, d):
    given = ["'all' AS series", "'GARCH-NORMAL' AS model", "'GARCH' AS spec", "array(0.0D, 0.01D, 0.05D, 0.9D) AS p", "5000.0D AS state", "-1L AS t"]
    return rounded(live_variance.replayed(rets(spark, d), spark.range(1).selectExpr(*given)).select("t", "h", "next_h"))


@query("JOIN3_stream_scores", f"""WITH {FORECASTS}, tt AS (SELECT series, t, ts FROM rets),
sc AS (SELECT fc.series, model, fc.t, tt.ts, forecast, CASE WHEN actual > 0.05 THEN actual END AS actual FROM fc JOIN tt ON tt.series = fc.series AND tt.t = fc.t)
SELECT model, t, ts, round(forecast, 6) AS forecast, round(actual, 6) AS actual, round((forecast - actual) ** 2, 6) AS squared, round(abs(forecast - actual), 6) AS absolute FROM sc""")
def _(spark, d):
    own = rets(spark, d).select("series", F.col("t").cast("long").alias("t"), "ts", "garman_klass")
    made = forecasts(spark, d).select("series", "model", F.col("t").cast("long").alias("t"), "forecast").join(own.select("series", "t", "ts"), ["series", "t"])
    actuals = own.where("garman_klass > 0.05").select("series", "t", (F.col("ts") + F.expr("interval 30 minutes")).alias("actual_ts"), F.col("garman_klass").alias("actual"))
    return rounded(live_scores.replayed(made, actuals).select("model", "t", "ts", "forecast", "actual", "squared", "absolute"), 6)


HORIZON = 12


@query("MDL6_term_structure", f"""WITH RECURSIVE {PATHS}, z AS (SELECT series, model, arg_max(t, t) AS t, arg_max(s, t) AS s FROM f GROUP BY ALL)
SELECT series, model, CAST(ahead AS INTEGER) AS ahead, round((phi ** (ahead - 1) * s + omega * (1 - phi ** (ahead - 1)) / (1 - phi)) / 10000, 6) AS h
FROM (SELECT z.*, omega, alpha + beta + CASE z.model WHEN 'GJR-GARCH' THEN gamma / 2 ELSE 0 END AS phi FROM z JOIN g ON g.model = z.model WHERE z.model <> 'APARCH'), range(1, {HORIZON + 1}) AS r(ahead)""")
def _(spark, d):
    rows = typed_rets(spark, d)
    kinds = {m: p for m, p in GIVEN.items() if m != "APARCH"}
    given = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(m).alias("model_type"), F.lit(k).alias("parameter"), F.lit(float(v)).alias("coef")) for m, p in kinds.items() for k, v in p.items()))
    fits = rows.select("series").distinct().select("series", F.inline(given))
    # The variance after the last return, from the last one's and the return itself.
    last = rows.groupBy("series").agg(F.max("t").alias("t"), F.max_by("ret", "t").alias("ret"))
    state = forecasting.insample_variance(rows, fits).join(last, ["series", "t"])
    states = None
    for m, p in kinds.items():
        e = 100 * F.col("ret") - p["mu"]
        shock = (p["alpha[1]"] + F.when(e < 0, p.get("gamma[1]", 0.0)).otherwise(0.0)) * e * e
        one = state.where(F.col("model") == m).select("series", "model", F.lit(m).alias("spec"), F.array(*(F.lit(float(v)) for v in p.values())).alias("p"), (p["omega"] + shock + p["beta[1]"] * F.col("h") * 10000).alias("state"), F.lit(None).cast("array<double>").alias("past"))
        states = one if states is None else states.unionByName(one)
    return rounded(forecasting.term_structure(states, HORIZON), 6)


@query("STREAM_hourly_bars", f"WITH {BARS} SELECT ts, high, low FROM bars")
def _(spark, d):
    return live_bars.replayed(spark, d).select("ts", "high", "low")


@query("STREAM_hourly_bars_all_prices", f"WITH {BARS} SELECT ts, open, high, low, close FROM bars")
def _(spark, d):
    return live_bars.replayed(spark, d)


