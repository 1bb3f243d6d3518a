"""Dependence and normality of ordered values(series, t, x): lag products and moments as aggregates, resampling as grouped tasks."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import chi2_sf, normal_sf, normal_tail
from .resampling import places


# The Anderson-Darling bound at 5 % for a fitted normal distribution, and its correction by 1/n and 1/n^2.
AD_BOUND = (0.752, 0.75, 2.25)


def by_t() -> Window:
    return Window.partitionBy("series").orderBy("t")


def whole() -> Window:
    return Window.partitionBy("series")


def clean(frame: DataFrame, value: str, least: int = 30, short: str = "drop") -> DataFrame:
    """series, t and x of the finite values of the series that have enough of them; with short="raise" a shorter one is an error when the rows are read."""
    x = F.col(value).cast("double")
    rows = frame.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select("series", "t", x.alias("x"))
    rows = rows.withColumn("n", F.count("*").over(whole()))
    fine = F.col("n") >= least
    if short == "raise":
        fine = F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {least} finite values in series "), F.col("series"))).cast("boolean"))
    return rows.where(fine).drop("n")


def lag_sums(frame: DataFrame, value: Column, lags: int) -> DataFrame:
    """n, g0 and g1..g_lags of each series: sums of products with the value so many rows before."""
    rows = frame.select("series", "t", value.alias("v"))
    rows = rows.select("series", "v", *(F.lag("v", j).over(by_t()).alias(f"v{j}") for j in range(1, lags + 1)))
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("g0"), *(F.sum(F.col("v") * F.col(f"v{j}")).alias(f"g{j}") for j in range(1, lags + 1)))


def centred(frame: DataFrame) -> DataFrame:
    return frame.withColumn("x", F.col("x") - F.avg("x").over(whole()))


def standardised(frame: DataFrame) -> DataFrame:
    return frame.withColumn("z", (F.col("x") - F.avg("x").over(whole())) / F.stddev_pop("x").over(whole()))


def long_run_variance(sums: DataFrame, lags: int) -> DataFrame:
    """Bartlett weights; not below 1e-12."""
    total = F.col("g0") + sum(2 * (1 - j / (lags + 1)) * F.col(f"g{j}") for j in range(1, lags + 1))
    return sums.select("series", "n", F.greatest(total / F.col("n"), F.lit(1e-12)).alias("lrv"))


def longest(frame: DataFrame) -> int:
    """The rows of the longest series, one number."""
    return frame.groupBy("series").count().agg(F.max("count")).first()[0] or 0


def own_lags(n: Column, lags: tuple[int, ...]) -> Column:
    """The lags that are shorter than a series of n rows; if there is none, one of up to 10."""
    fine = F.filter(F.array(*map(F.lit, lags)), lambda m: (m > 0) & (m < n))
    return F.when(F.size(fine) > 0, fine).otherwise(F.array(F.greatest(F.lit(1), F.least(F.lit(10), n - 1)).cast("int")))


def ljung_box(frame: DataFrame, lags: tuple[int, ...] = (10, 20), label: str = "r") -> DataFrame:
    """series, test, lag and statistic, for the lags that each series has by own_lags(); all lags from one pass."""
    most = longest(frame)
    most = max([1, min(10, most - 1), *(m for m in lags if m < most)])
    sums = lag_sums(centred(frame), F.col("x"), most)
    n = F.col("n")
    terms = F.array(*(F.when(n > j, F.pow(F.col(f"g{j}") / F.col("g0"), F.lit(2)) / (n - j)) for j in range(1, most + 1)))
    rows = sums.select("series", "n", terms.alias("terms"), F.explode(own_lags(n, lags)).alias("lag"))
    total = F.aggregate(F.slice("terms", F.lit(1), F.col("lag")), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("series", F.lit(f"Ljung-Box {label}").alias("test"), "lag", (n * (n + 2) * total).alias("statistic"))


def arch_lm(frame: DataFrame, lags: int = 10) -> DataFrame:
    """n R^2 of squared values on their own lags, of which a series of T rows has (T - 1) // 3 at most: cross-products are aggregated in Spark, the normal equations, of a size of their own for each series, solved in a task."""
    sq = frame.select("series", "t", (F.col("x") * F.col("x")).alias("v"))
    count = F.count("*").over(whole())
    k = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor((count - 1) / 3))).cast("int")
    rows = sq.select("series", *([F.col("v").alias("v0")] + [F.lag("v", j).over(by_t()).alias(f"v{j}") for j in range(1, lags + 1)]), k.alias("k"), F.row_number().over(by_t()).alias("rank")).where("rank > k")
    names = [f"v{j}" for j in range(lags + 1)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy("series", "k").agg(F.count("*").alias("n"), F.array(*map(F.sum, names)).alias("m"), F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("c"))

    def solve(frames):
        for f in frames:
            out = []
            for k, n, m, c in zip(f["k"], f["n"], f["m"], f["c"]):
                gram = np.zeros((k + 1, k + 1))
                for (a, b), v in zip(pairs, c):
                    i, j = int(a[1:]), int(b[1:])
                    if j <= k:
                        gram[i, j] = gram[j, i] = v - m[i] * m[j] / n
                beta = np.linalg.lstsq(gram[1:, 1:], gram[1:, 0], rcond=None)[0]
                out.append(n * (beta @ gram[1:, 0]) / gram[0, 0] if gram[0, 0] > 0 else np.nan)
            yield pd.DataFrame({"series": f["series"], "lag": f["k"], "statistic": out})

    return sums.mapInPandas(solve, "series string, lag int, statistic double").select("series", F.lit("ARCH-LM").alias("test"), "lag", "statistic")


def dependence(frame: DataFrame, lags: tuple[int, ...] = (10, 20), arch_lags: int = 10) -> DataFrame:
    squares = frame.withColumn("x", F.col("x") * F.col("x"))
    out = ljung_box(frame, lags, "r").unionByName(ljung_box(squares, lags, "r2")).unionByName(arch_lm(frame, arch_lags))
    return out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("lag")))


def moment_tests(frame: DataFrame, lags: int | None = None) -> DataFrame:
    """Skewness, kurtosis and joint tests that allow for dependence (Bartlett-weighted long-run variances of the influence terms) and Jarque-Bera, with p-values. Without lags, each series has those of plug_in_lags for its length; the greatest length is counted at once."""
    own = F.lit(lags)
    if lags is None:
        own = F.greatest(F.floor(4 * F.pow(F.count("*") / 100, F.lit(2 / 9))), F.lit(1))
        lags = plug_in_lags(longest(frame)) + 1  # one more, should powers round differently; its weight is 0 else
    z = F.col("z")
    infl = standardised(frame).select("series", "t", z, (F.pow(z, 3) - 3 * z).alias("h3"), (F.pow(z, 4) - 6 * z * z + 3).alias("h4"))
    parts = infl.select("series", "t", "z", "h3", "h4", *(F.lag(h, j).over(by_t()).alias(f"{h}_{j}") for h in ("h3", "h4") for j in range(1, lags + 1)))
    n = F.count("*")
    lrv = lambda h: F.greatest((F.sum(F.col(h) * F.col(h)) + sum(F.when(own >= j, 2 * (1 - j / (own + 1)) * F.coalesce(F.sum(F.col(h) * F.col(f"{h}_{j}")), F.lit(0.0))).otherwise(0.0) for j in range(1, lags + 1))) / n, F.lit(1e-12))
    m = parts.groupBy("series").agg(n.alias("n"), F.avg(F.pow("z", F.lit(3))).alias("skew"), (F.avg(F.pow("z", F.lit(4))) - 3).alias("kurt"), lrv("h3").alias("v3"), lrv("h4").alias("v4"))
    m = m.withColumn("stat_skew", F.sqrt("n") * F.col("skew") / F.sqrt("v3")).withColumn("stat_kurt", F.sqrt("n") * F.col("kurt") / F.sqrt("v4"))
    m = m.withColumn("stat_joint", F.pow("stat_skew", F.lit(2)) + F.pow("stat_kurt", F.lit(2))).withColumn("jarque_bera", F.col("n") * (F.pow("skew", F.lit(2)) / 6 + F.pow("kurt", F.lit(2)) / 24))
    return m.select("*", chi2_sf(F.col("stat_joint"), 2).alias("p_joint"), chi2_sf(F.col("jarque_bera"), 2).alias("p_jarque_bera"))


def with_normal_tails(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_skew", 2 * normal_sf(F.abs("stat_skew"))).withColumn("p_kurt", 2 * normal_sf(F.abs("stat_kurt")))


def ks_statistic(frame: DataFrame) -> DataFrame:
    """The distance of the empirical distribution from the normal one with the sample's mean and deviation needs Phi: an Arrow UDF between two windows."""
    z = frame.withColumn("z", (F.col("x") - F.avg("x").over(whole())) / F.stddev_samp("x").over(whole()))
    by = Window.partitionBy("series").orderBy("x")
    rows = z.select("series", (1 - normal_sf(F.col("z"))).alias("phi"), F.cume_dist().over(by).alias("upper"), ((F.rank().over(by) - 1) / F.count("*").over(whole())).alias("lower"))
    return rows.groupBy("series").agg(F.max(F.greatest(F.abs(F.col("upper") - F.col("phi")), F.abs(F.col("lower") - F.col("phi")))).alias("ks"))


def ks_pvalue(ks: Column, n: Column) -> Column:
    """The classical p-value of the distance for independent values: the alternating series of exp(-2 k^2 x^2) at x = (sqrt n + 0.12 + 0.11 / sqrt n) d."""
    x = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * ks
    terms = sum((1 if k % 2 else -1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 41))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(2 * terms, F.lit(1.0)), F.lit(0.0)))


DRAWS = 50  # replicates of a row


def ks_bootstrap(frame: DataFrame, replicates: int = 2000, block: float | None = None, seed: int = 42) -> DataFrame:
    """The same distance with a p-value from block resamples of the series, and Anderson-Darling's statistic; replicates are dealt over tasks, each with a generator of its own."""

    def observed(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("t")["x"].to_numpy()
        n, mu, sd = len(x), x.mean(), x.std(ddof=1)
        phi = np.array([1 - normal_tail((v - mu) / sd) for v in np.sort(x)])
        step = np.arange(1, n + 1) / n
        d = max((step - phi).max(), (phi - step + 1 / n).max())
        tail = np.clip(phi, 1e-300, 1 - 1e-16)
        ad = -n - ((2 * np.arange(1, n + 1) - 1) * (np.log(tail) + np.log(1 - tail[::-1]))).mean()
        return pd.DataFrame({"series": [f["series"].iloc[0]], "n": [n], "ks": [d], "ad": [ad], "ad_critical_5": [AD_BOUND[0] / (1 + AD_BOUND[1] / n + AD_BOUND[2] / n**2)], "x": [x]})

    def beyond(x: np.ndarray, d: float, first: int) -> int:
        n, order = len(x), np.sort(x)
        size = block or max(1, round(n ** (1 / 3)))
        ecdf = np.searchsorted(order, order, side="right") / n
        draws = (x[places(n, size, [seed, i])] for i in range(first, min(first + DRAWS, replicates)))
        return sum(bool(np.abs(np.searchsorted(np.sort(v), order, side="right") / n - ecdf).max() >= d) for v in draws)

    def resampled(frames):
        for f in frames:
            yield f.drop(columns=["x", "first"]).assign(beyond=[beyond(np.asarray(x, float), d, i) for x, d, i in zip(f["x"], f["ks"], f["first"])], drawn=[min(DRAWS, replicates - i) for i in f["first"]])

    facts = "series string, n long, ks double, ad double, ad_critical_5 double"
    rows = frame.groupBy("series").applyInPandas(observed, facts + ", x array<double>").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(DRAWS))))
    rows = rows.repartition(frame.sparkSession.sparkContext.defaultParallelism, "series", "first").mapInPandas(resampled, facts + ", beyond long, drawn long")
    sums = rows.groupBy("series", "n", "ks", "ad", "ad_critical_5").agg(F.sum("beyond").alias("beyond"), F.sum("drawn").alias("replicates"))
    return sums.select("series", "n", "ks", ((1 + F.col("beyond")) / (1 + F.col("replicates"))).alias("p_boot"), "ad", "ad_critical_5", "replicates")


def plug_in_lags(n: int) -> int:
    """Four times n hundredths to the power 2/9, rounded down, and at least 1."""
    return max(1, int(4 * (n / 100) ** (2 / 9)))


def report(frame: DataFrame, replicates: int = 2000) -> DataFrame:
    """All tests of normality of each series in one table: series, test, assumption, statistic and p_value (null where there is none)."""
    moments = with_normal_tails(moment_tests(frame))
    ks = ks_bootstrap(frame, replicates).withColumn("p_iid", ks_pvalue(F.col("ks"), F.col("n")))
    # The labels of the tests and of what they assume.
    iid, robust = F.lit("i.i.d. (invalid here)"), F.lit("dependence-robust")
    row = lambda test, assumption, statistic, p: F.struct(F.lit(test).alias("test"), assumption.alias("assumption"), F.col(statistic).alias("statistic"), p.alias("p_value"))
    first = [row("Jarque-Bera", iid, "jarque_bera", F.col("p_jarque_bera")), row("Bai-Ng joint (HAC)", robust, "stat_joint", F.col("p_joint"))]
    first += [row("Bai-Ng skewness (HAC)", robust, "stat_skew", F.col("p_skew")), row("Bai-Ng kurtosis (HAC)", robust, "stat_kurt", F.col("p_kurt"))]
    bound = F.concat(F.lit("i.i.d.; crit@5%="), F.format_string("%.3f", F.col("ad_critical_5")))
    second = [row("KS vs Normal", iid, "ks", F.col("p_iid")), row("KS vs Normal (block-bootstrap)", robust, "ks", F.col("p_boot")), row("Anderson-Darling", bound, "ad", F.lit(None).cast("double"))]
    parts = (t.select("series", F.inline(F.array(*rows))) for t, rows in ((moments, first), (ks, second)))
    return next(parts).unionByName(next(parts))
