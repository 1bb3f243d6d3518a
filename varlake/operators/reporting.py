"""Tables of coefficients(model, model_type, parameter, coef, std_err, t_stat, p_value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import stars

# Parameters in their order in tables, and the parameter of asymmetry.
PARAMETERS = ("mu", "omega", "alpha[1]", "gamma[1]", "beta[1]", "phi", "d", "beta", "delta", "eta", "nu", "lambda")
ASYMMETRY = "gamma[1]"


def param_table(coefficients: DataFrame, marks: bool = True) -> DataFrame:
    out = coefficients.select("model", "parameter", "coef", "std_err", "t_stat", "p_value")
    return out.withColumn("stars", stars(F.col("p_value"))) if marks else out


def param_matrix(coefficients: DataFrame, parameters: list[str], decimals: int = 4, show: str = "std_err") -> DataFrame:
    """A cell `coef*** (se)` for each model and parameter, blank where a model lacks it."""
    if show not in ("std_err", "t_stat", "p_value"):
        raise ValueError(f"show must be std_err, t_stat or p_value, not {show!r}")
    number = lambda c: F.format_string(f"%.{decimals}f", c)
    cell = F.concat(number(F.col("coef")), stars(F.col("p_value")), F.lit(" ("), number(F.col(show)), F.lit(")"))
    return coefficients.select("model", "parameter", cell.alias("cell")).groupBy("model").pivot("parameter", parameters).agg(F.first("cell")).na.fill("")


def pvalue_matrix(coefficients: DataFrame, parameters: list[str], decimals: int | None = 4) -> DataFrame:
    p = F.col("p_value") if decimals is None else F.bround("p_value", decimals)
    return coefficients.select("model", "parameter", p.alias("p")).groupBy("model").pivot("parameter", parameters).agg(F.first("p"))


def asymmetry(coefficients: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for each model: its asymmetry coefficient and whether it differs from zero."""
    own = F.col("parameter") == ASYMMETRY
    pick = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    out = coefficients.groupBy("model").agg(F.bool_or(own).alias("has_asymmetry"), *map(pick, ("coef", "std_err", "t_stat", "p_value")))
    out = out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    verdict = F.when(~F.col("has_asymmetry"), "no asymmetry parameter estimated").when(F.col("significant"), "leverage effect supported").otherwise("not distinguishable from 0 -> effectively symmetric")
    return out.withColumn("verdict", verdict)


def asymmetry_counts(rows: DataFrame) -> DataFrame:
    """Of the rows of asymmetry(): how many models there are, how many have the parameter, and of how many it differs from zero."""
    return rows.agg(F.count("*").alias("n_models"), F.count_if("has_asymmetry").alias("n_asymmetric"), F.count_if("significant").alias("n_significant"))


def ordered_parameters(coefficients: DataFrame) -> DataFrame:
    """The parameters that occur, with their place: those of PARAMETERS in its order, unknown ones behind by name."""
    place = F.array_position(F.lit(list(PARAMETERS)), F.col("parameter"))
    by = Window.orderBy(F.when(place > 0, place).otherwise(len(PARAMETERS) + 1), "parameter")
    return coefficients.select("parameter").distinct().select("parameter", F.row_number().over(by).cast("long").alias("place"), (place > 0).alias("known"))


def persistence(coefficients: DataFrame) -> DataFrame:
    """The measure of persistence that suits each specification, and its value; null for models without a closed form."""
    at = lambda name: F.max(F.when(F.col("parameter") == name, F.col("coef")))
    out = coefficients.groupBy("model", "model_type").agg(at("alpha[1]").alias("a"), at("beta[1]").alias("b"), at("gamma[1]").alias("g"), at("d").alias("d"))
    kind = F.col("model_type")
    measure = F.when(kind == "GARCH", "alpha+beta").when(kind == "GJR-GARCH", "alpha+beta+gamma/2").when(kind == "EGARCH", "beta (log-variance AR)").when(kind == "FIGARCH", "d (long memory)").otherwise("n/a (no closed form)")
    value = F.when(kind == "GARCH", F.col("a") + F.col("b")).when(kind == "GJR-GARCH", F.col("a") + F.col("b") + 0.5 * F.coalesce("g", F.lit(0.0))).when(kind == "EGARCH", F.col("b")).when(kind == "FIGARCH", F.col("d"))
    return out.select("model", measure.alias("measure"), value.alias("value"))


def information_criteria(fits: DataFrame) -> DataFrame:
    """AIC and BIC of loglik, k (parameters) and n."""
    k, n, ll = F.col("k"), F.col("n"), F.col("loglik")
    return fits.select("*", (2 * k - 2 * ll).alias("aic"), (k * F.ln(n) - 2 * ll).alias("bic"))


def asymmetry_order(model_type: Column, dist_order: Column) -> Column:
    """The order given, or the specification's own: 1 for GJR, EGARCH and APARCH."""
    return F.coalesce(dist_order, F.when(model_type.isin("GJR-GARCH", "EGARCH", "APARCH"), 1).otherwise(0))


def fitted(coefficients: DataFrame) -> DataFrame:
    """The rows of the models that were fitted: a model none of whose coefficients is a number is left out of all tables."""
    known = F.col("coef").isNotNull() & ~F.isnan("coef")
    return coefficients.withColumn("known", F.some(known).over(Window.partitionBy("model"))).where("known").drop("known")


# The symbols of the error distributions.
ERRORS = {"normal": r"\mathcal{N}(0,1)", "t": r"t_{\nu}", "ged": r"\mathrm{GED}(\nu)"}


def equations(coefficients: DataFrame, decimals: int = 4) -> DataFrame:
    """model and lines, an array of LaTeX: the name, the mean, the variance with its estimated terms and nu if there is one. The distribution is the last part of the name."""
    own = fitted(coefficients).groupBy("model", "model_type").agg(F.map_from_entries(F.collect_list(F.struct("parameter", "coef"))).alias("p"))
    value = lambda name: F.try_element_at("p", F.lit(name))
    number = lambda c: F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c)).otherwise("nan")
    signed = lambda c: F.concat(F.when(c < 0, "- ").otherwise("+ "), number(F.abs(c)))
    omega, alpha, gamma, delta, phi, d = map(value, ("omega", "alpha[1]", "gamma[1]", "delta", "phi", "d"))
    beta = F.coalesce(value("beta[1]"), value("beta"))
    dist = F.lower(F.regexp_extract("model", r"([^-]+)(?:-o[0-9]+)?$", 1))
    error = dist
    for name, symbol in ERRORS.items():
        error = F.when(dist == name, symbol).otherwise(error)
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    if_any = lambda c, *parts: F.when(c.isNotNull(), text(*parts)).otherwise("")
    past, level = r"\varepsilon_{t-1}", r"\sigma_{t-1}"
    plain = text(r"\sigma_t^2 = ", number(omega), " + ", number(alpha), rf"\,{past}^2", if_any(gamma, " ", signed(gamma), rf"\,{past}^2\,\mathbb{{1}}_{{\{{{past} < 0\}}}}"), " + ", number(beta), rf"\,{level}^2")
    logs = text(r"\ln \sigma_t^2 = ", number(omega), " + ", number(alpha), r"\left(|z_{t-1}| - \mathbb{E}|z_{t-1}|\right)", if_any(gamma, " ", signed(gamma), r"\,z_{t-1}"), " + ", number(beta), rf"\,\ln {level}^2")
    inner = F.when(gamma.isNotNull(), text(rf"\left(|{past}| ", signed(-gamma), rf"\,{past}\right)")).otherwise(rf"|{past}|")
    power = text(r"\sigma_t^{", number(delta), "} = ", number(omega), " + ", number(alpha), r"\,", inner, "^{", number(delta), "} + ", number(beta), rf"\,{level}^{{", number(delta), "}")
    memory = text(r"\sigma_t^2 = ", number(omega), " + ", number(beta), rf"\,{level}^2 + \left[1 - ", number(beta), "L - (1 - ", number(phi), "L)(1-L)^{", number(d), r"}\right]\varepsilon_t^2")
    kind = F.col("model_type")
    variance = F.when(kind.isin("GARCH", "GJR-GARCH"), plain).when(kind == "EGARCH", logs).when(kind == "APARCH", power).when(kind == "FIGARCH", memory).otherwise(r"\text{(unrecognised specification)}")
    mean = text("r_t = ", number(value("mu")), r" + \varepsilon_t, \qquad \varepsilon_t = \sigma_t z_t, \qquad z_t \sim ", error)
    nu = value("nu")
    lines = F.array(text(r"\textbf{", F.col("model"), "}"), mean, variance, F.when(nu.isNotNull(), text(r"\nu = ", number(nu))))
    return own.select("model", F.filter(lines, lambda x: x.isNotNull()).alias("lines"))
