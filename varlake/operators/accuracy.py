"""Pairwise tests of predictive accuracy over losses(series, model, model_ord, t, loss): one shuffle join and one aggregation for all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import family
from ..functions.special import t_two_sided


def pair_differences(losses: DataFrame) -> DataFrame:
    """d = loss_i - loss_j of each pair of models and each t; an equi-join on series and t with the order of models as its residue."""
    a = losses.select("series", "t", F.col("model").alias("model_i"), F.col("model_ord").alias("ord_i"), F.col("loss").alias("loss_i"))
    b = losses.select("series", "t", F.col("model").alias("model_j"), F.col("model_ord").alias("ord_j"), F.col("loss").alias("loss_j"))
    return a.join(b, ["series", "t"]).where("ord_i < ord_j").select("series", "t", "model_i", "model_j", (F.col("loss_i") - F.col("loss_j")).alias("d"))


def corrected_statistic(mean: Column, variance: Column, n: Column, h: int) -> Column:
    """The small-sample corrected statistic; null where both losses are equal."""
    scale = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return F.try_divide(mean, F.sqrt(variance)) * scale


def compare(losses: DataFrame, h: int = 1, circular: bool = True) -> DataFrame:
    """series, model_i, model_j, n, mean_d, stat of all pairs with i before j.

    For h > 1, autocovariances up to h - 1 take part; circular ones wrap around the sample's end. Where the long-run
    variance isn't positive, the plain one stands in."""
    d = pair_differences(losses)
    keys = ["series", "model_i", "model_j"]
    if h == 1:
        stats = d.groupBy(keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), (F.var_pop("d") / F.count("*")).alias("variance"))
    else:
        pair = Window.partitionBy(*keys)
        order = pair.orderBy("t")
        rows = d.withColumn("c", F.col("d") - F.avg("d").over(pair)).withColumn("rank", F.row_number().over(order))
        for k in range(1, h):
            behind = F.lag("c", k).over(order)
            if circular:
                ends = F.sort_array(F.collect_list(F.when(F.col("rank") > F.count("*").over(pair) - k, F.struct("rank", "c"))).over(pair))
                behind = F.coalesce(behind, F.get(ends, F.col("rank") - 1)["c"])
            rows = rows.withColumn(f"c{k}", F.col("c") * behind)
        total = F.avg(F.col("c") * F.col("c")) + 2 * sum(F.sum(f"c{k}") / F.count("*") for k in range(1, h))
        plain = F.avg(F.col("c") * F.col("c"))
        stats = rows.groupBy(keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), (F.when(total > 0, total).otherwise(plain) / F.count("*")).alias("variance"))
    return stats.select(*keys, "n", "mean_d", corrected_statistic(F.col("mean_d"), F.col("variance"), F.col("n"), h).alias("stat"))


def with_pvalues(pairs: DataFrame) -> DataFrame:
    """pval, two-sided, and the better model at 5 %, if any."""
    out = pairs.withColumn("pval", t_two_sided(F.col("stat"), F.col("n") - 1))
    better = F.when(F.col("pval") < 0.05, F.when(F.col("stat") < 0, F.col("model_i")).otherwise(F.col("model_j")))
    return out.withColumn("better", better)


def family_split(pairs: DataFrame, p: str = "pval", alpha: float = 0.05, family_of=family) -> DataFrame:
    """Within and between families: significant and all pairs, their rate, and the significant pairs by p."""
    rows = pairs.where(F.col(p).isNotNull()).withColumn("same_family", family_of(F.col("model_i")) == family_of(F.col("model_j")))
    hit = F.col(p) < alpha
    found = F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct(p, "model_i", "model_j")))), lambda s: F.concat_ws("|", s["model_i"], s["model_j"]))
    return rows.groupBy("series", "same_family").agg(F.count_if(hit).alias("n_significant"), F.count("*").alias("n_total"), F.avg(hit.cast("double")).alias("rate"), found.alias("pairs"))


def rejection_degrees(pairs: DataFrame, p: str = "pval", alpha: float = 0.05) -> DataFrame:
    """How many significant pairs each model is in."""
    return pairs.where(F.col(p) < alpha).select("series", F.explode(F.array("model_i", "model_j")).alias("model")).groupBy("series", "model").agg(F.count("*").alias("degree"))


def pair_matrix(pairs: DataFrame, value: str, models: list[str]) -> DataFrame:
    """The upper triangle as a table; models are given, so that no job finds them."""
    return pairs.groupBy("series", "model_i").pivot("model_j", models).agg(F.first(value))
