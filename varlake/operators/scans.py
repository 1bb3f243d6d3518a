"""Recursions h' = a h + b along ordered rows, as prefix scans: maps are composed by chunks, chunks by chunks of chunks, and starts handed down again, so no task holds a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 64


def scanned(rows: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows(*keys, t, a, b, start) to keys, t and h: the value before the row's map, start before the first of each key (in the order of t)."""
    w = Window.partitionBy(*keys).orderBy("t")
    own = rows.select(*keys, "t", (F.row_number().over(w) - 1).cast("long").alias("i"), "a", "b")
    starts = rows.groupBy(*keys).agg(F.first("start").alias("start"), F.count("*").alias("n"))
    longest = starts.agg(F.max("n")).first()[0] or 0
    level = own.select(*keys, "i", "a", "b")
    held = []
    while longest > 1:
        # A chunk's maps in order, and the map that they make together.
        each = level.groupBy(*keys, F.floor(F.col("i") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("m"))
        both = F.aggregate("m", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((x["a"] * s["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b")))
        held.append(each)
        level = each.select(*keys, F.col("c").alias("i"), both.alias("f")).select(*keys, "i", "f.a", "f.b")
        longest = -(-longest // chunk)
    values = starts.select(*keys, F.lit(0).cast("long").alias("c"), F.col("start").alias("h"))
    for each in reversed(held):
        step = lambda path, x: F.concat(path, F.array(x["a"] * F.element_at(path, -1) + x["b"]))
        path = F.aggregate(F.slice("m", F.lit(1), F.size("m") - 1), F.array("h"), step)
        values = each.join(values, [*keys, "c"]).select(*keys, F.inline(F.arrays_zip(F.col("m.i").alias("i"), path.alias("h")))).withColumnRenamed("i", "c")
    return own.select(*keys, "t", F.col("i").alias("c")).join(values, [*keys, "c"]).select(*keys, "t", "h")


def last_values(rows: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys and h, the value after the last row's map; rows as given to scanned(), paths its result."""
    after = rows.join(paths, [*keys, "t"]).select(*keys, "t", (F.col("a") * F.col("h") + F.col("b")).alias("next"))
    return after.groupBy(*keys).agg(F.max_by("next", "t").alias("h"))


def affine(spec: Column, e: Column, p: Column) -> tuple[Column, Column]:
    """a and b of a specification's recursion for a deviation e in percent, with parameters p (a map by name); APARCH's is that of the power delta."""
    at = lambda name: F.coalesce(F.try_element_at(p, F.lit(name)), F.lit(0.0))
    omega, alpha, gamma, beta, delta = map(at, ("omega", "alpha[1]", "gamma[1]", "beta[1]", "delta"))
    square = alpha * e * e + F.when((spec == "GJR-GARCH") & (e < 0), gamma * e * e).otherwise(0.0)
    power = alpha * F.pow(F.greatest(F.abs(e) - gamma * e, F.lit(1e-12)), delta)
    return beta, omega + F.when(spec == "APARCH", power).otherwise(square)
