"""Boosted regression trees for many groups at once, grown level by level with aggregates and joins.

A group is whatever has trees of its own: a series, a refit block, a tuning trial. One aggregation sums the gradients of all
groups by (group, node, feature, bin), windows over the bins give each node's best split, and a join sends the rows to their
children. Rows that aren't fitted (a holdout, times to be forecast) travel along, so that all predictions are there in the
end. Trees are rows too: a row for each node with its split, gain and value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..streaming.live_bars import new_folder
from .tree_levels import Levels

# The booster's default parameters.
DEFAULTS = {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 5.0, "reg_alpha": 0.1, "reg_lambda": 1.0}
BINS = 64
LEAST_GAIN = 1e-6
SMALL = 50_000  # rows of splits that may go by way of the driver; more are written to the shared folder
MANY = 4  # times as many nodes may be in all of a level's trees where rows stay in memory, as their splits are plain arrays there
HELD = 10  # trees after which their nodes are written
SPLIT = ("f", "bin", "value", "left", "right")  # what sends a row on from a node


def written(frame: DataFrame, kind: str) -> DataFrame:
    """The frame as a table in the session's shared folder."""
    path = new_folder(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def deleted(frame: DataFrame) -> None:
    """Takes away the files of a table that written() has made and nobody reads any more."""
    context = frame.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def with_parameters(groups: DataFrame, given: dict | None = None) -> DataFrame:
    """groups(g, ...) with a column for each parameter that it lacks, from those given or the defaults."""
    more = {**DEFAULTS, **(given or {})}
    unknown = set(more) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return groups.select("*", *(F.lit(v).alias(k) for k, v in more.items() if k not in groups.columns))


def bin_edges(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """g and edges, for each feature the distinct values at the quantiles of its fitted rows, from mergeable summaries."""
    levels = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    each = rows.where("fit").select("g", F.posexplode("x").alias("f", "v"))
    own = each.groupBy("g", "f").agg(F.array_distinct(F.percentile_approx("v", levels, 20 * bins)).alias("e"))
    return own.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "e"))), lambda s: s["e"]).alias("edges"))


@dataclass
class Forest:
    """rows(g, i, fit, y, pred, ...) with all trees' predictions, trees(tree, g, node, f, bin, gain, value, n) and edges(g, edges)."""

    rows: DataFrame
    trees: DataFrame
    edges: DataFrame


class Booster:
    """Boosting of rows(g, i, fit, x, y): i numbers a group's rows, x are the features, y is read where fit; groups holds parameters for each g."""

    def __init__(self, rows: DataFrame, groups: DataFrame, seed: int = 42, bins: int = BINS):
        self.spark: SparkSession = rows.sparkSession
        self.seed, self.bins, self.done, self.parts, self.tables = seed, bins, 0, [], []
        self.lent: DataFrame | None = None
        self.parameters = written(with_parameters(groups).select("g", *(F.col(k).cast("double").alias(k) for k in DEFAULTS)), "parameters")
        self.edges = written(bin_edges(rows, bins), "edges")
        start = rows.where("fit").groupBy("g").agg(F.avg("y").alias("pred"))
        own = rows.join(self.edges, "g").join(self.parameters.select("g", "subsample", "colsample_bytree", "learning_rate", "n_estimators"), "g").join(start, "g")
        place = F.zip_with("x", "edges", lambda v, e: F.size(F.filter(e, lambda t: t < v)).cast("short"))
        drawn = F.greatest(F.lit(1), (F.col("colsample_bytree") * F.size("x")).cast("int")).alias("drawn")
        first = own.select("g", F.col("i").cast("long").alias("i"), "fit", F.col("y").cast("double").alias("y"), place.alias("bins"), drawn, "subsample", "learning_rate", "n_estimators", "pred")
        self.state = written(self.sampled(first), "boosted")
        self.sizes = [r[0] for r in self.state.select(F.size("bins")).distinct().collect()]  # how many features there are, mostly one number
        self.groups, depth = self.parameters.agg(F.count("*"), F.max("max_depth")).first()
        self.depth = int(depth or 0)
        if self.groups <= SMALL:
            self.parameters = self.spark.createDataFrame(self.parameters.toArrow(), self.parameters.schema)

    def sampled(self, rows: DataFrame) -> DataFrame:
        """rows with sampled: whether the next tree is fitted to the row."""
        draw = f"pmod(xxhash64({self.seed}, {self.done}, g, i), 1048576) / 1048576D < subsample"
        return rows.withColumn("sampled", F.expr(f"fit AND n_estimators > {self.done} AND {draw}"))

    def small(self, level: int) -> bool:
        return self.groups * 2**level <= SMALL

    def merged(self, nodes: dict, splits: pa.Table) -> DataFrame:
        """g and nodes, a map of all splits of the tree so far by their node, kept in `nodes`; one row for each group, so that a level reads one table for all levels before it."""
        for g, *rest in zip(*(splits.column(c).to_pylist() for c in ("g", "node", *SPLIT))):
            nodes.setdefault(g, []).append((rest[0], dict(zip(SPLIT, rest[1:]))))
        split = pa.struct([splits.schema.field(c) for c in SPLIT])
        table = pa.table({"g": pa.array(nodes, splits.schema.field("g").type), "nodes": pa.array(nodes.values(), pa.map_(splits.schema.field("node").type, split))})
        return self.spark.createDataFrame(table)

    def moved(self, rows: DataFrame, tree: DataFrame | None, levels: int) -> DataFrame:
        """rows with the node that they are in after that many levels of their group's tree, -1 where they stay in a leaf, and its value v (0 without a tree)."""
        rows = rows.selectExpr("*", "0 AS node", "0D AS v")
        if tree is None:
            return rows
        keep = [c for c in rows.columns if c not in ("node", "v")]
        rows = rows.join(F.broadcast(tree) if self.small(levels - 1) else tree, "g", "left")
        for level in range(levels):
            rows = rows.selectExpr(*keep, "nodes", "node", "v", "try_element_at(nodes, node) AS s").selectExpr(
                *keep, "nodes", "CASE WHEN s.f IS NULL THEN -1 WHEN bins[s.f] > s.bin THEN 2 * node + 2 ELSE 2 * node + 1 END AS node",
                f"CASE WHEN s.f IS NULL THEN {'v' if level else 'coalesce(s.value, v)'} WHEN bins[s.f] > s.bin THEN s.right ELSE s.left END AS v",
            )
        return rows.drop("nodes")

    def level(self, rows: DataFrame, level: int) -> DataFrame:
        """g, node, f, bin, gain, value, left, right and n of the nodes that rows are in; f is null where no split gains enough.

        Gains are compared in single precision, ties go to the first feature and bin: a lag and its square often part the same rows, and the order of the sums must not choose between them.
        The sums of each bin meet by (g, node), so that the running sums over bins, the best split of each node and its choice need no other exchange.
        The condition on node is no filter, as a filter would be laid on the scan with the whole walk through the tree in it."""
        score = "pow(signum({0}) * greatest(abs({0}) - reg_alpha, 0D), 2) / ({1} + reg_lambda)".format
        value = "-signum({0}) * greatest(abs({0}) - reg_alpha, 0D) / ({1} + reg_lambda)".format
        fine = f"nl >= min_child_weight AND n - nl >= min_child_weight AND {level} < max_depth"
        hint = "/*+ BROADCAST(p) */" if self.groups <= SMALL else ""
        return self.spark.sql(
            f"""
            WITH e AS (SELECT g, node, drawn, draw, pred - y AS d, posexplode(CASE WHEN taken AND node >= 0 THEN bins END) AS (f, bin) FROM {{rows}}),
            s AS (SELECT g, node, f, bin, sum(d) AS d, count(*) AS n FROM e WHERE draw[f] < drawn GROUP BY g, node, f, bin),
            r AS (SELECT /*+ REPARTITION(g, node) */ * FROM s),
            w AS (SELECT {hint} r.g, node, f, bin, reg_alpha, reg_lambda, min_child_weight, max_depth, sum(d) OVER u AS dl, sum(n) OVER u AS nl, sum(d) OVER a AS d, sum(n) OVER a AS n FROM r JOIN {{parameters}} p ON p.g = r.g
              WINDOW u AS (PARTITION BY r.g, node, f ORDER BY bin), a AS (PARTITION BY r.g, node, f)),
            k AS (SELECT *, CASE WHEN {fine} THEN {score("dl", "nl")} + {score("(d - dl)", "(n - nl)")} - {score("d", "n")} END AS gain FROM w),
            b AS (SELECT g, node, max(struct(CASE WHEN gain > {LEAST_GAIN}D THEN CAST(gain AS FLOAT) END AS place, -f AS f, -bin AS bin, gain, {value("d", "n")} AS value, {value("dl", "nl")} AS left, {value("(d - dl)", "(n - nl)")} AS right, n AS n)) AS s FROM k GROUP BY g, node)
            SELECT g, node, CASE WHEN s.place IS NOT NULL THEN -s.f END AS f, CASE WHEN s.place IS NOT NULL THEN -s.bin END AS bin, CASE WHEN s.place IS NOT NULL THEN s.gain END AS gain, s.value, s.left, s.right, s.n FROM b""",
            rows=rows, parameters=self.parameters,
        )

    def grow(self) -> None:
        """One more tree for every group that is to have one. The rows are written after each tree, so that plans don't grow with the trees."""
        # The place of each feature in this tree's draw, which is alike for all groups of as many features.
        order = {size: np.random.default_rng([self.seed, self.done, size]).permutation(size).tolist() for size in self.sizes}
        draw = "CASE size(bins) " + " ".join(f"WHEN {size} THEN array({', '.join(map(str, own))})" for size, own in order.items() if size) + " END"
        fitted = self.state.where("sampled").selectExpr("g", "y", "pred", "bins", "drawn", "true AS taken", f"{draw} AS draw")
        nodes, made, tree = {}, [], None
        for level in range(self.depth):
            splits = self.level(self.moved(fitted, tree, level), level)
            if self.small(level):
                table = splits.toArrow()
                if len(table):  # an empty batch would end the stream that the tables are read from
                    self.tables.append(table.append_column("tree", pa.array([self.done] * len(table), pa.int32())))
                made.append(table)
                tree = self.merged(nodes, table)
            else:
                held = [m if isinstance(m, DataFrame) else self.spark.createDataFrame(m, splits.schema) for m in made]
                made = [*held, written(splits, "splits")]
                self.parts.append(made[-1].withColumn("tree", F.lit(self.done)))
                every = made[0]
                for more in made[1:]:
                    every = every.unionByName(more)
                tree = written(every.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(*SPLIT)))).alias("nodes")), "nodes")
        keep = [c for c in self.state.columns if c not in ("pred", "sampled")]
        grown = self.moved(self.state, tree, self.depth).selectExpr(*keep, "pred + learning_rate * v AS pred")
        self.done += 1
        self.go_on(self.sampled(grown))
        if self.done % HELD == 0:
            self.trees_so_far()

    def grow_to(self, most: int) -> None:
        """All trees up to that many, for groups whose trees' splits may go by way of the driver: what grow() makes, from rows that stay in memory until the last tree."""
        levels = Levels(self.state, self.parameters, self.seed, self.bins, self.sizes, self.done, LEAST_GAIN, HELD)
        while levels.done < most:
            levels.grow()
            if levels.done == most or sum(map(len, levels.made)) > SMALL:
                self.parts.append(written(self.spark.createDataFrame(pa.concat_tables(levels.made)), "trees"))
                levels.made = []
        self.done = most
        keep = [c for c in self.state.columns if c not in ("pred", "sampled")]
        self.go_on(self.sampled(self.state.select(*keep).join(levels.predictions(), ["g", "i"])))
        levels.close()

    def go_on(self, rows: DataFrame) -> None:
        """Writes the rows as the new state, whose forerunner goes unless run() has returned it."""
        before, self.state = self.state, written(rows, "boosted")
        if before is not self.lent:
            deleted(before)

    def trees_so_far(self) -> DataFrame:
        """All trees' nodes as one table."""
        if self.tables:
            self.parts.append(self.spark.createDataFrame(pa.concat_tables(self.tables)))
            self.tables = []
        if len(self.parts) > 1:
            out = self.parts[0]
            for part in self.parts[1:]:
                out = out.unionByName(part)
            self.parts = [written(out, "trees")]
        return self.parts[0]

    def keep(self, groups: DataFrame) -> None:
        """Goes on with these groups only."""
        self.go_on(self.state.join(groups, "g", "left_semi"))
        self.groups = self.state.agg(F.count_distinct("g")).first()[0]

    def run(self, trees: int | None = None) -> Forest:
        """Grows the trees that the groups ask for, or up to that many in all."""
        most = int(self.state.agg(F.max("n_estimators")).first()[0] or 0)
        most = most if trees is None else min(trees, most)
        if self.done < most and self.groups * 2**self.depth <= MANY * SMALL:
            self.grow_to(most)
        while self.done < most:
            self.grow()
        self.lent = self.state
        return Forest(self.state, self.trees_so_far() if self.parts or self.tables else None, self.edges)


def importances(trees: DataFrame) -> DataFrame:
    """g, f, gain (the mean over the feature's splits), importance (its share of all features' mean gains) and place, the highest first."""
    own = trees.where("f IS NOT NULL").groupBy("g", "f").agg(F.avg("gain").alias("gain"), F.count("*").alias("n_splits"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("g"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("gain"), "f"))
    return own.select("g", "f", "n_splits", "gain", share.alias("importance"), place.cast("long").alias("place"))
