"""The booster's rows as an RDD of column chunks, from which a level of all groups' trees is one short job.

A task sums the gradients of its rows by (group, node, feature, bin), a shuffle by (group, node) adds the tasks' sums up and
chooses each node's split, and only the splits come to the driver. A group's rows lie in as many chunks as they fill.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship_package
from ..streaming.live_bars import new_folder

CHUNK, PARTITION = 4096, 100_000  # rows of a group that stay together; rows of a task
NODES = 1024  # nodes whose bins are laid out at once
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(i: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, each with its own seed."""
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (seeds + P5 + np.uint64(8)) ^ (turned(i.astype(np.uint64) * P2, 31) * P1)
    h = turned(h, 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def packed(names: pa.Array, width: int):
    """A function for mapInArrow() that makes one row of each partition: its columns as arrays, groups by their place in names."""

    def run(batches: Iterable[pa.RecordBatch]):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t["bins"].combine_chunks()
        bins = np.zeros((len(t), width), np.int16)
        bins[np.arange(width) < pc.list_value_length(lists).to_numpy()[:, None]] = lists.flatten().to_numpy()
        g = pc.index_in(t["g"], value_set=names).to_numpy().astype(np.int64)
        chunk = {"g": g, "i": t["i"].to_numpy(), "fit": t["fit"].to_numpy(), "known": pc.is_valid(t["y"]).to_numpy(), "y": t["y"].to_numpy(), "bins": bins, "pred": t["pred"].to_numpy()}
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([pickle.dumps(chunk)], pa.binary())})

    return run


def walked(c: dict, tree: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each row within the level after the tree's, whether it is in a node there, and the value of the last node it was in."""
    place, inside, v, at = np.zeros(len(c["g"]), np.int64), np.ones(len(c["g"]), bool), np.zeros(len(c["g"])), np.arange(len(c["g"]))
    for level, held in enumerate(tree):
        s = held.value
        key = (c["g"] << level) | place
        f = s["f"][key]
        if level == 0:
            v = s["value"][key]
        inside = inside & (f >= 0)
        right = c["bins"][at, np.maximum(f, 0)] > s["bin"][key]
        v = np.where(inside, np.where(right, s["right"][key], s["left"][key]), v)
        place = np.where(inside, 2 * place + right, 0)
    return place, inside, v


def summed(keys: np.ndarray, d: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of d and of n (of ones without it) for each."""
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, d, len(own)), np.bincount(at, n, len(own))


def sums_of(c: dict, level: int, tree: list, facts, draw, width: int, bins: int, parts: int):
    """The chunk's sums of each node, and of each (node, feature, bin), dealt by node over the parts."""
    p, now = facts.value, draw.value
    own = np.flatnonzero(c["fit"] & now["active"][c["g"]])
    own = own[(hashed(c["i"][own], now["salt"][c["g"][own]]) & np.uint64(0xFFFFF)) / 1048576 < p["subsample"][c["g"][own]]]
    c = {k: v[own] for k, v in c.items()}
    place, inside, _ = walked(c, tree)
    g, place, d = c["g"][inside], place[inside], np.where(c["known"], c["pred"] - c["y"], 0.0)[inside]
    if not len(g):
        return
    nodes, at = np.unique((g << level) | place, return_inverse=True)
    node_d, node_n = np.bincount(at, d), np.bincount(at)
    each = now["drawn"][g] & (level < p["max_depth"][g])[:, None]
    keys = ((at[:, None] * width + np.arange(width)) * bins + c["bins"][inside])[each]
    keys, bin_d, bin_n = summed(keys, np.broadcast_to(d[:, None], each.shape)[each])
    owner = keys // (width * bins)
    keys += (nodes[owner] - owner) * (width * bins)
    for r in range(parts):
        mine = nodes % parts == r
        if mine.any():
            of = mine[owner]
            yield r, (nodes[mine], node_d[mine], node_n[mine], keys[of], bin_d[of], bin_n[of])


def best_of(sums: Iterable, level: int, facts, width: int, bins: int, least: float):
    """The best split of each node from all chunks' sums; f is -1 where none gains enough, ties in single precision go to the first feature and bin."""
    got = [s for _, s in sums]
    if not got:
        return
    nodes, d, n = summed(*(np.concatenate([s[k] for s in got]) for k in (0, 1, 2)))
    keys, bin_d, bin_n = summed(*(np.concatenate([s[k] for s in got]) for k in (3, 4, 5)))
    owner = np.searchsorted(nodes, keys // (width * bins))
    for first in range(0, len(nodes), NODES):
        own = slice(first, first + NODES)
        of = slice(*np.searchsorted(owner, (first, first + NODES)))
        p = {k: v[nodes[own] >> level][:, None, None] for k, v in facts.value.items()}
        size = (len(nodes[own]), width, bins)
        dl, nl = np.zeros(size), np.zeros(size)
        at = (owner[of] - first) * (width * bins) + keys[of] % (width * bins)
        dl.reshape(-1)[at], nl.reshape(-1)[at] = bin_d[of], bin_n[of]
        held = nl > 0
        dl, nl = dl.cumsum(2), nl.cumsum(2)
        dn, nn = d[own, None, None], n[own, None, None]
        soft = lambda x: np.sign(x) * np.maximum(np.abs(x) - p["reg_alpha"], 0)  # noqa: E731, B023
        score = lambda x, k: soft(x) ** 2 / (k + p["reg_lambda"])  # noqa: E731, B023
        value = lambda x, k: -soft(x) / (k + p["reg_lambda"])  # noqa: E731, B023
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = score(dl, nl) + score(dn - dl, nn - nl) - score(dn, nn)
            fine = held & (nl >= p["min_child_weight"]) & (nn - nl >= p["min_child_weight"]) & (gain > least)
            gain = np.where(fine, gain, -np.inf).reshape(len(nodes[own]), -1)
            best = gain.astype(np.float32).argmax(1)
            row = np.arange(len(best))
            at = (row, best // bins, best % bins)
            left, right = value(dl, nl)[at], value(dn - dl, nn - nl)[at]
            whole = value(dn, nn)[:, 0, 0]
        found = gain[row, best] > -np.inf
        yield {"key": nodes[own], "f": np.where(found, at[1], -1).astype(np.int32), "bin": at[2].astype(np.int16), "gain": gain[row, best], "value": whole, "left": left, "right": right, "n": n[own].astype(np.int64)}


class Levels:
    """Rows of a booster's state while its trees grow: chunks in memory, whose lineage ends in the shared folder every few trees."""

    def __init__(self, state: DataFrame, parameters: DataFrame, seed: int, bins: int, sizes: list[int], done: int, least: float, held: int):
        self.spark: SparkSession = state.sparkSession
        ship_package(self.spark)
        self.context, self.kind = self.spark.sparkContext, state.schema["g"].dataType.simpleString()
        if self.context.getCheckpointDir() is None:
            self.context.setCheckpointDir(new_folder(self.spark, "levels"))
        self.seed, self.bins, self.sizes, self.done, self.least, self.held = seed, bins, sizes, done, least, held
        own = parameters.join(state.groupBy("g").agg(F.first(F.size("bins")).alias("size")), "g").orderBy("g").toArrow()
        self.names, self.width = own["g"].combine_chunks(), max(sizes, default=1)
        self.facts = {c: own[c].to_numpy() for c in own.column_names if c not in ("g", "n_estimators")}
        self.trees, self.size = own["n_estimators"].to_numpy(), self.facts.pop("size")
        self.parts = max(self.context.defaultParallelism, -(-state.count() // PARTITION))
        rows = state.select("g", "i", "fit", "y", "bins", "pred").repartition(self.parts, "g", F.expr(f"i div {CHUNK}"))
        self.now: RDD = rows.mapInArrow(packed(self.names, self.width), "chunk binary").rdd.map(lambda r: pickle.loads(r[0])).persist()
        self.shared, self.lent, self.last, self.before, self.kept, self.made, self.salts = self.context.broadcast(self.facts), [], [], [], None, [], {}

    def draw(self) -> dict:
        """What the next tree is fitted to: its groups, their seeds of the rows' draw, and the features drawn, which are alike for all groups of as many."""
        if self.done not in self.salts:
            salt = F.transform(F.sequence(F.lit(self.done), F.lit(self.done + self.held - 1)), lambda k: F.xxhash64(F.lit(self.seed), k, F.col("g")))
            table = self.spark.createDataFrame(pa.table({"g": self.names})).select("g", salt.alias("s")).toArrow()
            order = np.argsort(pc.index_in(table["g"], value_set=self.names).to_numpy())
            found = np.array(table["s"].to_pylist(), np.int64).reshape(-1, self.held)[order].astype(np.uint64)
            self.salts = {self.done + k: found[:, k] for k in range(self.held)}
        drawn = np.zeros((len(self.names), self.width), bool)
        for size in self.sizes:
            own = self.size == size
            many = np.maximum(1, (self.facts["colsample_bytree"][own] * size).astype(int))
            drawn[own, :size] = np.random.default_rng([self.seed, self.done, size]).permutation(size) < many[:, None]
        return {"active": self.trees > self.done, "salt": self.salts[self.done], "drawn": drawn}

    def level(self, level: int, tree: list, draw) -> dict | None:
        facts, width, bins, parts, least = self.shared, self.width, self.bins, self.parts, self.least
        sums = self.now.flatMap(lambda c: sums_of(c, level, tree, facts, draw, width, bins, parts))
        got = sums.partitionBy(parts).mapPartitions(lambda own: best_of(own, level, facts, width, bins, least)).collect()
        return {k: np.concatenate([s[k] for s in got]) for k in got[0]} if got else None

    def grow(self) -> None:
        """One more tree for every group that is to have one."""
        draw, tree = self.context.broadcast(self.draw()), []
        for level in range(int(self.facts["max_depth"][self.trees > self.done].max())):
            s = self.level(level, tree, draw)
            if s is None:
                break
            found = s["f"] >= 0
            none = pa.array(~found)
            self.made.append(pa.table({
                "tree": pa.array(np.full(len(found), self.done, np.int32)), "g": self.names.take(pa.array(s["key"] >> level)), "node": pa.array(((s["key"] & ((1 << level) - 1)) + (1 << level) - 1).astype(np.int32)),
                **{c: pc.if_else(none, None, pa.array(s[c])) for c in ("f", "bin", "gain")}, "value": pa.array(s["value"]), **{c: pc.if_else(none, None, pa.array(s[c])) for c in ("left", "right")}, "n": pa.array(s["n"]),
            }))
            table = {c: np.full(len(self.names) << level, -1 if c == "f" else 0, s[c].dtype) for c in ("f", "bin", "value", "left", "right")}
            for c in table:
                table[c][s["key"]] = s[c]
            tree.append(self.context.broadcast(table))
            if not found.any():
                break
        self.done += 1
        self.lent += [draw, *self.last]  # the last tree's tables stay, as the rows' own function names them even where their lineage ends
        self.last = tree
        facts = self.shared
        self.before.append(self.now)
        self.now = self.now.map(lambda c: {**c, "pred": c["pred"] + facts.value["learning_rate"][c["g"]] * walked(c, tree)[2]}).persist()
        if self.done % self.held == 0:
            self.cut()

    def cut(self) -> None:
        """Ends the lineage of the rows; what it led through goes."""
        self.now.checkpoint()
        self.now.count()
        last, self.kept = self.kept, self.now.getCheckpointFile()
        self.release(last)

    def release(self, folder: str | None) -> None:
        for rdd in self.before:
            rdd.unpersist()
        for b in self.lent:
            b.destroy()
        self.before, self.lent = [], []
        if folder:
            path = self.context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.context._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Takes away what is held, once predictions() are written."""
        self.before.append(self.now)
        self.lent += [*self.last, self.shared]
        self.release(self.kept)

    def predictions(self) -> DataFrame:
        names = self.context.broadcast(self.names.to_pylist())
        rows = self.now.flatMap(lambda c: zip((names.value[g] for g in c["g"]), c["i"].tolist(), c["pred"].tolist()))
        return self.spark.createDataFrame(rows, f"g {self.kind}, i long, pred double", verifySchema=False)
