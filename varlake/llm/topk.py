"""Exact top-k by inner product: every candidate is scored, term at a time.

Queries are broadcast in waves of bounded size, one job after the other, and rows stay where they are; a task keeps the k best
of each query, so only these are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import text
from .storage import staged

QUERY_BLOCK, ROW_BLOCK = 256, 8192
WAVE_CELLS = 2_000_000  # components of the queries of a wave, about


def integer_vectors(embeddings: DataFrame, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; vectors null or with a null or non-finite component are left out."""
    x = F.col(f"`{vector_column}`")
    fine = x.isNotNull() & F.col(f"`{id_column}`").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return embeddings.where(fine).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all query rows against all rows: each term's postings are weighted and scattered into the dense score array.

    Terms' postings are the rows with a weight other than 0; where nearly all rows have one, the whole column is added.
    Arithmetic is in 64-bit integers, or 32-bit ones where no sum can leave them.
    """
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.int32 if most < 2**31 else np.int64
    scores = np.zeros((len(queries), len(rows)), kind)
    q, r = queries.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    step = 1024
    for a in range(0, len(rows), step):
        part = scores[:, a : a + step]
        acc, tmp = np.zeros(part.shape, kind), np.empty(part.shape, kind)
        for t in range(q.shape[1]):
            weights, postings = q[:, t], r[t, a : a + step]
            on, at = np.flatnonzero(weights), np.flatnonzero(postings)
            if 4 * len(on) < 3 * len(weights) or 4 * len(at) < 3 * len(postings):
                if len(on) and len(at):
                    acc[np.ix_(on, at)] += np.multiply.outer(weights[on], postings[at])
            else:
                np.multiply(weights[:, None], postings[None, :], out=tmp)
                acc += tmp
        part[...] = acc
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, by partition selection."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        tied = np.flatnonzero(scores == edge)
        if len(tied) > k - len(above):
            tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]
        at = np.concatenate([above, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The k best rows so far of each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # a row of a lower score isn't among the k

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        width = min(self.queries.shape[1], rows.shape[1])
        for a in range(0, len(self.ids), QUERY_BLOCK):
            scores = accumulate(self.queries[a : a + QUERY_BLOCK, :width], rows[:, :width])
            for j in np.flatnonzero(scores.max(axis=1) >= self.least[a : a + QUERY_BLOCK]):
                q, own = a + j, np.flatnonzero((scores[j] >= self.least[a + j]) & (ids != self.ids[a + j]))
                held, vec = (np.concatenate(x) for x in zip(self.found[q], (scores[j][own].astype(np.int64), ids[own])))
                at = best(held, vec, self.k)
                self.found[q] = held[at], vec[at]
                if len(at) == self.k:
                    self.least[q] = held[at[-1]]

    def rows(self) -> pa.RecordBatch:
        score, vec = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.found) if self.found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, [len(s) for s, _ in self.found]), pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding", wave_cells: int = WAVE_CELLS) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id and score: for each vector whose id is divisible by `every`, the k other rows of highest integer inner product, ties to the smaller id; all, if there are fewer.

    Vectors null, or with a null or non-finite component, take no part; vectors of unlike length score over the shorter length.
    Repeated ids count as rows of their own, though none is a candidate for a query of its own id; of the vectors of a
    repeated query id the least asks. An empty table gives no rows; other columns aren't read.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings, scale, id_column, vector_column)
    queries = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    waves = -(-(queries.agg(F.sum(F.size("v"))).first()[0] or 0) // wave_cells) or 1

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scored(wave: int) -> DataFrame:
        """A wave's best rows as a table, written before the next wave's queries are sent, so the driver and the tasks hold one wave at a time."""
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), matrix(own.column("v").combine_chunks())))
        del own

        def run(batches):
            kept = Best(*sent.value, k)
            for batch in batches:
                for a in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(a, ROW_BLOCK)
                    kept.add(part.column("vec_id").to_numpy(), matrix(part.column("v")))
            yield kept.rows()

        found = text.mapped(rows, run, "query_id long, vec_id long, score long")
        out = staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        sent.destroy()
        return out

    out = scored(0)
    for wave in range(1, waves):
        out = out.unionByName(scored(wave))
    return out
