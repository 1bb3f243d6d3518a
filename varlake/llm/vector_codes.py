"""Vectors compressed to codes: each part of a vector is named by the nearest entry of its codebook, in integers throughout.

The vectors are staged as columnar blocks, all rows' first component first, so distances accumulate dimension by dimension
over whole columns. Each round is an RDD.treeAggregate over these blocks: np.add.at adds the parts to int64 tensors of sums
and counts, which merge through a reduction tree, so the driver gets one pair of tensors of the codebooks' size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text
from .storage import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096  # rows of a block
LIMIT = 1 << 26  # scaled components are below it, so that squares of 512 differences fit 64 bits


def whole_vector(x: Column) -> Column:
    """Whether a vector has no null or non-finite component and isn't null itself."""
    return x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def scaled(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component; one out of LIMIT is an error."""
    whole = lambda e: F.floor(e.cast("double") * scale)
    return F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) < LIMIT - 1, whole(e).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more"))))


def columns_of(vectors: pa.Array) -> np.ndarray:
    """The vectors as a matrix of a row for each dimension."""
    n = len(vectors)
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T) if n else np.zeros((0, 0), np.int32)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (ties to the lower one) and squared distance of each column of part (dimensions by rows)."""
    distance = np.zeros((len(book), part.shape[1]), np.int64)
    for j in range(len(part)):
        gap = book[:, j, None] - part[j].astype(np.int64)[None, :]
        gap *= gap
        distance += gap
    code = distance.argmin(axis=0)
    return code, distance[code, np.arange(part.shape[1])]


def added(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums (part, entry, dimension) and counts (part, entry) with those of a block (dimensions by rows) added in place."""
    sums, counts = total
    for p, part in enumerate(np.split(block, len(books))):
        code, _ = nearest(part, books[p])
        np.add.at(sums[p], code, part.T.astype(np.int64))
        np.add.at(counts[p], code, 1)
    return total


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, dimension) of rows(vec_id, v): they start as the parts of the smallest ids and move `rounds` times; unused entries stay."""
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    width = books.shape[0] * books.shape[2]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                block = columns_of(batch.column("v").slice(a, BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([block.astype(np.int32).tobytes()], pa.binary())], ["block"])

    blocks = staged(text.mapped(rows.select("v"), run, "block binary"), "vector_blocks")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        zero = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        step = lambda total, row, sent=sent: added(total, np.frombuffer(row["block"], np.int32).reshape(width, -1), sent.value)
        sums, counts = blocks.rdd.treeAggregate(zero, step, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        sent.destroy()
    return books


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error of each row whose vector is whole, and the codebooks).

    Vectors null, or with a null or non-finite component, are left out. code has two hex digits for each part's entry, error
    is the sum of the parts' squared distances, label_error the sum of the errors of all rows of an equal label, nulls
    together. Repeated ids are rows of their own; a null id comes last among those that the codebooks start from. With fewer
    rows than entries there are fewer entries; an empty table gives no rows and empty codebooks. Vectors of unlike length,
    of a length that the number of parts doesn't divide, or with a component out of range are a ValueError or fail the job.
    Other columns aren't read."""
    x = F.col(f"`{vector_column}`")
    rows = embeddings.where(whole_vector(x)).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), scaled(x, scale).alias("v"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if least is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    if least != most or most % parts or not most:
        raise ValueError(f"vectors of {least} to {most} components can't be cut into {parts} equal parts")
    books = fit_codebooks(rows.select("vec_id", "v"), parts, entries, rounds)
    sent = embeddings.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(entries)])

    def run(batches):
        for batch in batches:
            found = [nearest(part, book) for part, book in zip(np.split(columns_of(batch.column("v")), parts), sent.value)] if batch.num_rows else []
            codes = ["".join(c) for c in zip(*(digits[code].tolist() for code, _ in found))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(e for _, e in found) if found else [], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = staged(text.mapped(rows, run, schema), "vector_codes")
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' integers in order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
