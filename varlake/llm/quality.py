"""A quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), so that the pairwise part costs no
more than the linear one. Inputs come from the text alone: each distinct word weighs its count over the root of the text's
words. Features are made where the texts are; only those of the bounded sample of labelled rows go to the driver, which fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship_package
from . import text

HASHED = 1 << 16
FACTORS = 8
SAMPLE = 20_000  # labelled rows at most that are fitted to, the first by a hash of the id
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.01, 1e-4
SEED = 7

_UPPER, _DIGIT, _MARKS, _LETTER, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
_HIGH[128:] = True
_MARKS[33:127] = ~(_LETTER | _DIGIT)[33:127]
STATS = ("log_words", "log_chars", "word_bytes", "upper", "digits", "marks", "not_ascii", "log_lines", "repeated_next", "distinct", "longest_word", "pipes", "marks_doubled", "distinct_lines", "empty")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words (index, value) of all texts one after the other, the texts' offsets in them, and a matrix of the structure statistics."""
    data, offsets = text.flat_bytes(column)
    low = text.lowered(data)
    starts, ends, first = text.word_bounds(low, offsets)
    h = text.word_hashes(low, starts, ends)
    n, size = np.diff(first), np.diff(offsets)
    raw = data[:-8]

    def share(mask: np.ndarray, per: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(per, 1)

    same_next = np.zeros(len(h), bool)
    same_next[1:] = h[1:] == h[:-1]
    same_next[first[:-1][n > 0]] = False
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.flatnonzero(new)
    index = (h[order][at] >> np.uint64(48)).astype(np.int32)
    held = owner[order][at]
    value = (np.diff(np.append(at, len(h))) / np.sqrt(np.maximum(n, 1))[held]).astype(np.float32)
    marks = _MARKS[raw]
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = marks[1:] & (raw[1:] == raw[:-1])
    longest = np.zeros(len(n))
    if len(h):
        longest[n > 0] = np.maximum.reduceat(ends - starts, first[:-1][n > 0])
    lines = share(raw == 10, np.ones(len(n)), offsets)
    # Lines as sums of their words' hashes: the same line again has the same sum.
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    heads = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(h, heads) if len(h) else h
    by = owner[heads]
    o = np.lexsort((sums, by))
    fresh = np.ones(len(sums), bool)
    fresh[1:] = (sums[o][1:] != sums[o][:-1]) | (by[o][1:] != by[o][:-1])
    full, distinct = (np.bincount(x, minlength=len(n)) for x in (by, by[o][fresh]))
    stats = np.stack([
        np.log1p(n), np.log1p(size), share(np.ones(len(raw), bool), n, offsets), share(_UPPER[raw], size, offsets), share(_DIGIT[raw], size, offsets), share(marks, size, offsets),
        share(_HIGH[raw], size, offsets), np.log1p(lines), share(same_next, n, first), np.bincount(held, minlength=len(n)) / np.maximum(n, 1), np.log1p(longest), share(raw == 124, n, offsets),
        share(doubled, size, offsets), distinct / np.maximum(full, 1), (n == 0).astype(float),
    ], axis=1)
    return index, value, np.searchsorted(held, np.arange(len(n) + 1)), stats


class Machine:
    """The fitted model; rows are hashed words and standardised statistics."""

    def __init__(self, stats: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        size = HASHED + stats.shape[1]
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)

    def rows(self, index, value, first, stats):
        """Words and statistics of each text as one run of (index, value), with the runs' heads and owners."""
        n, m = np.diff(first), stats.shape[1]
        at = first[:-1] + m * np.arange(len(n))
        owner = np.repeat(np.arange(len(n)), n + m)
        place = np.arange(len(owner)) - at[owner]
        idx, val = np.empty(len(owner), np.int32), np.empty(len(owner), np.float32)
        word = place >= m
        idx[word], val[word] = index, value
        idx[~word] = HASHED + place[~word]
        val[~word] = np.clip((stats - self.mean) / self.std, -5, 5).ravel()
        return idx, val, at, owner

    def raw(self, idx, val, at):
        """Scores before the sigmoid, and the factors' sums."""
        if not len(at):
            return np.zeros(0), np.zeros((0, FACTORS))
        linear = np.add.reduceat(self.w[idx] * val, at, dtype=np.float64)
        pair, sums = np.zeros(len(at)), np.empty((len(at), FACTORS))
        for f in range(FACTORS):
            x = self.v[idx, f] * val
            sums[:, f] = np.add.reduceat(x, at, dtype=np.float64)
            pair += 0.5 * (sums[:, f] ** 2 - np.add.reduceat(x * x, at, dtype=np.float64))
        return self.w0 + linear + pair, sums

    def score(self, index, value, first, stats) -> np.ndarray:
        idx, val, at, _ = self.rows(index, value, first, stats)
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, at)[0], -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, first: np.ndarray, stats: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Machine:
    """A machine fitted by Adam to the logistic loss over features(), which stay as they are; the same for the same rows in the order given."""
    machine = Machine(stats[rows])
    size = len(machine.w)
    rng = np.random.default_rng(SEED)
    slots = [np.zeros((size, 1 + FACTORS), np.float32) for _ in range(2)]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    machine.w0 = float(np.log(share / (1 - share)))
    step = 0
    for _ in range(EPOCHS):
        order = rows[rng.permutation(len(rows))]
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            n = np.diff(first)[own]
            ends = np.cumsum(n)
            words = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[own], n)
            idx, val, at, owner = machine.rows(index[words], value[words], np.concatenate([[0], ends]), stats[own])
            z, sums = machine.raw(idx, val, at)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[order[a : a + BATCH]]) / len(own)
            used, where = np.unique(idx, return_inverse=True)
            e = err[owner] * val
            grad = np.empty((len(used), 1 + FACTORS), np.float32)
            grad[:, 0] = np.bincount(where, weights=e, minlength=len(used))
            for f in range(FACTORS):
                grad[:, 1 + f] = np.bincount(where, weights=e * (sums[owner, f] - machine.v[idx, f] * val), minlength=len(used))
            grad[:, 0] += DECAY * machine.w[used]
            grad[:, 1:] += DECAY * machine.v[used]
            step += 1
            m, s = (x[used] for x in slots)
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad * grad
            slots[0][used], slots[1][used] = m, s
            move = RATE * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            machine.w[used] -= move[:, 0]
            machine.v[used] -= move[:, 1:]
            machine.w0 -= 0.05 * float(err.sum())
    return machine


def held_out(id_column):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Machine | None:
    """The machine of the labelled rows that aren't held out; None if there is none. At most `sample` rows are fitted to, chosen by a hash of the id; the bound keeps the driver's share fixed. Of an id's rows one is fitted to, the least by a hash of its text."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text_"))
    marks = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id_")).agg(F.max(label_column).cast("int").alias("label_"))
    chosen = marks.where(~held_out(F.col("id_"))).orderBy(F.xxhash64("id_"), "id_").limit(sample)

    def run(batches):
        for batch in text.chunks(batches, "text_"):
            index, value, first, stats = features(batch.column("text_"))
            lists = (pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in (index, value))
            wide = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), stats.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("label_"), batch.column("row_"), *lists, wide], ["id_", "label_", "row_", "index", "value", "stats"])

    # The chosen ids are bounded by `sample`, so they are broadcast and the texts stay where they are.
    labelled = rows.join(F.broadcast(chosen), "id_").withColumn("row_", F.xxhash64("text_"))
    made = text.mapped(labelled, run, "id_ long, label_ int, row_ long, index array<int>, value array<float>, stats array<double>")
    own = F.struct("row_", "label_", "index", "value", "stats")
    found = made.groupBy("id_").agg(F.min(own).alias("own")).select("id_", "own.*").drop("row_").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found.column("id_").to_numpy())
    index, value, stats = (found.column(c).combine_chunks() for c in ("index", "value", "stats"))
    labels_, first = found.column("label_").to_numpy().astype(float), index.offsets.to_numpy().astype(np.int64)
    del found
    machine = fit(index.values.to_numpy(), value.values.to_numpy(), first, stats.flatten().to_numpy().reshape(len(order), -1), labels_, order)
    del index, value, stats
    pa.default_memory_pool().release_unused()  # the driver lives on
    return machine


def scorer(spark: SparkSession, machine: Machine | None):
    """A function of columns: the score of a text, from 0 to 1; null counts as empty, and without a machine all scores are 0.5."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own, out = sent.value, [np.zeros(0)]
        for part in text.chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
            out.append(own.score(*features(part.column("text"))) if own else np.full(part.num_rows, 0.5))
        return pa.array(np.concatenate(out), pa.float64())

    return score


def score_quality(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold), one row for each row of docs.

    Null counts as the empty text, which is scored by its statistics; without a machine (no labels) all scores are 0.5.
    Repeated rows stay; other columns aren't read.
    """
    doc = F.col(f"`{id_column}`").cast("long")
    scored = docs.select(doc.alias("doc_id"), scorer(docs.sparkSession, machine)(F.col(f"`{text_column}`")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text has a score of the threshold or more, with their columns; each row is judged by its own text, so nothing is shuffled. Without a machine all rows stay."""
    return docs.where(scorer(docs.sparkSession, machine)(F.col(f"`{text_column}`")) >= threshold) if machine else docs
