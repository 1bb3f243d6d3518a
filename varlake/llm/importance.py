"""Importance resampling towards a target: documents are drawn by how much more likely their n-grams are in the target's texts.

The n-gram strings of all texts are counted in one dictionary. A task first counts the distinct strings of a slice of texts;
these go, compressed in order, to the parts of the dictionary that a hash names, and a part unites its slices' strings,
hashes each distinct one once and adds its count to its bucket. The longest n-grams go where the n-gram without their last
word goes, so that only that word is sent; those of a start that more than HOT words follow in a slice are dealt by their
whole string, so no part grows with a frequent start (of such strings, which few slices may deal otherwise, a part's sums
are added as all sums are). The buckets' gains, of which there is a fixed
number, are then joined to the feature counts of each document, whose distinct strings are looked up slice by slice.

Words of a slice, and the dictionary's strings, are told apart by 64-bit hashes (and the strings' sizes).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship_package
from . import text
from .storage import default_parallelism, staged

ORDERS, BUCKETS = 3, 10_000
SLICE_BYTES, PART_BYTES = 4 << 20, 2 << 20  # text of a slice, and text that a part of the dictionary stands for, about
HOT = 64  # words that follow the start of the longest n-grams in a slice, from which these are dealt by their whole string
LONG = 256  # bytes from which strings are hashed one by one

# The ASCII bytes that part words, all but digits and letters.
APART = np.zeros(256, bool)
APART[:128] = True
APART[0x30:0x3A] = APART[0x61:0x7B] = False


def _crc_table(bits: int) -> np.ndarray:
    """What the crc32 of a register makes of its lowest bits, all at once."""
    table = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_ONE, _TWO = _crc_table(8), _crc_table(16)


def crc32s(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, all runs' next two bytes at a time."""
    order = np.argsort(-size, kind="stable")
    at, n = begin[order].astype(np.int64), size[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-n, -LONG))  # those before are longer
    left = np.searchsorted(-n, -np.arange(LONG), side="left")  # of each place, how many runs go on there
    pairs = np.ndarray((max(0, len(data) - 1),), "<u2", buffer=data, strides=(1,)) if len(data) > 1 else np.zeros(0, np.uint16)
    for j in range(1, int(n[first]) if first < len(n) else 0, 2):
        own = value[first : left[j]]
        value[first : left[j]] = _TWO[(own ^ pairs[at[first : left[j]] + (j - 1)]) & np.uint32(0xFFFF)] ^ (own >> np.uint32(16))
    odd = first + np.flatnonzero(n[first:] & 1)
    value[odd] = _ONE[(value[odd] ^ data[at[odd] + n[odd] - 1]) & np.uint32(255)] ^ (value[odd] >> np.uint32(8))
    value = ~value
    for i in range(first):
        value[i] = zlib.crc32(data[at[i] : at[i] + n[i]].tobytes())
    out = np.empty_like(value)
    out[order] = value
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct keys: one place of each, its count, and for each place which of them it has."""
    order = np.argsort(keys)
    head = np.ones(len(keys), bool)
    head[1:] = keys[order][1:] != keys[order][:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return order[at], np.diff(np.append(at, len(keys))), which


def runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of bytes, one after the other."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)  # a slice or a part has less than 2 GB
    at += np.repeat((begin - (ends - size)).astype(np.int32), size)
    return data[at]


class Features:
    """The n-grams of a slice of texts: words in lower case A-Z, joined by one space.

    data holds the words so joined; for each order there are the distinct n-grams, as runs of data (begin, size) with their
    counts and a hash; the words that begin one, and which of the distinct ones each of these is; and for each distinct one
    which of the order below it starts with, and where its last word begins."""

    def __init__(self, column: pa.Array, orders: int = ORDERS):
        low, offsets = text.flat_bytes(column)
        low = text.lowered(low)
        starts, ends, first = text.word_bounds(low, offsets, APART)
        self.first, self.words, size = first, np.diff(first), ends - starts
        place = np.cumsum(size + 1) - (size + 1)
        self.data = np.full(int((size + 1).sum()) + 8, 32, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[place + size] = inside[-8:] = False
        self.data[inside] = runs(low, starts, size)
        del inside
        owner = np.repeat(np.arange(len(self.words)), self.words)
        h = text.word_hashes(low, starts, ends)
        _, _, word = distinct(h)
        n_words = int(word.max(initial=0)) + 1
        self.orders, longer, running, prior = [], word, h, word
        for k in range(1, orders + 1):
            if k > 1:
                # The n-gram from word i is the one of an order less from i and then word i + k - 1.
                prior = longer
                longer = longer[:-1] * n_words + word[k - 1 :]
                running = text.joined(running[:-1], h[k - 1 :])
            at = np.flatnonzero(np.arange(len(longer)) + k <= first[1:][owner[: len(longer)]]) if len(longer) else np.zeros(0, np.int64)
            one, count, which = distinct(longer[at])
            i = at[one]
            made = (place[i], place[i + k - 1] + size[i + k - 1] - place[i], count, running[i], at, which, prior[i], place[i + k - 1])
            self.orders.append(tuple(x if x.dtype == np.uint64 else x.astype(np.int32) for x in made))
            if k < orders and len(longer) > 1:
                full = np.zeros(len(longer), np.int64)  # places that cross a text's end are never looked at
                full[at] = which
                longer = full
            elif len(longer) <= 1:
                longer, running = longer[:0], running[:0]

    def dealt(self, parts: int) -> list[tuple[int, bytes, bytes]]:
        """(part, strings, counts) of the slice's distinct n-grams. A string ends with a line end, which no word has; one that begins with a tab is the last word of an n-gram whose start is the last string before that doesn't."""
        part_of = lambda h: ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        begin, size, count, h = (np.concatenate([o[j] for o in self.orders]) for j in range(4))
        part, tail, group = part_of(h), np.zeros(len(h), bool), np.full(len(h), len(h), np.int32)
        if len(self.orders) > 1:
            n = len(self.orders[-1][0])
            start, low = self.orders[-1][6], len(h) - n - len(self.orders[-2][0])
            group[low:-n or None] = np.arange(len(h) - n - low)
            own = np.flatnonzero(np.bincount(start, minlength=1)[start] <= HOT) if n else np.zeros(0, np.int64)
            at = len(h) - n + own
            part[at], tail[at], group[at] = part[low + start[own]], True, start[own]
            word = self.orders[-1][7][own]  # where the last word begins, after a space that the tab replaces
            begin[at], size[at] = word - 1, begin[at] + size[at] - word + 1
        order = np.argsort(2 * (part * (len(h) + 1) + group) + tail)
        cuts = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        pack, out = zstandard.ZstdCompressor(level=1).compress, []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[p] : cuts[p + 1]]
            flat, ends = runs(self.data, begin[own], size[own] + 1), np.cumsum(size[own] + 1)
            flat[ends - 1] = 10
            flat[(ends - size[own] - 1)[tail[own]]] = 9
            out.append((p, pack(flat.tobytes()), pack(count[own].astype(np.uint32).tobytes())))
        return out

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature count and summed gains of each text."""
        n, total = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for begin, size, _, _, at, which, _, _ in self.orders:
            upto = np.append(0, np.cumsum(gains[crc32s(self.data, begin, size) % len(gains)][which]))
            edge = np.searchsorted(at, self.first)
            n += np.diff(edge)
            total += upto[edge[1:]] - upto[edge[:-1]]
        return n, total


def united(rows: pa.Table, buckets: int) -> pa.Table:
    """A part of the dictionary: the distinct strings of its slices, each hashed once, as sums of counts by bucket."""
    read = zstandard.ZstdDecompressor().decompress
    flat = np.frombuffer(b"".join(read(x) for x in rows.column("strings").to_pylist()), np.uint8)
    count = np.concatenate([np.frombuffer(read(x), np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    ends = np.flatnonzero(flat == 10)
    begin = np.append(0, ends[:-1] + 1)
    tail = flat[begin] == 9
    head = np.maximum.accumulate(np.where(tail, 0, np.arange(len(ends))))
    begin, size = begin + tail, ends - begin - tail
    # Each string is its start, if it is a last word, with the line end after it as the space, and its own run.
    both = np.stack([np.where(tail, size[head] + 1, 0), size], axis=1)
    flat = runs(flat, np.stack([begin[head], begin], axis=1).ravel(), both.ravel())
    flat[flat == 10] = 32
    size = both.sum(axis=1)
    begin = np.cumsum(size) - size
    h = text.word_hashes(np.append(flat, np.zeros(8, np.uint8)), begin, begin + size)
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1])
    heads = np.flatnonzero(new)
    one = order[heads]
    sums = np.zeros(buckets, np.int64)
    np.add.at(sums, crc32s(flat, begin[one], size[one]) % buckets, np.add.reduceat(count[order], heads))
    at = np.flatnonzero(sums)
    return pa.table({"bucket": at, "n": sums[at]})


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS, text_column: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket, repeats counted, by way of the dictionary of their strings."""
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{text_column}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(default_parallelism(spark), -(-size // PART_BYTES))

    def run(batches):
        for batch in text.chunks(batches, size=SLICE_BYTES):
            dealt = Features(batch.column("text"), orders).dealt(parts)
            for a in range(0, len(dealt), 64):
                part, strings, counts = zip(*dealt[a : a + 64])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(strings, pa.binary()), pa.array(counts, pa.binary())], ["part", "strings", "counts"])

    blobs = text.mapped(rows, run, "part long, strings binary, counts binary")
    sums = blobs.groupBy("part").applyInArrow(lambda t: united(t, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), with one added to each bucket's count."""
    size = len(source)
    more, less = (target + 1.0) * (source.sum() + size), (source + 1.0) * (target.sum() + size)
    return np.floor(1000 * np.log(more / less)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, orders: int = ORDERS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in text.chunks(batches, "text_", SLICE_BYTES):
            own = Features(batch.column("text_"), orders)
            n, weight = own.weights(sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), *map(pa.array, (own.words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    cols = docs.select(F.col(f"`{id_column}`").cast("long").alias("id_"), F.col(f"`{text_column}`").alias("text_"))
    return text.mapped(cols, run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: int, of: int) -> DataFrame:
    """row_ and rank of the floor(share * n / of) rows(row_, score, doc_id) of the highest scores, ties to smaller ids.

    Rows are sorted into ranges and written; the ranges' sizes, one number each, tell the rank at which a range begins, so only the ranges that hold drawn rows are ordered."""
    spark: SparkSession = rows.sparkSession
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row_")]
    ranges = staged(rows.repartitionByRange(default_parallelism(spark), *by).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = {r["range_"]: r["count"] for r in ranges.groupBy("range_").count().collect()}  # a row for each partition
    drawn, before, firsts = share * sum(sizes.values()) // of, 0, []
    for part in sorted(sizes):
        if before < drawn:
            firsts.append((part, before))
        before += sizes[part]
    begin = spark.createDataFrame(firsts, "range_ int, before long")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("range_").orderBy(*by)) + F.col("before")
    return ranges.join(F.broadcast(begin), "range_").withColumn("rank", place.cast("long")).where(F.col("rank") <= drawn).select("row_", "rank")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 5, of: int = 100, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, orders: int = ORDERS,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
) -> DataFrame:
    """Columns doc_id, n_features, weight, score and rank (null where not drawn), one row for each row of docs.

    weight is the sum of the gains of a text's n-grams, score adds Gumbel noise that the seed and the id determine, and the
    floor(share * n / of) highest scores among the n texts of `least_words` words or more are drawn, so that texts are drawn
    without replacement in proportion to exp(weight / 1000). Ties go to the smaller id. Null and empty texts have no
    features and a weight of 0; a null id takes part, last among ties, with the noise of an empty id; repeated ids are rows
    of their own with equal noise. With an empty table or target all gains of it count as those of no features. Other
    columns aren't read."""
    gains = gains_of(bucket_counts(docs, buckets, orders, text_column), bucket_counts(target, buckets, orders, target_column))
    rows = weighed(docs, gains, orders, id_column, text_column)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = staged(rows.withColumn("score", F.col("weight") + noise).withColumn("row_", F.monotonically_increasing_id()), "weights")
    drawn = ranked(rows.where(F.col("n_words") >= least_words).select("row_", "score", "doc_id"), share, of)
    return rows.join(drawn, "row_", "left").select("doc_id", "n_features", "weight", "score", "rank")
