"""Words, hashes and windows of many texts at once, as flat numpy arrays over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, types as T

from ..shipping import ship_package

# The white space that parts words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
CHUNK_BYTES = 2 << 20
LONG_WORD = 256

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64; changes h in place."""
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes one after the other, with 8 bytes of padding, and the offsets of the texts. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw
    return out, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, which the bytes of `apart` part, and for each text the index of its first word (one more at the end)."""
    n = int(offsets[-1])
    inside = ~apart[data[:n]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    head, tail = edges[edges < n], edges[edges > 0] - 1
    first[head] |= inside[head]
    last[tail] |= inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _A
    if not len(h):
        return h
    h ^= lanes[starts] & _MASKS[np.minimum(size, 8)]
    mixed(h)
    at, rest = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        x = h[at]
        x ^= lanes[starts[at] + rest] & _MASKS[np.minimum(size[at] - rest, 8)]
        x += _A
        h[at] = mixed(x)
        rest += 8
        at = at[size[at] > rest]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the sequence a then b."""
    out = a * _A
    out += b
    return mixed(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours, len(h) - k + 1 of them; runs over the edge of a text are for the caller to leave out."""
    out, covered, power, width = None, 0, h, 1
    while True:
        if k & width:
            out = power if out is None else joined(out[: max(0, len(h) - covered - width + 1)], power[covered : covered + max(0, len(h) - covered - width + 1)])
            covered += width
        width *= 2
        if width > k:
            return out
        half = width // 2
        power = joined(power[: max(0, len(power) - half)], power[half:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    done = 1
    while done < width and len(x):
        step = min(done, width - done)
        x = np.minimum(x[: max(0, len(x) - step)], x[step:])
        done += step
    return x


def shingles(column: pa.Array, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles at all places of all texts that have k words."""
    data, offsets = flat_bytes(column)
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    g = grams(word_hashes(data, starts, ends), k)
    inside = np.zeros(len(g) + k, bool)
    for a, b in zip(first, first[1:]):
        inside[a : max(a, b - k + 1)] = True
    return g[inside[: len(g)]]


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sorted distinct hashes of its k-word shingles (words in lower case A-Z; fewer words: the whole sequence as one; none: empty), one after the other, and their offsets."""
    data, offsets = flat_bytes(column)
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    full = grams(h, k)
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(h)) + k <= first[1:][text]) if len(h) else np.zeros(0, np.int64)
    values, owner = full[at], text[at]
    short = np.flatnonzero((n > 0) & (n < k))
    extra = np.empty(len(short), np.uint64)
    for j, i in enumerate(short):
        x = h[first[i] : first[i] + 1].copy()
        for w in range(first[i] + 1, first[i + 1]):
            x = joined(x, h[w : w + 1])
        extra[j] = x[0] ^ np.uint64(n[i])
    values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def unpacked(column: pa.Array) -> pa.Array:
    """The texts that packed() has compressed."""
    read = zstandard.ZstdDecompressor().decompress
    return pa.array([read(x) for x in column.to_pylist()], pa.binary()).cast(pa.large_string())


def compressed(column: pa.Array) -> pa.Array:
    """The texts compressed one by one, null as empty."""
    write = zstandard.ZstdCompressor(level=3).compress
    return pa.array([write((x or "").encode()) for x in column.to_pylist()], pa.binary())


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the texts compressed one by one, null as empty: for shuffles, which only find repeats within a block of short ones."""

    def run(batches):
        for batch in chunks(batches, column):
            made = compressed(batch.column(column))
            yield pa.RecordBatch.from_arrays([made if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)

    kinds = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema])
    return mapped(df, run, kinds)


def mapped(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
