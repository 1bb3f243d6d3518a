"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows.

A window counts as a copy of an item if their bags of five-word shingles have a weighted similarity (sum of least
counts over sum of greatest counts) of the threshold or more. Windows are as long as the item, and so share at least
2t/(1+t) of its shingles: only places with that many shingles of items are fingerprinted, which loses nothing.
Fingerprints meet the items' in multi-index Hamming blocks: of PARTS blocks of 16 bits, one differs in at most
radius / PARTS bits if the whole does in at most radius, so probing every block of a window to that distance finds all
fingerprints within the radius. Candidates within it are verified on the shingles themselves.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship_package
from . import text
from .storage import staged

PARTS, PART_BITS = 4, 16
RADIUS = 19  # similarity 0.8 gives 9.7 differing bits of 64 on average, with a deviation of 2.9
ITEM_BYTES = 32 << 20  # of item texts that are broadcast at once; more items go in several rounds
WINDOWS, WINDOW_BITS = 512, 1 << 24  # windows that are fingerprinted at once, and bits of their shingles, about


def simhash(bags: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of shingle hashes: each bit by the majority."""
    bits = np.unpackbits(np.ascontiguousarray(bags).view(np.uint8).reshape(*bags.shape, 8), axis=2, bitorder="little")
    high = 2 * bits.sum(axis=1, dtype=np.int32) > bags.shape[1]
    return np.packbits(high, axis=1, bitorder="little").view("<u8").reshape(len(bags))


class Blocks:
    """A multi-index of fingerprints by the value of each of PARTS blocks of their bits, probed to a distance of radius // PARTS."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.radius, self.prints = radius, prints
        self.masks = np.array([sum(1 << b for b in on) for d in range(radius // PARTS + 1) for on in combinations(range(PART_BITS), d)], np.uint16)
        own = prints.view(np.uint16).reshape(-1, PARTS)
        self.orders = [np.argsort(own[:, j], kind="stable") for j in range(PARTS)]
        self.firsts = [np.searchsorted(own[o, j], np.arange((1 << PART_BITS) + 1)) for j, o in enumerate(self.orders)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """All pairs (window, item) of fingerprints within the radius, and how many pairs the blocks let through to the comparison of all bits."""
        own, found = prints.view(np.uint16).reshape(-1, PARTS), []
        for j, (order, first) in enumerate(zip(self.orders, self.firsts)):
            # Either the blocks near a window's are looked up, or, for few items, all items' blocks are compared with the window's.
            if len(self.prints) > len(self.masks):
                probe = own[:, j, None] ^ self.masks[None, :]
                low, many = first[probe], first[probe.astype(np.int64) + 1] - first[probe]
                w = np.repeat(np.repeat(np.arange(len(own)), len(self.masks)), many.ravel())
                ends = np.cumsum(many.ravel())
                at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many.ravel(), many.ravel()) + np.repeat(low.ravel(), many.ravel())
                found.append(w * len(self.prints) + order[at])
            else:
                other = self.prints.view(np.uint16).reshape(-1, PARTS)[:, j]
                found.append(np.flatnonzero(np.bitwise_count(own[:, j, None] ^ other[None, :]) <= self.radius // PARTS))
        pair = np.unique(np.concatenate(found))
        w, i = np.divmod(pair, max(1, len(self.prints)))
        fine = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        return w[fine], i[fine], len(pair)


class Items:
    """The items' shingles, by size in words."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, k: int, radius: int):
        self.k, self.threshold = k, threshold
        column = pa.array(texts, pa.string())
        data, offsets = text.flat_bytes(column)
        data = text.lowered(data)
        starts, ends, first = text.word_bounds(data, offsets)
        h = text.word_hashes(data, starts, ends)
        full = text.grams(h, k)
        sizes = defaultdict(list)
        self.short = defaultdict(dict)  # items of fewer words than a shingle: their one sequence, exactly
        for i, a, b in zip(ids, first, first[1:]):
            if b - a >= k:
                sizes[int(b - a)].append((i, full[a : b - k + 1]))
            elif b > a:
                self.short[int(b - a)].setdefault(int(text.grams(h[a:b], int(b - a))[0]), []).append(i)
        self.sizes = {}
        for n, own in sizes.items():
            self.sizes[n] = ([i for i, _ in own], [Counter(s.tolist()) for _, s in own], Blocks(simhash(np.stack([s for _, s in own])), radius))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for own in sizes.values() for _, s in own)]))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places whose shingle occurs in an item."""
        at = np.flatnonzero(self.filter[(g >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        place = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
        return at[self.known[place] == g[at]]

    def found(self, column: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """For each text its (item, similarity, first word, word after the last)."""
        data, offsets = text.flat_bytes(column)
        data = text.lowered(data)
        starts, ends, first = text.word_bounds(data, offsets)
        h = text.word_hashes(data, starts, ends)
        out: list[list] = [[] for _ in range(len(column))]
        for n, own in self.short.items():
            g = text.grams(h, n)
            for p in np.flatnonzero(np.isin(g, np.array(list(own), np.uint64))):
                d = int(np.searchsorted(first, p, side="right")) - 1
                if p + n <= first[d + 1]:
                    out[d] += [(i, 1.0, int(p - first[d]), int(p - first[d]) + n) for i in own[int(g[p])]]
        g = text.grams(h, self.k)
        at = self.hits(g)
        at = at[at + self.k <= first[np.searchsorted(first, at, side="right")]] if len(at) else at
        if not len(at):
            return out
        for n, (ids, bags, blocks) in self.sizes.items():
            width = n - self.k + 1
            need = ceil(2 * self.threshold / (1 + self.threshold) * width - 1e-9)
            # Windows that start at p hold the hits in [p, p + width); the need-th hit from a hit tells where p can be.
            if len(at) < need:
                continue
            span = at[need - 1 :] - at[: len(at) - need + 1]
            ok = np.flatnonzero(span < width)
            places = {p for i in ok for p in range(int(at[i + need - 1]) - width + 1, int(at[i]) + 1)}
            best: dict[tuple[int, int], tuple[float, int]] = {}
            p = np.array(sorted(places), np.int64)
            p = p[p >= 0]
            d = np.searchsorted(first, p, side="right") - 1
            inside = p + n <= first[d + 1]
            p, d = p[inside], d[inside]
            step = max(1, min(WINDOWS, WINDOW_BITS // (64 * width)))
            for a in range(0, len(p), step):
                windows = g[p[a : a + step, None] + np.arange(width)]
                row, bag = -1, Counter()
                for w, c in zip(*(x.tolist() for x in blocks.near(simhash(windows))[:2])):
                    if w != row:
                        row, bag = w, Counter(windows[w].tolist())
                    q, t = int(p[a + w]), int(d[a + w])
                    same = sum((bag & bags[c]).values())
                    value = same / (2 * width - same)
                    if value >= self.threshold and (-value, q) < best.get((t, c), (0.0, 0)):
                        best[t, c] = (-value, q)
            for (t, c), (value, q) in best.items():
                out[t].append((ids[c], -value, int(q - first[t]), int(q - first[t]) + n))
        return out


MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def with_matches(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = RADIUS,
    text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """docs.* as a struct `row` and `matches`, an array of struct(item_id, similarity, start, end) with the best window of each item in words, one row for each row of docs.

    Words are parted by ASCII white space, with A-Z in lower case. An item of fewer than k words matches its very word sequence.
    Items of a null id or without words and null or empty texts match nothing; each row is judged by its own text; an empty
    side gives no matches; of windows that are alike the first counts. Items are broadcast up to item_bytes of text; beyond,
    the rows are written once for each part of the items that has that size, with the matches so far.
    """
    spark = docs.sparkSession
    own = items.select(F.col(f"`{item_id_column}`").cast("long").alias("id"), F.col(f"`{item_text_column}`").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // item_bytes) or 1
    ship_package(spark)

    def finder(part: int):
        rows = sorted(tuple(r) for r in own.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).collect())
        sent = spark.sparkContext.broadcast((tuple(r[0] for r in rows), tuple(r[1] for r in rows)))
        held: dict[str, Items] = {}

        @F.arrow_udf("array<struct<item_id: long, similarity: double, start: int, end: int>>")
        def find(texts: pa.Array) -> pa.Array:
            index = held.get("index") or held.setdefault("index", Items(*sent.value, threshold, k, radius))
            made = []
            for batch in text.chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
                made += [[dict(zip(("item_id", "similarity", "start", "end"), m)) for m in sorted(f)] for f in index.found(batch.column("text"))]
            return pa.array(made, MATCH)

        return find

    # The text goes along under a name of its own until the last part, so columns of any name may be in the row.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    words = F.col("row")[text_column]
    rows = rows.select("row", finder(0)(words).alias("matches"))
    for part in range(1, parts):
        rows = staged(rows, "matches")
        rows = rows.select("row", F.array_sort(F.concat("matches", finder(part)(words))).alias("matches"))
    return rows


def find_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Columns doc_id and matches of with_matches(), one row for each row of docs; repeated ids and null ids stay rows of their own."""
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return with_matches(slim, items, **options).select("row.doc_id", "matches")


def decontaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    clean = with_matches(docs, items, text_column=text_column, **options).where(F.size("matches") == 0)
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))
