"""Passages that recur across documents, by sharded Aho-Corasick automata.

Equal windows of `window` words have equal minimal runs of `phrase` words (winnowing), so a window can only recur where its
minimal phrase does. Phrases found in several documents are confirmed by a count; each belongs to the smallest document
that holds it, its owner, whose hash names the phrase's shard. Every document that holds a phrase of a shard goes there,
where the phrases are compiled into an automaton that locates all their occurrences. All documents that share a window
meet in the shard of its minimal phrase, so the first holder of each window is known there.

A shard with many documents is salted: owners go to all its salts, and windows whose first holder within a salt isn't an
owner are compared across the salts in a second round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship_package
from . import text
from .storage import default_parallelism, staged

WINDOW, PHRASE = 50, 8
SHARD_PHRASES = 10_000  # phrases of one automaton, about
SALT_WORDS = 400_000  # words of documents that a salt of a shard holds, about


def minimal_phrases(column: pa.Array, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of the distinct phrases that are minimal in a window of their text, and the texts' words."""
    data, offsets = text.flat_bytes(column)
    starts, ends, first = text.word_bounds(data, offsets)
    h = text.word_hashes(data, starts, ends)
    n = np.diff(first)
    least = text.sliding_min(text.grams(h, phrase), window - phrase + 1)
    owner = np.repeat(np.arange(len(n)), n)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= first[1:][owner]) if len(least) else np.zeros(0, np.int64)
    value, owner = least[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new], n


def automaton(words: list[list[bytes]], hashes: list[np.ndarray], wanted: list[set[int]], phrase: int):
    """An Aho-Corasick automaton of the wanted phrases of the owners' words; None if there is none. Bytes stand as Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for own, h, want in zip(words, hashes, wanted):
        if want:
            g = text.grams(h, phrase)
            for p in np.flatnonzero(np.isin(g, np.fromiter(want, np.uint64, len(want)))):
                found.add_word(f" {b' '.join(own[p : p + phrase]).decode('latin-1')} ", 0)
    if not len(found):
        return None
    found.make_automaton()
    return found


def located(machine, words: list[bytes], phrase: int) -> np.ndarray:
    """The first words of all occurrences of the automaton's phrases."""
    hay = f" {b' '.join(words).decode('latin-1')} "
    ends = np.fromiter((e for e, _ in machine.iter(hay)), np.int64)
    edges = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    return np.searchsorted(edges, ends) - phrase + 1


def first_holders(rows: pa.Table, window: int, phrase: int) -> pa.Table:
    """Of the documents of one salt of a shard: the starts of windows that a smaller document of it holds, and the windows (hash and start) of which a document that owns nothing is the first holder."""
    rows = rows.combine_chunks()
    column = text.unpacked(rows.column("text"))
    docs, rows_ = rows.column("doc").to_numpy(), rows.column("row").to_numpy()
    own = [set(np.array(x, np.int64).view(np.uint64).tolist()) if x else set() for x in rows.column("own").to_pylist()]
    data, offsets = text.flat_bytes(column)
    starts, ends, first = text.word_bounds(data, offsets)
    h = text.word_hashes(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b].split() for a, b in zip(offsets, offsets[1:])]
    machine = automaton(*zip(*[(w, h[a:b], o) for w, a, b, o in zip(words, first, first[1:], own) if o]), phrase) if any(own) else None
    salted = bool(rows.num_rows) and rows.column("salts")[0].as_py() > 1
    none = pa.table({"doc": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int32())), "open": pa.array([], pa.list_(pa.struct([("w", pa.int64()), ("s", pa.int32())])))})
    if machine is None:
        return none
    edge = np.zeros(len(h) + 1, np.int32)  # where runs of window starts that hold a phrase begin and end
    for w, a, b in zip(words, first, first[1:]):
        if b - a >= window:
            at = a + located(machine, w, phrase)
            low, high = np.maximum(at + phrase - window, a), np.minimum(at, b - window)
            fine = low <= high
            np.add.at(edge, low[fine], 1)
            np.add.at(edge, high[fine] + 1, -1)
    s = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    g = text.grams(h, window)[s]
    at = np.searchsorted(first, s, side="right") - 1
    order = np.lexsort((docs[at], g))
    g, s, at = g[order], s[order], at[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    run = np.cumsum(head) - 1
    leader = docs[at[head]][run]
    owner = np.array([bool(o) for o in own])
    held = np.zeros(head.sum(), bool)  # windows of which an owner is a first holder
    np.logical_or.at(held, run, (docs[at] == leader) & owner[at])
    gone = docs[at] > leader
    left = (docs[at] == leader) & ~held[run] if salted else np.zeros(len(g), bool)
    by = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[by], np.arange(len(own) + 1))
    out = {"doc": [], "row": [], "starts": [], "open": []}
    for i in np.unique(at[gone | left]):
        mine = by[cuts[i] : cuts[i + 1]]
        hit, more = mine[gone[mine]], mine[left[mine]]
        out["doc"].append(int(docs[i]))
        out["row"].append(int(rows_[i]))
        out["starts"].append(np.sort(s[hit] - first[i]).astype(np.int32))
        out["open"].append([{"w": w, "s": x} for w, x in zip(g[more].view(np.int64).tolist(), (s[more] - first[i]).tolist())])
    return pa.table(out, schema=none.schema)


def find_recurring(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES, salt_words: int = SALT_WORDS) -> DataFrame:
    """doc, row and starts of docs (doc long, row a hash of the text, text): the first words of the windows that a smaller doc holds."""
    spark = docs.sparkSession

    def scan(batches):
        for batch in text.chunks(batches):
            at, value, n = minimal_phrases(batch.column("text"), window, phrase)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at)), batch.column("row").take(pa.array(at)), pa.array(n[at], pa.int64()), pa.array(value.view(np.int64))], ["doc", "row", "n", "h"])

    phrases = staged(text.mapped(docs.select("doc", "row", "text"), scan, "doc long, row long, n long, h long"), "phrases")
    confirmed = staged(phrases.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").drop("last"), "confirmed")
    shards = max(default_parallelism(spark), -(-confirmed.count() // shard_phrases))
    held = phrases.join(confirmed, "h").withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    routes = staged(held.groupBy("doc", "row", "n", "shard").agg(F.collect_list(F.when(F.col("doc") == F.col("owner"), F.col("h"))).alias("own")), "routes")
    plain = F.size("own") == 0
    salts = routes.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(plain, F.col("n")).otherwise(0)) / salt_words)).cast("int").alias("salts"))
    dealt = routes.join(salts, "shard").withColumn("salt", F.explode(F.when(plain, F.array(F.pmod(F.xxhash64("doc", "row"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
    groups = text.packed(docs).join(dealt.select("doc", "row", "own", "shard", "salt", "salts"), ["doc", "row"])
    ship_package(spark)
    schema = "doc long, row long, starts array<int>, open array<struct<w: long, s: int>>"
    found = staged(groups.groupBy("shard", "salt").applyInArrow(lambda t: first_holders(t, window, phrase), schema), "holders")
    open_ = found.select("doc", "row", F.explode("open").alias("o")).select("doc", "row", "o.w", "o.s")
    firsts = open_.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    late = open_.join(firsts, "w").where("first < doc").groupBy("doc", "row").agg(F.collect_list("s").alias("starts"))
    return found.select("doc", "row", "starts").where(F.size("starts") > 0).unionByName(late).groupBy("doc", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def dedup_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES, salt_words: int = SALT_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, the text replaced by its kept words joined by one space, with n_words__ and n_removed__.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` consecutive words covers it whose
    word sequence also starts in a document of a smaller id; windows are judged on the input. Null and empty texts have no
    words and become empty. Rows of a null id keep their words and own none; rows of one id count as one document and so
    remove nothing from each other. Repeated rows stay, and so do all columns, but for columns named n_words__ or
    n_removed__, which the counts replace. Windows of one shard are told apart by 64-bit hashes of their words' sequence.
    """
    counts = ("n_words__", "n_removed__")
    others = [c for c in docs.columns if c != text_column and c not in counts]
    source = F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("_")])).alias("src")
    rows = docs.select(source, F.col(f"`{id_column}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.col(f"`{text_column}`").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))
    gone = find_recurring(slim.select("doc", "row", "text"), window, phrase, shard_phrases, salt_words)
    out = text.packed(rows).join(gone, ["doc", "row"], "left").select("src", "text", "starts")
    kinds = pa.schema([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def cut(batches):
        read = zstandard.ZstdDecompressor().decompress
        for batch in text.chunks(batches):
            kept, total, removed = [], [], []
            for t, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = read(t).split()
                total.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.array(starts) + window, -1)
                    words = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            made = pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], schema=kinds)
            yield pa.RecordBatch.from_arrays([batch.column("src"), *made.columns], ["src", "kept", "n_words", "n_removed"])

    schema = out.select("src").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")
    done = text.mapped(out, cut, schema)
    return done.select(*((F.col("kept") if c == text_column else F.col("src")[c]).alias(c) for c in docs.columns if c not in counts), F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))
