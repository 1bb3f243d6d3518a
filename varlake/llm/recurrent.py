"""Language-model scores: a gated recurrent network with a class-factored output, beside smoothed word frequencies.

Words are counted in Spark over all training texts. The DICTIONARY most frequent ones go to all tasks, as a table of bounded
size; counts of the others meet the texts by a join. The network knows the MODEL_WORDS first of them, the end of a text and
one symbol for any other word; such a word's probability is the symbol's times the word's share by smoothed frequency, so
the probabilities of all words add up to one.

Training takes every training text once: in each of ROUNDS rounds a task runs truncated backpropagation over its part of the
round's texts, in parallel streams whose state is carried from window to window, and the tasks' parameters are averaged,
weighted by tokens, through a reduction tree. Scoring carries the state over windows too, so each text is scored whole.

Words are looked up by 64-bit hashes; the counts are those of the strings.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship_package
from . import text
from .storage import staged

DICTIONARY, MODEL_WORDS, CLASSES = 65_536, 1_024, 16
WORD_BYTES = 64  # longer words aren't put in the dictionary
HIDDEN, WIDTH = 12, 12
ROUNDS, STEPS, STREAMS, RATE, CLIP = 3, 16, 512, 0.006, 5.0
SCORE_STEPS, SCORE_STREAMS = 32, 384
SLICE_BYTES, HELD_TOKENS = 4 << 20, 4 << 20  # text of a slice, and tokens of slices that are scored together, so that long texts of several run side by side
SEED = 11
HELD_WORDS = 1 << 20  # words of a task's slices that are united before they are sent
END, OTHER = 0, 1
ORDER = ("embed", "w_in", "w_state", "bias", "w_class", "b_class", "w_word", "b_word")


class Tokens:
    """The words of a slice of texts in lower case A-Z: runs of bytes, their hashes, and for each text the index of its first word."""

    def __init__(self, column: pa.Array):
        data, offsets = text.flat_bytes(column)
        self.data = text.lowered(data)
        self.starts, self.ends, self.first = text.word_bounds(self.data, offsets)
        self.hashes = text.word_hashes(self.data, self.starts, self.ends)

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        size = self.ends[at] - self.starts[at]
        ends = np.cumsum(size)
        flat = self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - size), size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())


class Vocabulary:
    """The most frequent words with their counts, and what the counts of all words add up to."""

    def __init__(self, words: list[str], counts: np.ndarray, end_count: int, total: int, types: int, model_words: int = MODEL_WORDS, classes: int = CLASSES):
        data, offsets = text.flat_bytes(pa.array(words, pa.string()))
        hashes = text.word_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes, self.at = hashes[order], order
        self.total, self.end_count, self.mass = total, end_count, float(total + types + 1)
        self.base = np.log10((counts + 1) / self.mass)  # of the dictionary's words
        self.base_end = float(np.log10((end_count + 1) / self.mass))
        self.size = min(model_words, len(words)) + 2
        own = counts[: self.size - 2]
        known = float((own + 1).sum() + end_count + 1) / self.mass
        self.log_other = float(np.log10(1 - known)) if total else 0.0
        freq = np.concatenate([[end_count + 1, max(1, total - end_count - own.sum())], own]).astype(float)
        upto = np.cumsum(np.sqrt(freq[2:]))
        group = np.minimum((upto - np.sqrt(freq[2:])) * classes / max(upto[-1], 1) if len(upto) else upto, classes - 1).astype(int)
        self.cls = np.concatenate([[0, 1], 2 + np.cumsum(np.diff(group, prepend=group[:1]) > 0)]).astype(np.int64)  # classes are runs of words by frequency; the end and the other words are one each
        self.edge = np.searchsorted(self.cls, np.arange(int(self.cls[-1]) + 2))
        self.freq = freq

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the dictionary, -1 for other words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.at[i], -1)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.size - 2), places + 2, OTHER)


def with_ends(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with an END after each text, and the texts' offsets in them."""
    n = len(first) - 1
    out = np.zeros(len(symbols) + n, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(first))] = symbols
    return out, first + np.arange(n + 1)


class Network:
    """Gated recurrent units and a softmax over classes and then over the words of a class."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, width: int = WIDTH, seed: int = SEED, dtype=np.float32):
        rng = np.random.default_rng(seed)
        v = vocabulary
        n = len(v.edge) - 1
        by_class = np.add.reduceat(v.freq, v.edge[:-1])
        p = {
            "embed": rng.normal(0, 0.1, (v.size, width)), "w_in": rng.normal(0, width**-0.5, (width, 3 * hidden)), "w_state": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "bias": np.zeros(3 * hidden),
            "w_class": np.zeros((hidden, n)), "b_class": np.log(by_class / by_class.sum()), "w_word": np.zeros((v.size, hidden)), "b_word": np.log(v.freq / by_class[v.cls]),
        }
        self.p, self.cls, self.edge, self.hidden = {k: x.astype(dtype) for k, x in p.items()}, v.cls, v.edge, hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in ORDER])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in ORDER:
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(self.p[k].dtype)
            at += self.p[k].size

    # Arrays have features before streams or targets, so that each gate is one run of memory.

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States (steps, features, streams) after each step of inputs x (steps by streams), which begin anew where fresh, from h (features by streams); the last one; with keep, what slopes() needs."""
        n, p = self.hidden, self.p
        half = np.repeat(np.array([0.5, 1], h.dtype), [2 * n, n])  # a sigmoid is a hyperbolic tangent of half the input
        gates = np.ascontiguousarray(((p["embed"] @ p["w_in"] + p["bias"]) * half)[x].swapaxes(1, 2))
        w = np.ascontiguousarray((p["w_state"] * half).T)
        out, held, stale = np.empty((len(x), n, x.shape[1]), h.dtype), [], (~fresh).astype(h.dtype)
        for t, (g, anew) in enumerate(zip(gates, fresh.any(axis=1).tolist())):
            if anew:
                h = h * stale[t]
            own = w @ h
            zr = g[: 2 * n]
            zr += own[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new = zr[n:] * own[2 * n :]
            new += g[2 * n :]
            np.tanh(new, out=new)
            if keep:
                held.append((h, zr[:n], zr[n:], new, own[2 * n :]))
            h = np.subtract(h, new, out=out[t])
            h *= zr[:n]
            h += new
        return out, h.copy(), held

    def runs(self, y: np.ndarray):
        """(class, places) of targets whose class has several words."""
        cls = self.cls[y]
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.edge)))
        for c in np.flatnonzero(np.diff(cuts) * (np.diff(self.edge) > 1)).tolist():
            yield c, order[cuts[c] : cuts[c + 1]]

    @staticmethod
    def log_softmax(x: np.ndarray) -> np.ndarray:
        """Over the first axis, in place."""
        x -= x.max(axis=0)
        x -= np.log(np.exp(x).sum(axis=0))
        return x

    def class_logs(self, s: np.ndarray) -> np.ndarray:
        return self.log_softmax(self.p["w_class"].T @ s + self.p["b_class"][:, None])

    def word_logs(self, s: np.ndarray, a: int, b: int) -> np.ndarray:
        return self.log_softmax(self.p["w_word"][a:b] @ s + self.p["b_word"][a:b, None])

    def log_probabilities(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities after states s (features by targets)."""
        out = self.class_logs(s)[self.cls[y], np.arange(len(y))].astype(np.float64)
        for c, at in self.runs(y):
            a, b = self.edge[c], self.edge[c + 1]
            out[at] += self.word_logs(s[:, at], a, b)[y[at] - a, np.arange(len(at))]
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Gradients of the mean negative log-probability of a window's valid targets, that sum, and the state to carry on (through which no gradient goes)."""
        n, p = self.hidden, self.p
        out, h, held = self.states(x, fresh, h, True)
        at = np.flatnonzero(valid.ravel())
        every = len(at) == x.size
        s = np.ascontiguousarray(out.swapaxes(0, 1)).reshape(n, -1)
        s, t = s if every else s[:, at], y.ravel()[at]
        g = {k: np.zeros_like(v) for k, v in p.items()}

        def turned(logs, rows):
            """Logarithms into the slopes of their loss; the loss."""
            here = np.arange(len(rows))
            cost = -float(logs[rows, here].astype(np.float64).sum())
            d = np.exp(logs, out=logs)
            d[rows, here] -= 1
            d /= len(t)
            return d, cost

        d, cost = turned(self.class_logs(s), self.cls[t])
        g["w_class"], g["b_class"] = s @ d.T, d.sum(axis=1)
        ds = p["w_class"] @ d
        for c, rows in self.runs(t):
            a, b = self.edge[c], self.edge[c + 1]
            own = s[:, rows]
            d, more = turned(self.word_logs(own, a, b), t[rows] - a)
            cost += more
            g["w_word"][a:b], g["b_word"][a:b] = d @ own.T, d.sum(axis=1)
            ds[:, rows] += p["w_word"][a:b].T @ d
        into = ds if every else np.zeros((n, x.size), out.dtype)
        if not every:
            into[:, at] = ds
        into = np.ascontiguousarray(into.reshape(n, *x.shape).swapaxes(0, 1))
        gates = np.empty((len(x), 3 * n, x.shape[1]), out.dtype)
        way = np.empty_like(gates)
        back, stale, anew = np.zeros((n, x.shape[1]), out.dtype), (~fresh).astype(out.dtype), fresh.any(axis=1).tolist()
        for step in range(len(x) - 1, -1, -1):
            prior, z, r, new, own = held[step]
            back += into[step]
            dz, dr, dn = gates[step, :n], gates[step, n : 2 * n], gates[step, 2 * n :]
            np.multiply(back, 1 - z, out=dn)
            dn *= 1 - new * new
            np.multiply(back, prior - new, out=dz)
            dz *= z - z * z
            np.multiply(dn, own, out=dr)
            dr *= r - r * r
            way[step, : 2 * n] = gates[step, : 2 * n]
            np.multiply(dn, r, out=way[step, 2 * n :])
            back *= z
            back += p["w_state"] @ way[step]
            if anew[step]:
                back *= stale[step]
        flat = lambda a: np.ascontiguousarray(a.swapaxes(0, 1)).reshape(a.shape[1], -1)
        g["w_state"] = flat(np.stack([k[0] for k in held])) @ flat(way).T
        gates, xs = flat(gates), x.ravel()
        order = np.argsort(xs)
        heads = np.flatnonzero(np.append(True, xs[order][1:] != xs[order][:-1]))
        g["w_in"], g["bias"] = p["embed"][xs].T @ gates.T, gates.sum(axis=1)
        g["embed"][xs[order][heads]] = np.add.reduceat((p["w_in"] @ gates)[:, order], heads, axis=1).T
        return g, cost, h


class Trainer:
    """Adam over the windows of the slices that it is given."""

    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.rate, self.step = network, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
        self.tokens, self.cost = 0, 0.0

    def take(self, symbols: np.ndarray) -> None:
        """Learns from texts' symbols, one text after the other, cut into streams of equal length."""
        n = len(symbols)
        streams = int(np.clip(n // (200 * STEPS), 8, STREAMS))
        size = -(-n // streams)
        x = np.append(END, symbols[:-1])
        grid = lambda v, pad: np.concatenate([v, np.full(streams * size - n, pad, v.dtype)]).reshape(streams, size).T
        xs, ys, valid, fresh = grid(x, END), grid(symbols, END), grid(np.ones(n, bool), False), grid(x == END, True)
        h = np.zeros((self.network.hidden, streams), self.network.p["bias"].dtype)
        for a in range(0, size, STEPS):
            own = valid[a : a + STEPS]
            if own.any():
                g, cost, h = self.network.slopes(xs[a : a + STEPS], ys[a : a + STEPS], own, fresh[a : a + STEPS], h)
                self.move(g)
                self.cost += cost
        self.tokens += n

    def move(self, g: dict) -> None:
        self.step += 1
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = min(1.0, CLIP / (norm + 1e-12))
        for k, v in g.items():
            m, s = self.first[k], self.second[k]
            m += 0.1 * (scale * v - m)
            s += 0.01 * ((scale * v) ** 2 - s)
            self.network.p[k] -= (self.rate / (1 - 0.9**self.step)) * m / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-7)


def log_likelihoods(network: Network, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log-probability of each text (its END included), all of its windows on from its own state; texts are dealt to parallel streams, the longest first."""
    sizes = np.diff(first)
    if not len(sizes):
        return np.zeros(0)
    order = np.argsort(-sizes, kind="stable")
    loads = [(0, i) for i in range(min(SCORE_STREAMS, len(sizes)))]
    dealt: list[list[int]] = [[] for _ in loads]
    for d in order.tolist():
        load, i = heapq.heappop(loads)
        dealt[i].append(d)
        heapq.heappush(loads, (load + int(sizes[d]), i))
    rows = [np.concatenate([np.arange(first[d], first[d + 1]) for d in own]) for own in dealt]
    rows.sort(key=len, reverse=True)
    long = np.array([len(r) for r in rows])
    x = np.append(END, symbols[:-1])
    starts = np.zeros(len(symbols), bool)
    starts[first[:-1]] = True
    x[starts] = END
    logs = np.zeros(len(symbols))
    h = np.zeros((network.hidden, len(rows)), network.p["bias"].dtype)
    for a in range(0, int(long[0]), SCORE_STEPS):
        active = int((long > a).sum())
        steps = min(SCORE_STEPS, int(long[0]) - a)
        at = np.full((steps, active), -1)
        for i in range(active):
            part = rows[i][a : a + steps]
            at[: len(part), i] = part
        inside = at >= 0
        out, h, _ = network.states(np.where(inside, x[at], END), np.where(inside, starts[at], True), h[:, :active])
        own = at[inside]
        logs[own] = network.log_probabilities(np.ascontiguousarray(out.swapaxes(0, 1)[:, inside]), symbols[own])
    return np.add.reduceat(logs, first[:-1])


def scored(network: Network, held: list) -> list[pa.RecordBatch]:
    """The rows of slices (columns, what is added to a text's score, symbols) with their texts' scores, all texts at once."""
    sizes = np.concatenate([columns[1].to_numpy() for columns, _, _ in held])
    first = np.concatenate([[0], np.cumsum(sizes)])
    logs = log_likelihoods(network, np.concatenate([symbols for _, _, symbols in held]), first) / np.log(10)
    parts = np.split(logs, np.cumsum([len(more) for _, more, _ in held])[:-1])
    return [pa.RecordBatch.from_arrays([*columns[:4], pa.array(own + more), *columns[4:]], ["doc_id", "n_tokens", "n_known", "base", "own", "n_rare", "rare"]) for (columns, more, _), own in zip(held, parts)]


def held_out(id_column):
    """Texts kept from learning: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """word and n of all texts(text_); the null word stands for the texts' ends."""

    def run(batches):
        ends, held, n_held = 0, [], 0

        def united():
            words = pa.concat_arrays([w for w, _ in held])
            found = pa.table({"word": words, "n": np.concatenate([n for _, n in held])}).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([found.column("word").combine_chunks(), found.column("n_sum").combine_chunks()], ["word", "n"])

        for batch in text.chunks(batches, "text_", SLICE_BYTES):
            own = Tokens(batch.column("text_"))
            _, at, n = np.unique(own.hashes, return_index=True, return_counts=True)
            held.append((own.strings(at), n))
            ends, n_held = ends + batch.num_rows, n_held + len(at)
            if n_held >= HELD_WORDS:
                yield united()
                held, n_held = [], 0
        if held:
            yield united()
        yield pa.RecordBatch.from_arrays([pa.array([None] if ends else [], pa.string()), pa.array([ends] if ends else [], pa.int64())], ["word", "n"])

    return text.mapped(texts.select("text_"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, dictionary: int = DICTIONARY, model_words: int = MODEL_WORDS, classes: int = CLASSES) -> Vocabulary:
    """The vocabulary of count_words(): the counts' bins, of which there are some hundreds, tell from which count on words are few enough to be collected."""
    total, types, end = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    fit = F.octet_length("word") <= WORD_BYTES
    level = F.floor(16 * F.log2("n")).cast("int")
    bins = sorted(((r["level"], r["count"]) for r in counts.where(fit).groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in bins:
        if held + n > dictionary:
            break
        least, held = at, held + n
    rows = counts.where(fit & (level >= least)).select("word", "n").collect() if least is not None else []
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    return Vocabulary([r["word"] for r in rows], np.array([r["n"] for r in rows], np.int64), end or 0, total or 0, types, model_words, classes)


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network of rows(id_, text_): each text is learnt from in one round, chosen by a hash."""
    spark, network = rows.sparkSession, Network(vocabulary)
    ship_package(spark)
    words = spark.sparkContext.broadcast(vocabulary)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(network.flat())

        def run(batches, sent=sent):
            trainer = Trainer(Network(words.value))
            trainer.network.load(sent.value)
            for batch in text.chunks(batches, "text_", SLICE_BYTES):
                own = Tokens(batch.column("text_"))
                trainer.take(with_ends(words.value.symbols(words.value.places(own.hashes)), own.first)[0])
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([trainer.network.flat().astype(np.float32).tobytes()], pa.binary())], ["tokens", "flat"])

        part = rows.where(F.pmod(F.xxhash64("id_", "text_"), F.lit(rounds)) == r).select("text_")
        made = text.mapped(part, run, "tokens long, flat binary").rdd
        zero = (0, np.zeros(len(network.flat())))
        tokens, total = made.treeAggregate(zero, lambda acc, row: (acc[0] + row["tokens"], acc[1] + row["tokens"] * np.frombuffer(row["flat"], np.float32).astype(float)), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        if tokens:
            network.load(total / tokens)
        sent.destroy()
    return network


def score(docs: DataFrame, rounds: int = ROUNDS, dictionary: int = DICTIONARY, model_words: int = MODEL_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of docs.

    base_score is the sum of log10((c + 1) / (N + V + 1)) over a text's words and its end, c counted in the texts that aren't
    held out, of N tokens of V kinds; score is the network's log10 probability of the same. Null counts as the empty text,
    which is its end alone; a null id is learnt from; repeated rows are learnt from and scored each; an empty table gives no
    rows. Without any text to learn from, N and V are 0 and the network is as it starts. Other columns aren't read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text_"))
    learnt = rows.where(~held_out(F.col("id_")))
    counts = staged(count_words(learnt), "word_counts")
    vocabulary = vocabulary_of(counts, dictionary, model_words)
    network = train(learnt, vocabulary, rounds)
    sent = spark.sparkContext.broadcast((vocabulary, network))

    def run(batches):
        vocabulary, network = sent.value
        held, tokens = [], 0
        for batch in text.chunks(batches, "text_", SLICE_BYTES):
            own = Tokens(batch.column("text_"))
            place, n = vocabulary.places(own.hashes), batch.num_rows
            symbols, first = with_ends(vocabulary.symbols(place), own.first)
            doc = np.repeat(np.arange(n), np.diff(own.first))
            known, other = place >= 0, place >= vocabulary.size - 2
            base = np.bincount(doc[known], weights=vocabulary.base[place[known]], minlength=n) + vocabulary.base_end
            more = np.bincount(doc[other], weights=vocabulary.base[place[other]], minlength=n)  # of the words that the dictionary has and the network hasn't
            more = more - np.bincount(doc[other | ~known], minlength=n) * vocabulary.log_other
            # Words out of the dictionary, each once a text with its count.
            at = np.flatnonzero(~known)
            order = at[np.lexsort((own.hashes[at], doc[at]))]
            head = np.ones(len(order), bool)
            head[1:] = (own.hashes[order][1:] != own.hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            heads = np.flatnonzero(head)
            rare = pa.StructArray.from_arrays([own.strings(order[heads]), pa.array(np.diff(np.append(heads, len(order))), pa.int64())], ["word", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order[heads]], np.arange(n + 1)), pa.int32()), rare)
            columns = [batch.column("id_"), *map(pa.array, (np.diff(first), np.bincount(doc[known], minlength=n), base, np.bincount(doc[~known], minlength=n))), lists]
            held.append((columns, more, symbols.astype(np.int32)))
            tokens += len(symbols)
            if tokens >= HELD_TOKENS:
                yield from scored(network, held)
                held, tokens = [], 0
        if held:
            yield from scored(network, held)

    made = text.mapped(rows, run, "doc_id long, n_tokens long, n_known long, base double, own double, n_rare long, rare array<struct<word: string, k: long>>")
    made = staged(made.withColumn("row_", F.monotonically_increasing_id()), "language_scores")
    rare = made.select("row_", F.explode("rare").alias("r")).select("row_", "r.word", "r.k")
    unit = lambda c: F.log10((c + 1) / F.lit(vocabulary.mass))
    met = rare.join(counts, "word").groupBy("row_").agg(F.sum(F.col("k") * unit(F.col("n"))).alias("met"), F.sum("k").alias("n_met"))
    out = made.drop("rare").join(met, "row_", "left").withColumn("n_met", F.coalesce("n_met", F.lit(0).cast("long")))
    rest = F.coalesce("met", F.lit(0.0)) + (F.col("n_rare") - F.col("n_met")) * unit(F.lit(0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("n_met") + F.lit(int(vocabulary.end_count > 0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"), (F.col("own") + rest).alias("score"),
    )
