"""Language-model scores: base scores against brute force, gradients against differences, whole texts against one step at a time, and held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from varlake.llm import queries, recurrent

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(dtype=np.float64):
    words = recurrent.Vocabulary([f"w{i}" for i in range(40)], np.arange(400, 0, -10), 50, 9000, 60, 30, 6)
    network = recurrent.Network(words, 5, 4, dtype=dtype)
    rng = np.random.default_rng(0)
    for k in network.p:
        network.p[k] = (network.p[k] + rng.normal(0, 0.3, network.p[k].shape)).astype(dtype)
    return words, network, rng


def test_gradients_are_those_of_differences():
    words, network, rng = small()
    x, y = rng.integers(0, words.size, (2, 6, 3))
    valid, fresh, h = rng.random((6, 3)) > 0.2, rng.random((6, 3)) > 0.7, rng.normal(0, 1, (5, 3))
    g, _, _ = network.slopes(x, y, valid, fresh, h)
    cost = lambda: network.slopes(x, y, valid, fresh, h)[1] / valid.sum()
    for k, values in network.p.items():
        flat = values.ravel()
        for i in rng.choice(flat.size, min(12, flat.size), False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = cost()
            flat[i] = old - 1e-6
            down = cost()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].ravel()[i]) < 1e-7, k


def test_probabilities_of_all_words_add_up_to_one():
    words, network, rng = small()
    h = rng.normal(0, 1, (5, 1)).repeat(words.size, axis=1)
    assert np.exp(network.log_probabilities(h, np.arange(words.size))).sum() == pytest.approx(1)
    # A word that the network doesn't know has its symbol's probability times its share among such words.
    outside = 10 ** (words.base[words.size - 2 :] - words.log_other)
    rest = (words.mass - (10 ** words.base * words.mass).sum() - 51) / words.mass / 10**words.log_other
    assert outside.sum() + rest == pytest.approx(1)


def test_states_are_carried_over_windows(monkeypatch):
    """Texts of up to 700 tokens in streams and windows give what one step at a time gives."""
    words, network, rng = small()
    monkeypatch.setattr(recurrent, "SCORE_STREAMS", 3)
    sizes = [700, 1, 130, 64, 65, 1, 20, 300]
    symbols = rng.integers(1, words.size, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols[first[1:] - 1] = recurrent.END
    got = recurrent.log_likelihoods(network, symbols, first)
    for a, b, value in zip(first, first[1:], got):
        h, last, total = np.zeros((5, 1)), recurrent.END, 0.0
        for y in symbols[a:b]:
            out, h, _ = network.states(np.array([[last]]), np.array([[False]]), h)
            total += network.log_probabilities(out[0], np.array([y]))[0]
            last = y
        assert value == pytest.approx(total)


def rows_of_two_words():
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(("a b" if rng.random() < 0.5 else "C d") for _ in range(8)) + f" rare{rng.randrange(3000)}" for _ in range(6))) for i in range(400)]
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (3, rows[3][1]), (None, "a b x"), (1003, "x" * 100 + " a " + "y" * 5000), (1004, "never1 never1 NEVER1 a"), (1005, "a b " * 3000)]


@pytest.mark.parametrize("dictionary", [65_536, 20])
def test_scores(spark, dictionary):
    rows = rows_of_two_words()
    tokens = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for own, o in zip(tokens, out) if not o for w in own)
    n, v = sum(counts.values()), len(counts)
    frame = spark.createDataFrame([(i, t, 1.0, "c") for i, t in rows], "doc_id long, text string, base double, rare string").repartition(3)
    got = recurrent.score(frame, dictionary=dictionary).collect()
    want = Counter((i, o, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 5)) for (i, _), o, own in zip(rows, out, tokens))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    # After a comes b, and c d alike, which word frequencies can't tell.
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(held) > 30 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.15 * sum(r.n_tokens for r in held)


def test_scores_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert recurrent.score(make([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = recurrent.score(make([(only, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_held_out_texts_of_the_tables(spark):
    got = queries.QUERIES["op12_language_scores"](spark, "/root/testdata/sf0.001").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
