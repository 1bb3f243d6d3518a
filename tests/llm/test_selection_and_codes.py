"""Importance resampling and vector codes against brute force, odd rows among them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from varlake.llm import importance, vector_codes


def odd_texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma9", "ünï", "日本", "x"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n-- "), (63, "one"), (64, "One,TWO"), (65, "z" * 400 + " " + "ä" * 300 + "-end"), (66, " ".join(rng.choice(words) for _ in range(4000))), (3, rows[3][1]), (None, rows[5][1]), (70, "\x00a\x7fb c"), (71, "same words " * 15), (72, "same words " * 15)]
    return rows


def features(t):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return ws, Counter(" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))


@pytest.mark.parametrize("slice_bytes", [8 << 20, 300])
def test_importance_resampling(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    rows, target = odd_texts(), [(1, "alpha w1 w2 w3 ünï 日本"), (2, None), (3, "w1 w2 w3 gamma9 one two")]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    for into, own in ((s, rows), (t, target)):
        for _, x in own:
            for g, n in features(x)[1].items():
                into[bucket(g)] += n
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    made = []
    for i, x in rows:
        ws, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(bucket(g)) for g, n in f.items())
        made.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    order = sorted((-m[3], m[0] is None, m[0]) for m in made if m[4] >= 20)
    drawn = {(i, -score): r for r, (score, _, i) in enumerate(order[: 30 * len(order) // 100], 1)}
    frame = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "doc_id long, text string, weight int, rank string").repartition(3)
    got = importance.resample(frame, spark.createDataFrame(target, "item_id long, text string"), share=30).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(m[:4] for m in made)
    assert {(r.doc_id, r.score): r["rank"] for r in got if r["rank"]} == drawn and len(drawn) > 5


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert {r.doc_id: r.n_features for r in importance.resample(some, none).collect()} == {1: 177, 2: 0}


def test_crc_of_runs_is_that_of_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begin, size = rng.integers(0, 4000, 300), rng.integers(0, 600, 300)
    assert importance.crc32s(data, begin, size).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(begin, size)]


def by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and codebooks in plain Python integers."""
    kept = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, _, v in kept:
                held[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if held[e] else own for e, own in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, v in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return Counter((i, code, error, by_label[label]) for i, code, error, label in out), books


@pytest.mark.parametrize("n, size", [(400, 16), (9, 8)])
def test_vector_codes(spark, monkeypatch, n, size):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, size).astype(np.float32)], rng.choice(["a", "b", None])) for i in rng.permutation(n)]
    rows += [(rows[0][0], rows[1][1], "a"), (None, rows[2][1], "b"), (n + 1, [0.0] * size, "c"), (n + 2, [0.0] * size, "c")]
    odd = [(n + 3, None, "a"), (n + 4, [float("nan")] + [0.0] * (size - 1), "a"), (n + 5, [None] * size, None), (n + 6, [float("inf")] * size, "a")]
    want, books = by_hand(rows)
    frame = spark.createDataFrame([(i, v, None if label is None else str(label), "x") for i, v, label in rows + odd], "vec_id long, embedding array<float>, label string, code string").repartition(5)
    out, got = vector_codes.compress(frame)
    assert Counter(tuple(r) for r in out.collect()) == want and got.tolist() == books
    assert vector_codes.digest(got) == hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def test_vector_codes_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(make([]))[0].count() == vector_codes.compress(make([(1, None, 1)]))[0].count() == 0
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [], 1)]):
        with pytest.raises(ValueError, match="equal parts"):
            vector_codes.compress(make(bad))
    with pytest.raises(Exception, match="a component times"):
        vector_codes.compress(make([(1, [1e9] * 8, 1)]))


def test_codes_are_nearest_entries():
    rng = np.random.default_rng(3)
    part, book = rng.integers(-9, 9, (3, 200)).astype(np.int32), rng.integers(-9, 9, (16, 3)).astype(np.int64)
    code, distance = vector_codes.nearest(part, book)
    every = ((book[:, :, None] - part[None]) ** 2).sum(axis=1)
    assert (code == every.argmin(axis=0)).all() and (distance == every.min(axis=0)).all()
    sums, counts = vector_codes.added((np.zeros((1, 16, 3), np.int64), np.zeros((1, 16), np.int64)), part, book[None])
    assert counts.sum() == 200 and (sums.sum(axis=(0, 1)) == part.sum(axis=1)).all()
