"""SentencePiece BPE by vectorised merge rounds, shared by encoding, decoding and counting.

Symbols of all words lie in one flat numpy array. Each round finds every word's best pair by a segmented minimum,
merges it at its leftmost places in all words at once and compacts; words without a pair left are done.

The library merges one pair at a time, the best rank first and the leftmost of a rank. Places of one rank are merged at
once as long as that gives the same: what a merge makes must not pair with a neighbour at a rank that is as good or better.
Where it does (a stop), places to its right wait for the next round, unless they are further away than two of the longest
pieces: all that follows from a stop grows one piece around it, so it can't reach them. Words are cut where no piece of the
vocabulary holds the two characters, as no merge can span that place. Pieces of one rank that grow into each other (runs of
spaces) make a stop at every place; such a neighbourhood is scanned once from the left, which is the library's own order.
"""

from __future__ import annotations

import functools
import re

import numpy as np

MARK = "▁"
NONE = np.int64(1) << np.int64(60)
CACHE = 200_000
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Pieces:
    """A BPE model with byte fallback and no normalisation, as read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE with byte fallback, a dummy prefix and no normalisation is supported")
        self.names = [p.piece for p in model.pieces]
        score = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in score):
            raise ValueError("words can't be merged apart: a piece spans them")
        self.byte_ids = np.zeros(256, np.int64)
        self.raw = [p.replace(MARK, " ").encode() for p in self.names]
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
        # Symbols: piece ids, then characters that occur in pieces only, then unknown characters as -1 - code point.
        n = len(self.names)
        symbol = {p: i for p, (_, i) in score.items()}
        for p in score:
            for c in p:
                symbol.setdefault(c, n + len(symbol))
        self.n_symbols = max(symbol.values()) + 1
        self.char = np.arange(-1, -1 - 0x110000, -1, dtype=np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.char[ord(MARK)]
        self.of_symbol = {i: p for p, i in symbol.items()}
        # Ranks: equal scores share a rank, and then the leftmost pair goes first.
        levels = {s: r for r, s in enumerate(sorted({s for s, _ in score.values()}, reverse=True))}
        rank = {p: levels[s] for p, (s, _) in score.items()}
        shared = np.bincount(list(rank.values()), minlength=len(levels)) > 1
        keys, ranks, made, early = [], [], [], set()
        for p, (_, i) in score.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    ranks.append(rank[p])
                    made.append(i)
                    early.update(x for x in (a, b) if x < n and rank[self.names[x]] >= rank[p])
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        # Merges to be done one at a time: what they make could pair at once at a better rank, or the rank has several pieces.
        self.single = np.array([x in early for x in self.made]) | shared[self.ranks]
        # An open hash table of the keys; a last entry stands for no pair.
        size = 1 << (2 * len(self.keys)).bit_length()
        self.shift, self.slots, self.probes = 64 - size.bit_length() + 1, np.full(size, -1, np.int64), 0
        for i, k in enumerate(self.keys.tolist()):
            slot, tries = (k * 0x9E3779B97F4A7C15 % 2**64) >> self.shift, 1
            while self.slots[slot] >= 0:
                slot, tries = (slot + 1) % size, tries + 1
            self.slots[slot], self.probes = i, max(self.probes, tries)
        self.keys, self.ranks, self.made, self.single = (np.append(x, y) for x, y in ((self.keys, -1), (self.ranks, NONE), (self.made, -1), (self.single, False)))
        self.raw_ends = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.reach = 2 * max(map(len, score)) + 2  # characters beyond which what follows from two stops can't meet
        inner = {(symbol[a], symbol[b]) for p in score for a, b in zip(p, p[1:])}
        self.lookup = dict(zip(self.keys[:-1].tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        self.inner = np.unique(np.array([a * self.n_symbols + b for a, b in inner], np.int64))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table, -1 for those that make no piece."""
        key = left * self.n_symbols + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)
        at = self.slots[slot]
        out = np.where((at >= 0) & (self.keys[at] == key), at, -1)
        for _ in range(self.probes - 1):
            left_over = np.flatnonzero((out < 0) & (at >= 0))
            if not len(left_over):
                break
            slot[left_over] = (slot[left_over] + 1) & (len(self.slots) - 1)
            at = np.full(len(key), -1)
            at[left_over] = self.slots[slot[left_over]]
            out = np.where((at >= 0) & (self.keys[at] == key), at, out)
        return np.where((left >= 0) & (right >= 0), out, -1)

    def spanned(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a piece holds the two characters, one after the other; elsewhere words fall apart."""
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
        return (self.inner[at] == key) & (left >= 0) & (right >= 0)

    def stops(self, hit: np.ndarray, sym: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a round's hits (places that don't overlap, in order): which make a pair of a rank that is as good or better, and which of just the same rank."""
        stop, same = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
        at = np.flatnonzero(self.single[place[hit]])
        if not len(at):
            return stop, same
        h, rank = hit[at], self.ranks[place[hit[at]]]
        made = self.made[place[h]]
        # To the left, the hit before may have been merged by then; to the right, nothing has.
        left = sym[h - 1]
        prior = np.maximum(at - 1, 0)
        joined = (at > 0) & (hit[prior] == h - 2)
        left[joined] = self.made[place[hit[prior[joined]]]]
        right = np.minimum(h + 2, len(sym) - 1)
        for a, b, inside in ((left, made, (h > 0) & (word[h - 1] == word[h])), (made, sym[right], (h + 2 < len(sym)) & (word[right] == word[h]))):
            new = self.ranks[self.pairs(a, b)]
            stop[at] |= inside & (new <= rank)
            same[at] |= inside & (new == rank)
        return stop, same

    def scanned(self, first: int, last: int, sym: np.ndarray, word: np.ndarray, rank: int) -> tuple[list[int], list[int], list[int]]:
        """The merges of one rank from the first hit on, in the library's order, until none is left up to the last hit or one makes a better pair: places that change, their symbols, places that go."""
        stack = [(first - 1, int(sym[first - 1]))] if first and word[first - 1] == word[first] else []
        stack.append((first, int(sym[first])))
        changed, gone, i, end = {}, [], first + 1, len(sym)
        while i < end and word[i] == word[first]:
            known = stack[-1][1] >= 0 and sym[i] >= 0
            found, made = self.lookup.get(stack[-1][1] * self.n_symbols + int(sym[i]), (NONE, -1)) if known else (NONE, -1)
            if found < rank or found > rank and i > last:
                break
            if found > rank:
                stack.append((i, int(sym[i])))
                i += 1
                continue
            gone.append(i)
            i += 1
            at = stack.pop()[0]
            changed[at] = made
            while stack:
                found, more = self.lookup.get(stack[-1][1] * self.n_symbols + made, (NONE, -1)) if stack[-1][1] >= 0 else (NONE, -1)
                if found != rank:
                    break
                gone.append(at)
                del changed[at]
                at, made = stack.pop()[0], more
                changed[at] = made
            stack.append((at, made))
            if found < rank:
                break
        return list(changed), list(changed.values()), gone

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of each word, one after the other, and the words' offsets in them."""
        done_syms, done_begins = [], []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.arange(len(sym))
        cut = np.ones(len(sym), bool)
        cut[1:] = ~self.spanned(sym[:-1], sym[1:])
        ends = np.cumsum(sizes)
        cut[ends[ends < len(sym)]] = True
        word = np.cumsum(cut) - 1  # of the parts that can be merged apart
        place = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            place[:-1] = np.where(word[1:] == word[:-1], self.pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            new = np.ones(len(sym), bool)
            np.not_equal(word[1:], word[:-1], out=new[1:])
            heads = np.flatnonzero(new)
            rank = self.ranks[place]  # the last, for places of -1, is above all ranks
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            if (done := best == NONE).any():
                keep = np.repeat(~done, sizes)
                done_syms.append(sym[~keep])
                done_begins.append(begin[~keep])
                sym, word, place, rank, begin = sym[keep], word[keep], place[keep], rank[keep], begin[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # In a run of overlapping pairs every other one is merged.
            start = np.ones(len(hit), bool)
            start[1:] = (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            stop, same = self.stops(hit, sym, word, place)
            keep, touched = np.ones(len(sym), bool), np.zeros(len(sym), bool)
            if stop.any():
                apart = np.ones(len(hit), bool)
                apart[1:] = (word[hit[1:]] != word[hit[:-1]]) | (begin[hit[1:]] - begin[hit[:-1]] > self.reach)
                near, before = np.cumsum(apart) - 1, np.cumsum(stop) - stop
                alike = np.logical_or.reduceat(same, np.flatnonzero(apart))[near]
                for own in np.split(np.flatnonzero(alike), np.flatnonzero(np.diff(near[alike])) + 1) if alike.any() else ():
                    at, new, gone = self.scanned(int(hit[own[0]]), int(hit[own[-1]]), sym, word, int(rank[hit[own[0]]]))
                    sym[at], touched[at], keep[gone] = new, True, False
                hit = hit[~alike & (before == before[apart][near])]
            sym[hit] = self.made[place[hit]]
            keep[hit + 1] = False
            touched[hit] = True
            sym, word, place, begin, touched = sym[keep], word[keep], place[keep], begin[keep], touched[keep]
            redo = np.flatnonzero(touched | np.append(touched[1:], False))
            place[redo] = -1
            inner = redo[redo + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            place[inner] = self.pairs(sym[inner], sym[inner + 1])
        sym, begin = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (done_syms, done_begins))
        order = np.argsort(begin, kind="stable")
        return sym[order], np.append(0, np.searchsorted(begin[order], ends))

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the words, one after the other, and the words' offsets; a character without a piece gives the ids of its bytes."""
        sym, offsets = self.merged(words)
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.names)))
        if not len(odd):
            return sym.astype(np.int32), offsets
        spelt = [(self.of_symbol[s] if s >= 0 else chr(-1 - s)).encode("utf-8", "surrogatepass") for s in sym[odd].tolist()]
        counts = np.ones(len(sym), np.int64)
        counts[odd] = [len(x) for x in spelt]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.repeat(sym, counts)
        at = np.repeat(ends[odd], counts[odd]) + np.concatenate([np.arange(len(x)) for x in spelt])
        ids[at] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return ids.astype(np.int32), ends[offsets]

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids: its pieces' bytes as UTF-8."""
        size = self.raw_ends[ids + 1] - self.raw_ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.raw_ends[ids] - ends[:-1], size)
        data, cuts = self.raw_bytes[at].tobytes(), ends[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def units(text: str) -> list[str]:
    """The parts of a text that are merged apart, each as a key: what follows a space without that space, further spaces kept, or what follows a line end with it."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text:
        return text.replace("\n", " \n").split(" ")
    return [u if u[0] == "\n" else u[1:] for u in _UNITS.findall(" " + text)]


def spelled(key: str) -> str:
    """The characters that a key stands for."""
    return key if key[:1] == "\n" else " " + key


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Memo(dict):
    """What is known of unit keys, in two generations: keys that recur move on to the next one, the rest are computed again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def learn(self, texts_units: list[list[str]]) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        new = set().union(*texts_units).difference(self)
        if self.old:
            known = new.intersection(self.old)
            self.update({k: self.old[k] for k in known})
            new -= known
        if new:
            new = list(new)
            self.update(zip(new, self.make(new)))
