"""Jaccard links between documents' shingle sets, by a token-group matrix.

Equal sets form one class. Classes whose least shingles agree under one of several hashes form families, by the smallest of them. A family is dealt
to chunks of bounded size, in which what is linked is united exactly; then the hubs of its chunks meet in chunks of their
own. So nearly all that belongs together is united before the token-group matrix, which makes the result whole. Its groups
are a family's leading component and the family's rest, by set size; a group holds the union of its members' prefix tokens
(a set of n tokens keeps its n - ceil(t n) + 1 first ones in one global order, frequent tokens last; linked sets share
one of them). A class queries the groups whose unions its prefix meets, but not those which are united with it; of these,
only groups whose whole token union can hold an overlap that reaches the threshold are opened, and their members compared.

Shingles are compared by 64-bit hashes and whole sets by 128 bits, so unequal ones count as equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship_package
from . import text
from .storage import default_parallelism, staged

K, PERCENT = 5, 80
KEYS = 4  # hashes under which least shingles are compared
REPEATS, RUN = 4, 1 << 22  # a task counts the shingles that occur as often in a run of so many shingles
LEAST_FREQUENT, FREQUENT = 64, 1 << 21  # frequent: at least so often, and more than one in so many of all shingles; so at most FREQUENT ones
LONG_LIST, ROUNDS = 16, 2  # a prefix token that more classes share is frequent too; such tokens are looked for so often at most
BIN_WORDS = 600_000  # tokens that are compared in one task, about
ROW_WORDS = 200  # a set counts as so many tokens more, which bounds the sets of a task as well
CELLS = 1 << 22  # cells of a matrix of overlaps or tokens that a task holds at once
DENSE = 256  # a token is counted by a product of matrices if more than one in so many pairs of sets share it, else by listing the pairs
MARKS = 1 << 26  # bits of the bitmap of the documents whose texts a comparison needs
HOPS = 2  # a class goes to the family of its family's first class so often
SIZES = 1.1  # sets of one group differ in size by this factor at most


def level(count: np.ndarray) -> np.ndarray:
    """The place of frequent tokens in the global order, by how frequent they are; rare ones have level 0."""
    return np.clip(4 * np.log2(np.maximum(count, 1)), 1, 127).astype(np.uint8)


def frequent_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in the whole corpus, and their levels; their number is bounded by FREQUENT."""

    def scan(batches):
        held, size, total = [], 0, 0
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("total", pa.int64())])

        def counted():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= REPEATS
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often]), pa.array(np.zeros(often.sum(), np.int64))], schema=schema)

        for batch in text.chunks(batches):
            held.append(text.shingles(batch.column("text"), k))
            size += len(held[-1])
            total += len(held[-1])
            if size >= RUN:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([total])], schema=schema)

    found = text.mapped(docs.select("text"), scan, "h long, c long, total long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    found = staged(found.where((F.col("c") >= LEAST_FREQUENT) | (F.col("total") > 0)), "frequent")
    total = found.agg(F.sum("total")).first()[0] or 0
    often = found.where(F.col("c") > max(LEAST_FREQUENT - 1, total // FREQUENT)).select("h", "c").toArrow()
    h, order = often.column("h").to_numpy().view(np.uint64), np.argsort(often.column("h").to_numpy().view(np.uint64))
    return h[order], level(often.column("c").to_numpy()[order])


def ordered(values: np.ndarray, offsets: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets' tokens in the global order: rare ones by hash, then frequent ones by level and hash; and which are frequent."""
    known, levels = often
    place = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    late = np.where(known[place] == values, levels[place], 0) if len(known) else np.zeros(len(values), np.uint8)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(owner * 128 + late, kind="stable")
    return values[order], late[order] > 0


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, often, k: int) -> DataFrame:
    """doc, row, n (set size), s1 and s2 (a hash of the set) and keys: the least shingle under each of KEYS hashes, frequent ones only if there are no others, and the least of all shingles under every two hashes."""
    seeds = [np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64) for j in range(KEYS)]

    def scan(batches):
        for batch in text.chunks(batches):
            values, offsets = text.shingle_sets(batch.column("text"), k)
            values, late = ordered(values, offsets, often.value)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            heads = offsets[:-1][full]
            out = [np.zeros(len(n), np.uint64) for _ in range(2 + KEYS + KEYS // 2)]
            if len(full):
                for j in range(2):
                    out[j][full] = np.add.reduceat(text.mixed(values + np.uint64(j + 1)), heads) + n[full].astype(np.uint64)
                top = late.astype(np.uint64) << np.uint64(63)
                least = []
                for j in range(KEYS):
                    own = text.mixed(values ^ seeds[j]) >> np.uint64(1)
                    least.append(np.minimum.reduceat(own, heads))
                    out[2 + j][full] = np.minimum.reduceat(own | top, heads)
                for j in range(KEYS // 2):
                    out[2 + KEYS + j][full] = text.joined(least[2 * j], least[2 * j + 1])
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(out[2:], axis=1).ravel().view(np.int64)), len(out) - 2).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in out[:2]), keys], ["doc", "row", "n", "s1", "s2", "keys"])

    return text.mapped(docs, scan, "doc long, row long, n long, s1 long, s2 long, keys array<long>")


def shared_postings(docs: DataFrame, often, k: int, percent: int, parts: int) -> DataFrame:
    """token and s1 of prefix tokens that sets of several classes hold."""

    def scan(batches):
        seen: set[int] = set()
        for batch in text.chunks(batches):
            values, offsets = text.shingle_sets(batch.column("text"), k)
            values, _ = ordered(values, offsets, often.value)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            sign = np.zeros(len(n), np.uint64)
            if len(values):
                sign[n > 0] = np.add.reduceat(text.mixed(values + np.uint64(1)), offsets[:-1][n > 0]) + n[n > 0].astype(np.uint64)
            new = np.array([x not in seen and not seen.add(x) for x in sign.tolist()], bool) & (n > 0)  # a task posts a class once
            if len(seen) > 1_000_000:
                seen.clear()
            take = (np.arange(len(values)) - offsets[owner] < prefix_size(n, percent)[owner]) & new[owner]
            yield pa.RecordBatch.from_arrays([pa.array(values[take].view(np.int64)), pa.array(sign[owner[take]].view(np.int64))], ["token", "s1"])

    def shared(batches):
        last_token, last_sign, told = None, None, False
        for batch in batches:
            token, sign = batch.column("token").to_numpy(), batch.column("s1").to_numpy()
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sign[1:] != sign[:-1])
            new[0] = token[0] != last_token or sign[0] != last_sign
            token, sign = token[new], sign[new]
            if not len(token):
                continue
            near = np.zeros(len(token), bool)
            near[1:] = token[1:] == token[:-1]
            near[:-1] |= near[1:].copy()
            if token[0] == last_token:
                near[0] = True
                if not told:  # the last row of the batch before is shared after all
                    yield pa.RecordBatch.from_arrays([pa.array([last_token]), pa.array([last_sign])], ["token", "s1"])
            yield pa.RecordBatch.from_arrays([pa.array(token[near]), pa.array(sign[near])], ["token", "s1"])
            last_token, last_sign, told = int(token[-1]), int(sign[-1]), bool(near[-1])

    posts = text.mapped(docs.select("text"), scan, "token long, s1 long").repartition(parts, "token").sortWithinPartitions("token", "s1")
    return text.mapped(posts, shared, "token long, s1 long")


def settled_postings(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """shared_postings() under an order in which tokens with long lists come last, too.

    Lists are counted exactly. A token with a long one joins the frequent ones, and prefixes are taken anew, until no other
    has any; any order finds all links, this one keeps the lists' pairs in proportion to the postings."""
    spark = docs.sparkSession
    for turn in range(ROUNDS):
        posts = staged(shared_postings(docs, spark.sparkContext.broadcast(often), k, percent, default_parallelism(spark)), "shared")
        if turn == ROUNDS - 1 or len(often[0]) >= FREQUENT:
            break
        lists = posts.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > LONG_LIST)
        found = lists.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
        tokens = np.concatenate([often[0], found.column("token").to_numpy().view(np.uint64)])
        more, first = np.unique(tokens, return_index=True)
        if len(more) == len(often[0]):
            break
        often = more, np.concatenate([often[1], level(found.column("c").to_numpy())])[first]
    return posts


def may_link(n: Column, low: Column, high: Column, shared: Column, percent: int) -> Column:
    """Whether a set of n tokens whose prefix shares so many tokens with a group's prefixes can link with a member of low to high tokens.

    Common tokens are in both prefixes, or behind the prefix that ends first: fewer than percent of its set's tokens. What is
    needed beyond those grows up to equal sizes and falls from there on, so the range's ends decide; rounding takes 1 at most.
    """
    up = lambda a, b: F.floor((a + (b - 1)) / b)
    least, most = F.greatest(low, up(n * percent, 100)), F.least(high, F.floor(n * 100 / percent))
    need = lambda m: up((n + m) * percent, 100 + percent) - F.greatest(up(n * percent, 100), up(m * percent, 100)) + 1
    return (least <= most) & (shared >= F.least(need(least), need(most)) - F.when(least < most, 1).otherwise(0))


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many tokens each of the left sets shares with each of the right ones; a side is its sets' tokens and their offsets."""
    nl, nr = len(left[1]) - 1, len(right[1]) - 1
    out = np.zeros((nl, nr), np.int32)
    owners = [np.repeat(np.arange(len(o) - 1), np.diff(o)) for _, o in (left, right)]
    columns = np.intersect1d(left[0], right[0])
    if not len(columns):
        return out
    sides = []
    for (values, _), owner in zip((left, right), owners):
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        known = columns[at] == values
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], owner[known][order], np.bincount(at[known], minlength=len(columns))))
    (lc, lo, ln), (rc, ro, rn) = sides
    common = ln * rn * DENSE > nl * nr
    dense = np.flatnonzero(common)
    place = np.cumsum(common) - 1
    width = max(1, CELLS // max(nl, nr))
    for c in range(0, len(dense), width):
        own = dense[c : c + width]
        made = []
        for col, owner, n in ((lc, lo, nl), (rc, ro, nr)):
            a, b = np.searchsorted(col, own[0]), np.searchsorted(col, own[-1], side="right")
            on = common[col[a:b]]
            m = np.zeros((n, len(own)), np.float32)
            m[owner[a:b][on], place[col[a:b][on]] - c] = 1
            made.append(m)
        out += (made[0] @ made[1].T).astype(np.int32)
    rare = ~common[lc]
    lc, lo = lc[rare], lo[rare]
    first, many = np.searchsorted(rc, lc), rn[lc]
    ends = np.cumsum(many)
    i = 0
    while i < len(lc):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
        n = many[i:j]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)
        out += np.bincount(np.repeat(lo[i:j], n) * nr + ro[where], minlength=nl * nr).reshape(nl, nr).astype(np.int32)
        i = j
    return out


def picked(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of these rows, one after the other, and their offsets."""
    n = np.diff(offsets)[rows]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(offsets[:-1][rows], n)
    return values[at], np.concatenate([[0], ends])


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its component, after uniting the places a with the places b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def alike(same: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes link that share so many tokens."""
    return (same > 0) & (100 * same.astype(np.int64) >= percent * (left[:, None] + right[None, :] - same))


def slices(gid: np.ndarray) -> list[np.ndarray]:
    """The places of each group."""
    order = np.argsort(gid, kind="stable")
    return np.split(order, np.flatnonzero(gid[order][1:] != gid[order][:-1]) + 1) if len(gid) else []


def united_chunks(rows: pa.Table, k: int, percent: int) -> pa.Table:
    """Of one bin of chunks: links a, b that unite what is linked within a chunk, from each member of a component to its hub, the set with the most common tokens."""
    rows = rows.combine_chunks()
    doc = rows.column("doc").to_numpy()
    values, offsets = text.shingle_sets(text.unpacked(rows.column("text")), k) if rows.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    n = np.diff(offsets)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in slices(rows.column("gid").to_numpy()):
        own = own[n[own] > 0]
        if len(own) < 2:
            continue
        v, o = picked(values, offsets, own)
        size = np.diff(o)
        _, inverse, held = np.unique(v, return_inverse=True, return_counts=True)
        central = np.add.reduceat(held[inverse], o[:-1]) / size
        label, hub = np.arange(len(own)), np.array([int(central.argmax())])
        near = alike(shared_counts(picked(v, o, hub), (v, o)), size[hub], size, percent)[0]
        near[hub] = True
        label[near] = np.flatnonzero(near)[0]
        rest, step = np.flatnonzero(~near), max(1, CELLS // len(own))
        for at in range(0, len(rest), step):
            part = rest[at : at + step]
            x, y = np.nonzero(alike(shared_counts(picked(v, o, part), (v, o)), size[part], size, percent))
            label = united(label, part[x], y)
        order = np.lexsort((doc[own], -central, label))
        head = np.append(True, label[order][1:] != label[order][:-1])
        hubs = order[head][np.cumsum(head) - 1]
        a.append(doc[own[order[~head]]])
        b.append(doc[own[hubs[~head]]])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def overlaps(rows: pa.Table, k: int, percent: int) -> pa.Table:
    """Of one bin of groups: links between a group's queries and its members, at most as many as unite the components that they belong to."""
    rows = rows.combine_chunks()
    doc, comp = rows.column("doc").to_numpy(), rows.column("comp").to_numpy()
    member = rows.column("member").to_numpy(zero_copy_only=False).astype(bool)
    values, offsets = text.shingle_sets(text.unpacked(rows.column("text")), k) if rows.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    n = np.diff(offsets)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in slices(rows.column("gid").to_numpy()):
        held, asks = own[member[own] & (n[own] > 0)], own[~member[own] & (n[own] > 0)]
        if not len(held) or not len(asks):
            continue
        inside = picked(values, offsets, held)
        union = np.unique(inside[0])
        v, o = picked(values, offsets, asks)
        met = union[np.minimum(np.searchsorted(union, v), len(union) - 1)] == v
        bound = np.add.reduceat(met.astype(np.int64), o[:-1])  # the query's overlap with the group's union
        asks = asks[100 * bound >= percent * n[asks]]
        found, step = np.unique(comp[own], return_inverse=True)[1], max(1, CELLS // len(held))
        where = np.zeros(len(comp), np.int64)
        where[own] = found
        label = np.arange(found.max() + 1)
        for at in range(0, len(asks), step):
            part = asks[at : at + step]
            x, y = np.nonzero(alike(shared_counts(picked(values, offsets, part), inside), n[part], n[held], percent))
            x, y = part[x], held[y]
            p, q = label[where[x]], label[where[y]]
            first = np.unique(np.minimum(p, q) * len(label) + np.maximum(p, q), return_index=True)[1]
            first = first[(p != q)[first]]
            a.append(doc[x[first]])
            b.append(doc[y[first]])
            label = united(label, where[x], where[y])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and the compressed text of the rows of docs whose doc may be in ids, so that the join which follows shuffles little else.

    A bitmap of hashed ids decides; its size is fixed (MARKS bits, 8 MiB), so more ids only let more rows through to the join, which is exact."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc"), F.lit(MARKS))
    marks = ids.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(MARKS // 64, np.uint64)
    bitmap[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in text.chunks(batches):
            at = batch.column("place").to_numpy()
            on = sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            batch = batch.filter(pa.array(on.astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), text.compressed(batch.column("text"))], ["doc", "text"])

    return text.mapped(docs.select("doc", "text", place.alias("place")), run, "doc long, text binary")


def weight() -> Column:
    return F.col("n") + ROW_WORDS


def united_families(docs: DataFrame, members: DataFrame, k: int, percent: int, bin_words: int) -> tuple[DataFrame, bool]:
    """Links a, b within chunks of bounded size of the families of members (family, doc, n); and whether a family has several chunks."""
    spark = docs.sparkSession
    sizes = members.groupBy("family").agg(F.ceil(F.sum(weight()) / bin_words).cast("int").alias("chunks"))
    dealt = members.join(sizes, "family").select(F.xxhash64("family", F.pmod(F.xxhash64("doc"), F.col("chunks"))).alias("gid"), "doc", "n", "chunks")
    dealt = staged(dealt, "chunks")
    total, most = dealt.agg(F.sum(weight()), F.max("chunks")).first()
    bins = max(default_parallelism(spark), -(-(total or 0) // bin_words))
    dealt = dealt.select("gid", "doc", F.pmod(F.xxhash64("gid"), F.lit(bins)).alias("bin"))
    ship_package(spark)
    found = packed_texts(docs, dealt.select("doc")).join(dealt, "doc").groupBy("bin").applyInArrow(lambda t: united_chunks(t, k, percent), "a long, b long")
    return staged(found, "chunk_links"), (most or 0) > 1


def opened(docs: DataFrame, queries: DataFrame, members: DataFrame, k: int, percent: int, bin_words: int) -> DataFrame:
    """Links a, b between queries and members (both gid, doc, n, comp) of the same group.

    Groups are dealt to bins of bounded size; a bin with many queries is salted, and its members go to all its salts."""
    spark = docs.sparkSession
    both = queries.select("gid", "doc", "n", "comp", F.lit(False).alias("member")).unionByName(members.select("gid", "doc", "n", "comp", F.lit(True).alias("member")))
    both = staged(both, "opened")
    total = both.agg(F.sum(weight())).first()[0] or 0
    bins = max(default_parallelism(spark), -(-total // bin_words))
    both = both.withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(bins)))
    salts = both.groupBy("bin").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("member"), 0).otherwise(weight())) / bin_words)).cast("int").alias("salts"))
    salt = F.when(F.col("member"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")))
    dealt = both.join(salts, "bin").select("bin", "gid", "doc", "member", "comp", F.explode(salt).alias("salt"))
    ship_package(spark)
    return packed_texts(docs, both.select("doc")).join(dealt, "doc").groupBy("bin", "salt").applyInArrow(lambda t: overlaps(t, k, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that is reachable, of all nodes of the links a, b; by large-star and small-star rounds."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = staged(down.where("u <> v").distinct(), "links")
        after = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(after) == tuple(state):
            break
        state = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def link_similar(docs: DataFrame, k: int = K, percent: int = PERCENT, bin_words: int = BIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles and component_id, one row for each row of docs.

    A set holds the distinct runs of k words (A-Z in lower case, parted by ASCII white space); fewer words are one token,
    and null and empty texts an empty set, which links with nothing. Sets link if 100 * intersection >= percent * union;
    component_id is the smallest id that links reach. Rows of one id count as one document, linked by what any of them links
    with; those of a null id link with nothing and have a null component_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    known = rows.where("doc IS NOT NULL AND text <> ''")
    often = spark.sparkContext.broadcast(frequent_tokens(known, k))
    signed = staged(signatures(rows.select("doc", F.lit(0).cast("long").alias("row"), "text"), often, k).drop("row"), "sets")
    classes = signed.where("n > 0 AND doc IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = staged(classes, "classes")

    keyed = classes.select("rep", F.posexplode("keys").alias("j", "key"))
    centers = keyed.groupBy("j", "key").agg(F.min("rep").alias("gid"), F.max("rep").alias("last")).where("gid < last").drop("last")
    nearest = staged(keyed.join(centers, ["j", "key"]).groupBy("rep").agg(F.min("gid").alias("family")), "nearest")
    near = nearest
    for _ in range(HOPS):
        near = near.join(nearest.select(F.col("rep").alias("family"), F.col("family").alias("next")), "family").select("rep", F.col("next").alias("family"))
    members = staged(classes.join(near, "rep").select("family", F.col("rep").alias("doc"), "n"), "families")
    links, several = united_families(known, members, k, percent, bin_words)
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    if several:
        hubs = links.select(F.col("b").alias("doc")).distinct().join(members, "doc")
        more, _ = united_families(known, hubs.select("family", "doc", "n"), k, percent, bin_words)
        links = links.unionByName(more)
        above = more.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("top"))
        labels = labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")).unionByName(above.select(F.col("label").alias("node"), F.col("top").alias("label")))
    labels = staged(labels.groupBy("node").agg(F.min("label").alias("label")), "labels")

    grouped = classes.select("s1", "s2", "rep", "n").join(labels, F.col("rep") == F.col("node"), "left").join(members.select("family", F.col("doc").alias("node_")).distinct(), F.col("rep") == F.col("node_"), "left")
    grouped = grouped.select("s1", "s2", "rep", "n", F.coalesce("label", "rep").alias("comp"), F.coalesce("family", "rep").alias("family"))
    leads = grouped.groupBy("family", "comp").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("leading"))
    grouped = grouped.join(leads, "family").withColumn("group", F.xxhash64("family", F.col("comp") == F.col("leading"), F.floor(F.ln("n") / F.ln(F.lit(SIZES)))))
    about = grouped.groupBy("group").agg(F.count("*").alias("size"), F.sum(weight()).alias("words"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("lead"), F.max("comp").alias("last"))
    grouped = staged(grouped.drop("family", "leading").join(about, "group"), "groups")

    posts = staged(settled_postings(known, often.value, k, percent).join(grouped.drop("s2"), "s1").drop("s1"), "postings")
    facts = ["words", "low", "high", "lead", "last"]
    matrix = posts.select("token", F.col("group").alias("gid"), F.col("size").alias("gsize"), *facts).distinct()
    # A group's own classes query it unless they are in its leading component; of two groups the smaller one's classes query.
    own = (F.col("group") == F.col("gid")) & (F.col("comp") != F.col("lead"))
    other = (F.col("group") != F.col("gid")) & ((F.col("size") < F.col("gsize")) | (F.col("size") == F.col("gsize")) & (F.col("group") > F.col("gid")))
    joined = (F.col("lead") == F.col("last")) & (F.col("lead") == F.col("comp"))
    met = posts.select("token", "rep", "n", "comp", "group", "size").join(matrix, "token").where((own | other) & ~joined)
    met = met.groupBy("rep", "n", "comp", "gid", "words", "low", "high").agg(F.count("*").alias("shared"))
    asked = staged(met.where(may_link(F.col("n"), F.col("low"), F.col("high"), F.col("shared"), percent)).select("rep", "n", "comp", "gid", "words"), "asked")

    chunks = F.ceil(F.col("words") / bin_words).cast("int")
    needed = asked.select(F.col("gid").alias("group")).distinct()
    inside = grouped.join(needed, "group", "left_semi").select(F.xxhash64("group", F.pmod(F.xxhash64("rep"), chunks).cast("int")).alias("gid"), F.col("rep").alias("doc"), "n", "comp")
    outside = asked.withColumn("part", F.explode(F.sequence(F.lit(0), chunks - 1))).select(F.xxhash64("gid", "part").alias("gid"), F.col("rep").alias("doc"), "n", "comp")
    more = opened(known, outside, inside, k, percent, bin_words)
    sets = F.struct("s1", "s2")
    repeated = signed.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low < high").select("doc")
    same_id = signed.where("n > 0").join(repeated, "doc").join(classes, ["s1", "s2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    # What is united already is one node each.
    edges, node = links.unionByName(more).unionByName(same_id), labels.select("node", "label")
    for end in ("a", "b"):
        edges = edges.join(node, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("label", end)).drop("node", "label")
    roots = components(edges)
    rooted = grouped.select("s1", "s2", "rep", "comp").join(roots, F.col("comp") == F.col("node"), "left").select("s1", "s2", "rep", F.coalesce("label", "comp").alias("root"))
    final = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("s1", "s2", "component")
    out = signed.join(final, ["s1", "s2"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its group of similar documents; rows of a null id stay."""
    links = link_similar(docs, id_column=id_column, **options)
    gone = links.where("component_id < doc_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(gone, id_column, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
