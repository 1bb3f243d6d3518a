"""Lines that recur across documents, by levelled sorted runs of line hashes; DataFrame functions only.

Documents come in batches. A batch's line hashes are merge-joined with the runs so far, which tell the keys that an
earlier batch owns; the keys that none of them knows become a sorted run of their own. When a level holds `fanout` runs
they are compacted into one of the next level, so a batch meets few runs however many came before. Runs outlive a call:
dedup_batch() takes and extends them, and Runs.state() and Runs.restore() carry them to another session.

Keys are told apart by 128 bits of two hashes, so unequal lines count as equal with a chance of 2^-128 a pair.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import default_parallelism, new_folder, restored_by, staged_by

# What is stripped from a line's ends, and the least key.
STRIPPED = " \t\n\x0b\f\r"
LEAST_KEY = 10
BATCHES, FANOUT = 4, 2
HOT = 10_000  # a line that makes up more than one in so many lines of a batch is hot; so at most HOT of them are


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(STRIPPED)), ascii_uppercase, ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """batch, doc, row (a hash of its text), pos, and the 128-bit hash h1, h2 of each key that is long enough."""
    lines = docs.where("doc IS NOT NULL").select("batch", "doc", F.xxhash64("text").alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("batch", "doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("batch", "doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class Runs:
    """Sorted runs (h1, h2, owner) in levels, each bucketed like the joins that read it."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout, self.levels = buckets, fanout, []

    def state(self) -> dict:
        """What restore() needs: the sizes, and the tables of each level with their folders."""
        return {"buckets": self.buckets, "fanout": self.fanout, "levels": [[run.inputFiles()[0].rsplit("/", 1)[0] for run in level if run.inputFiles()] for level in self.levels]}

    @classmethod
    def restore(cls, spark: SparkSession, state: dict) -> Runs:
        out = cls(state["buckets"], state["fanout"])
        # The tables are those of _put(), or of a batch's keys; of these, keys with an owner are an earlier run's.
        tables = [[restored_by(spark, folder, "h1 long, h2 long, owner long, first long", ["h1", "h2"], out.buckets) for folder in level] for level in state["levels"]]
        out.levels = [[t.where("owner IS NULL OR first IS NULL").select("h1", "h2", F.coalesce("owner", "first").alias("owner")) for t in level] for level in tables]
        return out

    def owners(self, keys: DataFrame) -> DataFrame:
        """keys with `owner`, the document of an earlier batch that holds the key, or null."""
        out = keys.withColumn("owner", F.lit(None).cast("long"))
        for run in (r for level in self.levels for r in level):
            found = run.select("h1", "h2", F.col("owner").alias("known")).hint("merge")
            out = out.join(found, ["h1", "h2"], "left").withColumn("owner", F.coalesce("owner", "known")).drop("known")
        return out

    def add(self, run: DataFrame) -> None:
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        own = self.levels[level]
        own.append(run)
        if len(own) >= self.fanout:
            merged = own[0]
            for other in own[1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._put(level + 1, staged_by(merged, ["h1", "h2"], self.buckets, "line_run"))


def _hits(own: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """doc, row and pos of the lines whose key (h1, h2, owner, last, c lines of it) a smaller document owns.

    Hot keys are few by their definition, so they are broadcast and their lines stay where they are; the others are joined by key."""
    keys = keys.where("owner < last")
    hot = F.col("c") > max(1, total // HOT)
    few = F.broadcast(keys.where(hot).select("h1", "h2", F.col("owner").alias("hot_owner")))
    marked = own.join(few, ["h1", "h2"], "left")
    rest = marked.where("hot_owner IS NULL").join(keys.where(~hot).select("h1", "h2", "owner"), ["h1", "h2"]).where("owner < doc")
    return marked.where("hot_owner < doc").select("doc", "row", "pos").unionByName(rest.select("doc", "row", "pos"))


def find_repeated(docs: DataFrame, runs: Runs, least: int, batches: int, keep: bool) -> DataFrame:
    """doc, row and drops: the positions of the lines of each row that the runs or a smaller document hold. Docs are gone through in batches of ascending id; with `keep` the last one's keys become a run, too."""
    cuts = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted({*(cuts or [])})
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("batch")
    path = new_folder(docs.sparkSession, "line_hashes")
    line_hashes(docs.select("doc", "text", batch), least).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    hashes = docs.sparkSession.read.schema("doc long, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    totals = dict(hashes.groupBy("batch").count().collect())
    repeated = None
    for i in range(len(cuts) + 1):
        own = hashes.where(F.col("batch") == i).drop("batch")
        firsts = own.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("c"))
        known = staged_by(runs.owners(firsts), ["h1", "h2"], runs.buckets, "line_keys")
        if keep or i < len(cuts):
            runs.add(known.where("owner IS NULL").select("h1", "h2", F.col("first").alias("owner")))
        # What an earlier batch owns goes everywhere here: its owner stands below all ids of this batch.
        keys = known.select("h1", "h2", F.when(F.col("owner").isNull(), F.col("first")).otherwise(F.lit(-(1 << 63))).alias("owner"), "last", "c")
        hits = _hits(own, keys, totals.get(i, 0))
        repeated = hits if repeated is None else repeated.unionByName(hits)
    return repeated.groupBy("doc", "row").agg(F.collect_set("pos").alias("drops"))


def dedup_batch(docs: DataFrame, runs: Runs, least: int = LEAST_KEY, batches: int = 1, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """As dedup_lines(), for a new batch of documents after those that the runs know: a line that an earlier batch holds goes from all of the new documents, whatever their ids. The new lines become a run."""
    counts = ("n_lines__", "n_dropped__")
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    drops = find_repeated(slim, runs, least, batches, keep)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("src"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), F.col(f"`{id_column}`").cast("long").alias("doc"))
    out = rows.withColumn("row", F.xxhash64("text")).join(drops, ["doc", "row"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    return out.select(
        *(text.alias(c) if c == text_column else F.col("src")[c].alias(c) for c in docs.columns if c not in counts),
        F.size("lines").cast("long").alias(counts[0]),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(counts[1]),
    )


def dedup_lines(docs: DataFrame, least: int = LEAST_KEY, batches: int = BATCHES, fanout: int = FANOUT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with the kept text, and n_lines__ and n_dropped__ before and of the drop.

    A line whose key has at least `least` code points and occurs in several documents stays only in the smallest id that
    holds it, there at all its places. Null and empty texts are one empty line and become empty texts. Rows of a null id
    keep their lines and own none; rows of one id count as one document, each keeping its own lines. All columns stay, but
    for columns named n_lines__ or n_dropped__, which the counts replace.
    """
    runs = Runs(default_parallelism(docs.sparkSession), fanout)
    return dedup_batch(docs, runs, least, batches, id_column, text_column, keep=False)
