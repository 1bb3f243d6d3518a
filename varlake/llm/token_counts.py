"""Token counts without encoding most of the text."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pieces, text


@functools.lru_cache(maxsize=2)
def whole_tokens(model_path: str) -> set[str]:
    """Keys of the words that are proven to encode alone as one token: every vocabulary string goes through the merges once in a worker's life."""
    model = pieces.load(model_path)
    names = [n for n in model.names if n.startswith(pieces.MARK) and pieces.MARK not in n[1:]]
    return {n[1:] for n, size in zip(names, np.diff(model.merged(names)[1])) if size == 1}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens), one row for each row of docs.

    Words that are proven whole tokens count 1 at once; only the others are merged.
    Null and empty texts count 0 bytes and 0 tokens; repeated rows stay; other columns aren't read.
    """

    def run(batches):
        model = pieces.load(model_path)
        whole = whole_tokens(model_path)
        memo = pieces.Memo(lambda keys: np.diff(model.encoded([pieces.spelled(k) for k in keys])[1]).tolist())
        for batch in text.chunks(batches, "text_"):
            texts = [t or "" for t in batch.column("text_").to_pylist()]
            units = [pieces.units(t) for t in texts]
            rest = [[k for k in u if k not in whole] for u in units]
            memo.learn(rest)
            counts = [len(u) - len(r) + sum(map(memo.__getitem__, r)) for u, r in zip(units, rest)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id_"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    cols = docs.select(F.col(id_column).cast("long").alias("id_"), F.col(text_column).alias("text_"))
    return text.mapped(cols, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
