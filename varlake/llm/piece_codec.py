"""SentencePiece encoding and decoding of whole texts, equal to the library's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pieces, text


def encode_decode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, ids array<int> (no begin or end ids) and decoded string, one row for each row of docs.

    Words are merged in vectorised rounds, each distinct word of a slice once; the pieces' bytes give the decoded text.
    Null and empty texts give no ids and an empty text; repeated rows stay; other columns aren't read.
    """

    def run(batches):
        model = pieces.load(model_path)
        def make(keys):
            ids, offsets = model.encoded([pieces.spelled(k) for k in keys])
            data, cuts = ids.tobytes(), (4 * offsets).tolist()
            return zip([data[a:b] for a, b in zip(cuts, cuts[1:])], model.decoded(ids, offsets))

        memo = pieces.Memo(make)
        for batch in text.chunks(batches, "text_"):
            units = [pieces.units(t or "") for t in batch.column("text_").to_pylist()]
            memo.learn(units)
            packed, out = [], []
            for u in units:
                found = [memo[k] for k in u]
                packed.append(b"".join([i for i, _ in found]))
                out.append("".join([d for _, d in found])[1:])
            offsets = np.cumsum([0, *map(len, packed)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id_"), ids, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    cols = docs.select(F.col(id_column).cast("long").alias("id_"), F.col(text_column).alias("text_"))
    return text.mapped(cols, run, "doc_id long, ids array<int>, decoded string")
