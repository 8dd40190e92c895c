"""Token counts of whole texts; huge ones by overlapping chunks that are spliced together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .tokens import count_each


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, over_limit (more than limit tokens).

    vocabulary is the path of a byte-level BPE file that every executor can read. Texts of
    more than chunk bytes, and those with white space other than blanks and line
    feeds, are encoded in chunks that overlap (see tokens.encode_spliced); others piece by
    piece. A null text counts as empty: no tokens. Repeated rows stay repeated; a null id
    stays null. Other columns are ignored. There is no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            n = count_each(raw, vocabulary, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
