"""Token ids and token counts of whole columns of text.

Defined results: null and empty texts have no tokens (an empty list, a count of 0); texts that look like special tokens
are ordinary text; every row gives one row, repeated or not; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import spread
from .bpe import TOKENIZER_DIR, encoder

TOKENIZER = "byte_bpe_50k"


def _ids(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in slices(batches, "text", 4 << 20):
            pieces = enc.encode([t or "" for t in b.column("text").to_pylist()])
            sizes = [sum(map(len, p)) for p in pieces]
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(pieces)), np.int32, sum(sizes))
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "ids"])

    return run


def token_ids(df: DataFrame, id_col: str, text_col: str, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids list of int) of every row, without special tokens."""
    src = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(_ids(name, folder), "key long, ids array<int>").withColumnRenamed("key", id_col)


def token_counter(name: str, folder: str):
    """mapInArrow function: replaces the column text by its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in slices(batches, "text", 4 << 20):
            counts = enc.count([t or "" for t in b.column("text").to_pylist()])
            keep = [k for k in b.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    return run
