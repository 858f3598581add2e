"""Suffix-array dedup (operator 6): bytes covered by strings that already stood earlier go.

Texts are UTF-8 bytes; matches never cross documents. Of all places of one string of `length` bytes the first, by
doc_id and start, stays, and every byte of the others goes. Strings are judged on the input.

This is not a merge of Burrows-Wheeler transforms, the method that the task names. Such a merge reads whole transforms
in order, so the last one holds the corpus in one task, and refining its interleave costs `length` passes; README has
the figures. Here strings are found through anchors (see repeats): only strings whose anchor repeats are compared.

Null or empty text: no bytes. Rows that repeat a doc_id come in order of text. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

_OF_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def byte_symbols(text: bytes) -> np.ndarray:
    return _OF_BYTE[np.frombuffer(text, np.uint8)]


def remove(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay) of docs (doc_id, text)."""
    placed = repeats.numbered(docs.select("doc_id", "text"))
    found = repeats.spans(placed, byte_symbols, length, max(1, 2 * length // 5), later_only=True)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans_of in batches:
            rows = []
            for text, spans in zip(texts, spans_of, strict=True):
                raw = np.frombuffer(text or b"", np.uint8)
                gone = repeats.covered(len(raw), spans, length)
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((len(raw), int(gone.sum()), runs, raw[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = placed.join(found, "at", "left")
    return joined.select("doc_id", without(F.col("text").cast("binary"), "spans").alias("r")).select("doc_id", "r.*")
