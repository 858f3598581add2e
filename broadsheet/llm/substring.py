"""Substring dedup (operator 2): words covered by windows that stand anywhere else go, found by level-wise doubling.

Words are runs of characters other than the six ASCII white-space characters, unchanged. Windows of `length` words are
compared at 9 words, then 18, then whole (see repeats); a window that is alone at one level is never extended.
Windows are judged on the input, so every copy of a repeated passage goes, the first included.

Null or empty text: no words. Texts shorter than a window keep everything. Repeated rows are copies of each other, so
their windows repeat. Empty table: no rows. A text of any length is handled in pieces that share length - 1 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .hashing import WordHashes, mixed

_hashes = WordHashes()


def word_symbols(text: bytes) -> np.ndarray:
    words = text.split()  # bytes: exactly the six ASCII spaces
    return mixed(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))


def remove(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space, UTF-8) of docs (doc_id, text)."""
    placed = repeats.numbered(docs.select("doc_id", "text"))
    found = repeats.spans(placed, word_symbols, length, max(1, -(-length // 4)), extend=True)

    @F.pandas_udf("n_words long, n_removed long, kept binary")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans_of in batches:
            rows = []
            for text, spans in zip(texts, spans_of, strict=True):
                words = (text or b"").split()
                gone = repeats.covered(len(words), spans, length)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    joined = placed.join(found, "at", "left")
    return joined.select("doc_id", without(F.col("text").cast("binary"), "spans").alias("r")).select("doc_id", "r.*")
