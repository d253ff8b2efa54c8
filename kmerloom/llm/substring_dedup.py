"""Substring dedup over words by difference-cover anchors.

The residues 0, 1, 3, 9 modulo 13 form a difference cover: for any two starts of an equal stretch of 20 words, some
shift below 13 puts both on cover positions, and the 8 words that follow lie inside both stretches. So hashing 8-word
anchors at 4 of 13 positions finds every repeated stretch; windows that hold a repeated anchor are then extended to all
20 words and compared.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.llm._repeats import remove_later

#: Words in a window.
WINDOW = 20
#: Smallest difference covers by period (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def split_words(data: np.ndarray, offsets: np.ndarray):
    return C.spans(data, offsets, C.SPACE)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text reduced to the words that no earlier window of so many words covers, joined by one space.

    Words are runs of bytes other than 0x09-0x0D and 0x20. A word goes if a window over it has the same words as a
    window that starts earlier: in a row of smaller id, or further left in the same row. Adds n_words and n_removed.
    Null or empty text has no words and comes back empty. Rows that share an id count as separate documents in the order
    of their texts, null ids come first, and of equal rows all but one are later copies. Other columns pass through;
    a column named n_words or n_removed is replaced. Null or repeated rows never fail; an empty table gives none.
    Texts of any length are taken whole: one that is longer than a block is a block of its own.
    """
    period = max((p for p in COVERS if p < window), default=0)
    if not period:
        raise ValueError("a window holds at least 4 words")
    docs = docs.drop("n_words", "n_removed")
    at = docs.columns.index(text_col)

    def finish(table: pa.Table, first: np.ndarray, marked: np.ndarray) -> pa.Table:
        texts = []
        for x, a, b in zip(table[text_col].to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = (x or "").encode().split()
            texts.append(b" ".join(compress(words, ~marked[a:b])) if marked[a:b].any() else b" ".join(words))
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        sums = np.concatenate([[0], np.cumsum(marked)])
        table = table.set_column(at, text_col, kept)
        return table.append_column("n_words", pa.array(np.diff(first), pa.int64())).append_column("n_removed", pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()))

    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return remove_later(docs, split_words, window, finish, schema, id_col, text_col, (period, COVERS[period], window - period + 1))
