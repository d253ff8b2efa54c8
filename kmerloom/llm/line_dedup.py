"""Line dedup by overlapping windows of three consecutive lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.llm._repeats import remove_later

#: Lines in a window.
WINDOW = 3


def line_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text reduced to the lines that no later window covers; adds n_lines and n_removed, under other names if given.

    Lines are what newlines separate, unchanged. Every three consecutive lines of a document form a window; a window is
    later if the same three lines start in a row of smaller id or further up in the same row. Lines in later windows go.
    A document of fewer lines has no window and keeps all. Null text stays null with no lines; an empty text is one empty
    line. Rows that share an id count as separate documents in the order of their texts, null ids come first, and of
    equal rows all but one are later copies. Other columns pass through, and those of the two names are replaced. Texts of any
    length are taken whole: one that is longer than a block is a block of its own. An empty table gives none.
    """
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def finish(table: pa.Table, first: np.ndarray, marked: np.ndarray) -> pa.Table:
        texts, lines, gone = [], [], []
        for x, a, b in zip(table[text_col].to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = marked[a:b]
            texts.append(x if x is None or not own.any() else "\n".join(s for s, m in zip(x.split("\n"), own, strict=True) if not m))
            lines.append(0 if x is None else b - a)
            gone.append(0 if x is None else int(own.sum()))
        table = table.set_column(at, text_col, pa.array(texts, pa.string()))
        return table.append_column(names[0], pa.array(lines, pa.int64())).append_column(names[1], pa.array(gone, pa.int64()))

    schema = docs.withColumns({n: F.lit(0).cast("long") for n in names}).schema
    return remove_later(docs, C.line_spans, window, finish, schema, id_col, text_col)
