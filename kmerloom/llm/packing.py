"""Sequence packing along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kmerloom.llm import _common as C
from kmerloom.llm import _tokens

#: Tokens in a sequence, id after each document.
LENGTH, END_ID = 2048, 1
#: Buckets of the hashed document vector, dimensions of the curve, bits of each.
BUCKETS, DIMS, CURVE_BITS = 64, 3, 16


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Position of integer cells (rows of coordinates below 2**bits) on the Hilbert curve.

    Level by level from the top: the orthant's Gray-code rank is appended, and the lower bits are mirrored or swapped to
    follow the orientation of the curve in that orthant.
    """
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            high = (x[d] >> level) & 1 == 1
            swapped = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swapped)
            x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


_GEN = np.random.Generator(np.random.PCG64(5))
_BUCKET = _GEN.integers(0, BUCKETS, 1 << 16)
_AXES = _GEN.normal(size=(BUCKETS, DIMS))


def curve_cells(vectors: np.ndarray) -> np.ndarray:
    """Hashed vectors to cells: log counts, unit length, random projection, squashed to 2**CURVE_BITS steps."""
    v = np.log1p(vectors)
    v = v - v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return np.clip((np.tanh(v @ _AXES) + 1) / 2 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)


def _powers(pieces: list[tuple], total: int) -> list[list[tuple]]:
    """Pieces (key, start, raw, n) of so many ids in all, as sequences whose lengths are the powers of two of that sum."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        own = []
        while room:
            key, start, raw, n = left.pop()
            size = min(room, len(raw) // 4)
            own.append((key, start, raw[: 4 * size], n))
            if 4 * size < len(raw):
                left.append((key, start + size, raw[4 * size :], n))
            room -= size
        if own:
            out.append(own)
    return out


def pack_documents(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, tokens (little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its token ids (null or empty text: none) and end_id. Documents are range-sorted by the Hilbert key of
    their projected token counts, ties by id, so equal keys spread over partitions. Each partition lays its documents
    end to end and cuts every length tokens; what is left at its end becomes sequences of power-of-two lengths, so no
    sequence needs padding beyond its own length. sequence_id is the partition times
    2**32 plus a count. start counts the ids of the document before the piece, offset those of the sequence. Repeated
    rows are packed each for itself; columns besides id and text are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    path = tokenizer or _tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def tokens(batches):
        own = _tokens.encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        wide = not own.small or end_id >= 1 << 16
        for batch in C.small_batches(batches):
            n = batch.num_rows
            ids, vectors = [], np.zeros((n, BUCKETS))
            for i, text in enumerate(batch.column(1)):
                raw = np.frombuffer(own.encode(text.as_py()) + end, "<u4")
                vectors[i] = np.bincount(_BUCKET[raw & 0xFFFF], minlength=BUCKETS)
                ids.append(raw.tobytes() if wide else raw.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(hilbert_key(curve_cells(vectors)), pa.int64())], [id_col, "ids", "key"])

    small = _tokens.encoder(path).small and end_id < 1 << 16
    width = "<u2" if small else "<u4"
    names = [id_col, "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        base, count, room, open_pieces, kinds = TaskContext.get().partitionId() << 32, 0, length, [], None

        def rows_of(sequences):
            nonlocal count
            out = [[] for _ in names]
            for pieces in sequences:
                offset = 0
                for key, start, raw, n in pieces:
                    for column, value in zip(out, (key, start, len(raw) // 4, raw, n, base + count, offset), strict=True):
                        column.append(value)
                    offset += len(raw) // 4
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        for batch in C.small_batches(batches):
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            full = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(ids.as_buffer(), width).astype("<u4").tobytes()
                start, n = 0, len(raw) // 4
                while start < n:
                    size = min(room, n - start)
                    open_pieces.append((key, start, raw[4 * start : 4 * (start + size)], n))
                    start, room = start + size, room - size
                    if not room:
                        full.append(open_pieces)
                        open_pieces, room = [], length
            yield rows_of(full)
        if open_pieces:
            yield rows_of(_powers(open_pieces, length - room))

    encoded = C.materialize(docs.select(id_col, text_col).mapInArrow(tokens, f"`{id_col}` {kind}, ids binary, key long"), "tokens")
    laid = encoded.repartitionByRange(C.shuffle_partitions(spark), "key", id_col).sortWithinPartitions("key", id_col, "ids")
    return laid.select(id_col, "ids").mapInArrow(C.lean(cut), f"`{id_col}` {kind}, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long")
