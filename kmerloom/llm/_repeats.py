"""Repeated windows of units (words, lines) over a whole corpus, first occurrence kept.

Documents are dealt once into blocks by a hash of their id, text and other columns; that one exchange of texts feeds
every pass. The number of blocks follows from the bytes of text, so a block stays as small at any size. A block sends
each distinct window hash once, however often it stands in the block, so a passage that a third of all documents share
costs one entry a block. Buckets of hashes, as many as the text needs, answer each block with those of its hashes whose
first occurrence lies in another block; what repeats inside a block is settled there. A block sends a row to a bucket
only if it has hashes for it, so there are never more rows than hashes. Windows are compared by 128 bits of hash;
answers name them by 96, enough within a block. Ids travel by byte place, so that their common high bytes compress away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C

#: Bytes of text in a block, and bytes of text whose hashes go to one bucket.
BLOCK_BYTES, BUCKET_BYTES = 1 << 22, 1 << 24
_NONE = np.zeros(0, np.uint64)


def blocked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, int]:
    """docs dealt into blocks, the name of the column that tells them, and the number of buckets.

    There are at least as many blocks and buckets as shuffle partitions, so that every task has some. Rows of one id,
    or of none, are dealt by their texts, and copies by the plain columns beside; only rows that repeat all of these lie
    in one block.
    """
    n = C.shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    plain = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and kind in ("string", "bigint", "int", "boolean", "date", "timestamp")]
    own, blk = F.xxhash64(id_col, text_col, *plain), C.free_name(docs, "blk")
    return docs.withColumn(blk, F.pmod(own, F.lit(max(n, -(-size // BLOCK_BYTES))))).repartition(n, blk), blk, max(n, -(-size // BUCKET_BYTES))


class Block:
    """The documents of one block in (id, text) order, with two hashes for each unit."""

    def __init__(self, table: pa.Table, split, id_col: str, text_col: str):
        keys = pa.table({"id": pa.array(C.ids_of(table[id_col])), "text": table[text_col]})
        self.table = table.take(pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")], null_placement="at_start")) if len(table) else table
        self.ids = C.ids_of(self.table[id_col])
        data, offsets = C.text_bytes(self.table[text_col])
        parts, counts = ([], []), [np.zeros(1, np.int64)]
        for a, b in C.chunks(offsets):
            at = offsets[a : b + 1] - offsets[a]
            own = data[offsets[a] : offsets[b]]
            starts, ends, first = split(own, at)
            for lane in (0, 1):
                parts[lane].append(C.byte_hash(own, starts, ends, lane))
            counts.append(np.diff(first))
        self.first = np.cumsum(np.concatenate(counts))
        self.units = [np.concatenate(p) if p else _NONE for p in parts]

    def starts(self, length: int) -> np.ndarray:
        """Every index at which a window of so many units of one document starts."""
        n = len(self.units[0])
        end = np.repeat(self.first[1:], np.diff(self.first))
        return np.flatnonzero(np.arange(n) + length <= end)

    def hashes(self, starts: np.ndarray, length: int, lanes=(0, 1)) -> list[np.ndarray]:
        return [C.range_hash(self.units[x], starts, starts + length, x) for x in lanes]

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, "right") - 1


def slices(h1: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted hashes, for the buckets that have some."""
    own = ((h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1), append=own[-1:] + np.uint64(1))).tolist()
    return list(zip(own[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True))


def _concat(column, dtype) -> np.ndarray:
    parts = C.unpacked(column, dtype)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T


def _from_planes(column) -> np.ndarray:
    parts = [p.reshape(8, -1).T.copy().view(np.int64).ravel() for p in C.unpacked(column, np.uint8)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _owners(table: pa.Table) -> np.ndarray:
    sizes = np.array([len(x) // 8 for x in table["h1"].to_pylist()], np.int64)
    return np.repeat(np.asarray(table["blk"], dtype=np.int64), sizes)


def _by_block(owner, h1, h2) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    owner, h1, h2 = owner[order], h1[order], h2[order]
    blocks, at = np.unique(owner, return_index=True)
    at = [*at, len(owner)]
    cut = list(zip(at[:-1], at[1:], strict=True))
    return pa.table({"_blk": pa.array(blocks, pa.int64()), "h1": C.packed([h1[a:b] for a, b in cut], pa.binary()), "h2": C.packed([h2[a:b] for a, b in cut], pa.binary())})


def _short(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype(np.uint32)


def answer_repeated(table: pa.Table) -> pa.Table:
    """To each block, its hashes that another block has too."""
    h1, owner = _concat(table["h1"], np.uint64), _owners(table)
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    many = np.zeros(len(h1), bool)
    many[1:] |= same
    many[:-1] |= same
    found = order[many]
    return _by_block(owner[found], h1[found], np.zeros(len(found), np.uint32))


def answer_later(table: pa.Table) -> pa.Table:
    """To each block, its windows that start earlier in another block."""
    h1, h2, doc, owner = _concat(table["h1"], np.uint64), _concat(table["h2"], np.uint64), _from_planes(table["doc"]), _owners(table)
    order = np.lexsort((doc, h2, h1))
    h1, h2, owner = h1[order], h2[order], owner[order]
    later = np.zeros(len(h1), bool)
    later[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    return _by_block(owner[later], h1[later], _short(h2[later]))


ASKED = "bucket int, blk long, h1 binary, h2 binary, doc binary"
ANSWER = "_blk long, h1 binary, h2 binary"


def _ask(block: int, buckets: int, h1, h2, doc) -> pa.Table:
    cut = slices(h1, buckets)
    return pa.table(
        {"bucket": pa.array([b for b, _, _ in cut], pa.int32()), "blk": pa.array([block] * len(cut), pa.int64())}
        | {n: C.packed([x[a:b] for _, a, b in cut], pa.binary()) for n, x in (("h1", h1), ("h2", h2))}
        | {"doc": C.packed([_planes(doc[a:b]) for _, a, b in cut], pa.binary())}
    )


def ask_windows(key, block: Block, starts: np.ndarray, length: int, buckets: int) -> pa.Table:
    """The first occurrence in this block of each distinct window that starts at one of the given units."""
    h1, h2 = block.hashes(starts, length)
    order = np.lexsort((starts, h2, h1))
    h1, h2 = h1[order], h2[order]
    head = np.ones(len(h1), bool)
    head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return _ask(key[0].as_py(), buckets, h1[head], h2[head], block.ids[block.doc_of(starts[order][head])])


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _concat(table["h1"], np.uint64), _concat(table["h2"], np.uint32)


def remove_later(docs: DataFrame, split, length: int, finish, schema: str, id_col: str, text_col: str, cover=None) -> DataFrame:
    """Mark each unit in a window of so many units that starts earlier (smaller id, or earlier in the same document).

    split: bytes and offsets to starts, ends and first unit of each document. finish: the block's sorted table, its
    first units, and which units are marked, to an Arrow table of the given schema. cover: (period, positions, anchor
    length) of a difference cover; then only windows that hold a repeated anchor are sent.
    """
    base, blk, buckets = blocked(docs, id_col, text_col)

    def load(table):
        return Block(table, split, id_col, text_col)

    def anchors_of(block: Block):
        period, positions, size = cover
        starts = block.starts(size)
        local = starts - block.first[block.doc_of(starts)]
        starts = starts[np.isin(local % period, positions)]
        return starts, block.hashes(starts, size, (0,))[0]

    def ask_anchors(key, table):
        h = np.unique(anchors_of(load(table))[1])
        return _ask(key[0].as_py(), buckets, h, h[:0], h[:0].view(np.int64))

    def candidates(block: Block, known: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor found elsewhere or twice here."""
        at, h = anchors_of(block)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        if len(known):
            known = np.sort(known)
            twice |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        hits = np.zeros(len(block.units[0]) + 1, np.int64)
        hits[at[twice] + 1] = 1
        hits = np.cumsum(hits)  # hits[i]: anchors before unit i
        starts = block.starts(length)
        return starts[hits[starts + cover[0]] > hits[starts]]

    def ask_candidates(key, table, known):
        if not len(table):
            return _ask(0, buckets, _NONE, _NONE, _NONE.view(np.int64))
        block = load(table)
        return ask_windows(key, block, candidates(block, answered(known)[0]), length, buckets)

    def ask_all(key, table):
        block = load(table)
        return ask_windows(key, block, block.starts(length), length, buckets)

    def close(key, table, elsewhere):
        if not len(table):
            return pa.table({})
        block = load(table)
        starts = block.starts(length)
        h1, h2 = block.hashes(starts, length)
        later = C.later_local(h1, h2) | C.lookup(h1, _short(h2), *answered(elsewhere))
        return finish(block.table.drop_columns([blk]), block.first, C.covered(len(block.units[0]), starts[later], length))

    if cover:
        anchors = base.groupBy(blk).applyInArrow(ask_anchors, ASKED).groupBy("bucket").applyInArrow(answer_repeated, ANSWER)
        asked = base.groupBy(blk).cogroup(anchors.groupBy("_blk")).applyInArrow(ask_candidates, ASKED)
    else:
        asked = base.groupBy(blk).applyInArrow(ask_all, ASKED)
    later = asked.groupBy("bucket").applyInArrow(answer_later, ANSWER)
    return base.groupBy(blk).cogroup(later.groupBy("_blk")).applyInArrow(close, schema)
