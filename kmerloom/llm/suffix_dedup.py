"""Exact substring dedup over bytes by sampled keepers with one distributed doubling, in place of plain prefix doubling.

A position's rank at length h names the h bytes from it; the rank at 2h is the pair of ranks at the position and h bytes
on. Ranks are 128-bit names of their content, so equal strings meet in one bucket, which sorts the pairs it gets and
answers who shares a rank. Positions whose rank is unique drop out, and so do those that are settled.

Doubling starts at half the length, from sampled positions only: each window of `length` bytes is in the care of the
string of half its length with the least hash among those that start in its first half, so equal windows have equal
keepers, and a keeper that is unique rules out all windows in its care. A keeper cares for a run of neighbouring windows;
where the stretch that the run spans is the only one of its class and repeats, the whole run is settled past the
threshold at once. Only windows of keepers with several such stretches go on to the rank of the full length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.llm._repeats import blocked, slices

#: Bytes of a string that may occur once only.
LENGTH = 200
#: Low bits that hold the position when keepers are compared.
_PLACE = np.uint64(31)
_COLUMNS = ("h1", "h2", "h3", "flag")
_TYPES = (np.uint64, np.uint64, np.uint64, np.uint8)
ASKED = "bucket int, blk long, h1 binary, h2 binary, h3 binary, flag binary"
ANSWER = "_blk long, h1 binary, h2 binary, h3 binary, flag binary"
REPEATS, EXPAND = 1, 2


class Lot:
    """The texts of one block in (id, text) order and the keepers of their windows."""

    def __init__(self, table: pa.Table, length: int, id_col: str, text_col: str):
        keys = pa.table({"id": pa.array(C.ids_of(table[id_col])), "text": table[text_col]})
        self.table = table.take(pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        self.length, self.data, self.offsets = length, *C.text_bytes(self.table[text_col])
        self.cuts = [(int(self.offsets[a]), int(self.offsets[b]), a, b) for a, b in C.chunks(self.offsets)]
        parts = [self._keepers(*cut) for cut in self.cuts]
        self.keep, self.left, self.right = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(list(zip(*parts, strict=True)) or [()] * 3, (np.uint64, np.int64, np.int64), strict=True))

    def _keepers(self, start: int, stop: int, a: int, b: int):
        """(hash of the keeper, first and last window in its care) for the documents a to b."""
        half, n = self.length // 2, stop - start
        if n < self.length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = C.LANES[0].powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(C.LANES[0].code[self.data[start:stop]] * up[:-1], out=sums[1:])
        names = C.mix((sums[half:] - sums[:-half]) * down[: n - half + 1])
        least = (names >> _PLACE << _PLACE) | np.arange(len(names), dtype=np.uint64)
        size, span = 1, self.length - half + 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        count = n - self.length + 1
        least = np.minimum(least[:count], least[span - size : span - size + count])
        at = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
        ends = self.offsets[a : b + 1] - start
        valid = np.zeros(count + 1, np.int64)
        whole = np.flatnonzero(np.diff(ends) >= self.length)
        np.add.at(valid, ends[whole], 1)
        np.add.at(valid, np.minimum(ends[whole + 1] - self.length + 1, count), -1)
        inside = np.cumsum(valid[:count]) > 0
        windows = np.flatnonzero(inside)
        at = at[windows]
        heads = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
        lasts = np.append(heads[1:], len(at)) - 1 if len(at) else heads
        return C.mix(names[at[heads]]), windows[heads] + start, windows[lasts] + start  # least hashes begin with zeros: mixed, they spread over buckets

    def names(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of ascending byte ranges, each within one document."""
        out = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for start, stop, _, _ in self.cuts:
            a, b = np.searchsorted(starts, [start, stop])
            if a < b:
                for lane in (0, 1):
                    out[lane][a:b] = C.range_hash(C.LANES[lane].code[self.data[start:stop]], starts[a:b] - start, ends[a:b] - start, lane)
        return out

    def full_ranks(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at the full length: pairs of the ranks at half of it."""
        half = self.length // 2
        one, two = self.names(windows, windows + half), self.names(windows + half, windows + self.length)
        return tuple(C.mix(x * np.uint64(0x9E3779B97F4A7C15) + y) for x, y in zip(one, two, strict=True))


def _runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): sorting by the columns, and where a new value starts in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order, new


def _ask(block: int, buckets: int, *columns: np.ndarray) -> pa.Table:
    """Columns h1, h2, h3, flag sorted by h1; missing ones are empty."""
    columns = [*columns, *(np.zeros(0, t) for t in _TYPES[len(columns) :])]
    cut = slices(columns[0], buckets)
    named = {n: C.packed([x[a:b].astype(t, copy=False) for _, a, b in cut], pa.binary()) for n, x, t in zip(_COLUMNS, columns, _TYPES, strict=True)}
    return pa.table({"bucket": pa.array([b for b, _, _ in cut], pa.int32()), "blk": pa.array([block] * len(cut), pa.int64())} | named)


def _read(table: pa.Table) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, t), *C.unpacked(table[n], t)]).astype(t, copy=False) for n, t in zip(_COLUMNS, _TYPES, strict=True)]


def _tell(table: pa.Table, found: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """The found entries of the columns, to the blocks that sent them."""
    owner = np.repeat(np.asarray(table["blk"], dtype=np.int64), [len(x) // 8 for x in table["h1"].to_pylist()])
    found = found[np.argsort(owner[found], kind="stable")]
    blocks, at = np.unique(owner[found], return_index=True)
    at = np.append(at, len(found))
    cut = list(zip(at[:-1], at[1:], strict=True))
    columns = [*columns, *(np.zeros(0, t) for t in _TYPES[len(columns) :])]
    named = {n: C.packed([(x[found[a:b]] if len(x) else x).astype(t, copy=False) for a, b in cut], pa.binary()) for n, x, t in zip(_COLUMNS, columns, _TYPES, strict=True)}
    return pa.table({"_blk": pa.array(blocks, pa.int64())} | named)


def answer_shared(table: pa.Table) -> pa.Table:
    """To each block, those of its names that another block has too."""
    h1, h2, _, _ = _read(table)
    keys = (h1, h2) if len(h2) else (h1,)
    order, new = _runs_of(*keys)
    alone = new & np.append(new[1:], True)
    return _tell(table, order[~alone], *keys)


def answer_stretches(table: pa.Table) -> pa.Table:
    """To each block, which of its keepers' stretches repeat, and which must be told apart window by window.

    Where a keeper has one stretch, that repeats or not as a whole. Where it has several, one block that holds a
    stretch expands it, so that windows which two different stretches share are found.
    """
    keep, s1, s2, many = _read(table)
    order, new = _runs_of(keep, s1, s2)
    if not len(order):
        return _tell(table, order, keep, s1)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order)))
    repeats = (sizes > 1) | (np.add.reduceat(many[order].astype(np.int64), heads) > 0)
    own = keep[order[heads]]
    several = np.zeros(len(heads), bool)
    several[1:] |= own[1:] == own[:-1]
    several[:-1] |= own[1:] == own[:-1]
    flags = np.repeat(repeats * REPEATS, sizes)
    flags[heads[several]] |= EXPAND
    out = np.zeros(len(order), np.uint8)
    out[order] = flags
    return _tell(table, np.flatnonzero(out), keep, s1, s2, out)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the remaining bytes).

    A byte goes if a string of so many bytes over it, within its document, starts anywhere else too, overlaps included;
    all occurrences go, judged on the input. Null and empty texts are no bytes. Repeated rows are separate documents and
    so repeat each other. Other columns pass through; those of the four names are replaced. kept may end inside a
    UTF-8 character. Texts of any length are taken whole: one that is longer than a block is a block of its own.
    """
    if length < 4 or length % 2:
        raise ValueError("length is an even number from 4 on")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    base, blk, buckets = blocked(docs, id_col, text_col)

    def keepers(key, table):
        return _ask(key[0].as_py(), buckets, np.unique(Lot(table, length, id_col, text_col).keep))

    def live(lot: Lot, shared: np.ndarray) -> np.ndarray:
        """Keepers that occur twice here or elsewhere too."""
        order, new = _runs_of(lot.keep)
        twice = np.zeros(len(order), bool)
        twice[order] = ~(new & np.append(new[1:], True))
        return np.flatnonzero(twice | np.isin(lot.keep, shared))

    def stretches(key, table, told):
        """Each distinct stretch of a live keeper, and whether the block has it twice; with the keeper names asked for."""
        if not len(table):
            return _ask(0, buckets, np.zeros(0, np.uint64))
        lot = Lot(table, length, id_col, text_col)
        at = live(lot, _read(told)[0])
        s1, s2 = lot.names(lot.left[at], lot.right[at] + length)
        order, new = _runs_of(lot.keep[at], s1, s2)
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, len(order))) > 1
        first = order[heads]
        return _ask(key[0].as_py(), buckets, lot.keep[at][first], s1[first], s2[first], many.astype(np.uint8))

    def settle(lot: Lot, told: pa.Table):
        """(runs that repeat as a whole, runs to expand), as indices of keepers."""
        keep, s1, s2, flag = _read(told)
        at = np.flatnonzero(np.isin(lot.keep, keep))
        own1, own2 = lot.names(lot.left[at], lot.right[at] + length)
        mark = np.zeros(len(at), np.uint8)
        for bit in (REPEATS, EXPAND):
            some = flag & bit > 0
            hit = C.lookup(lot.keep[at], own1, keep[some], s1[some]) & C.lookup(own1, own2, s1[some], s2[some])
            mark[hit] |= bit
        wide = np.flatnonzero(mark & EXPAND)
        order, new = _runs_of(lot.keep[at][wide], own1[wide], own2[wide])
        return at[mark & REPEATS > 0], np.sort(at[wide[order[new]]])

    def windows(lot: Lot, runs: np.ndarray) -> np.ndarray:
        sizes = lot.right[runs] - lot.left[runs] + 1
        return np.repeat(lot.left[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def ranks(key, table, told):
        if not len(table):
            return _ask(0, buckets, np.zeros(0, np.uint64))
        lot = Lot(table, length, id_col, text_col)
        h1, h2 = lot.full_ranks(windows(lot, settle(lot, told)[1]))
        order, new = _runs_of(h1, h2)
        return _ask(key[0].as_py(), buckets, h1[order[new]], h2[order[new]])

    schema = docs.withColumns({n: F.lit(0).cast("long") for n in ("n_bytes", "n_removed", "n_spans")} | {"kept": F.lit(None).cast("binary")}).schema

    def close(key, table, told):
        if not len(table):
            return pa.table({})
        lot = Lot(table, length, id_col, text_col)
        sure, open_runs = settle(lot, told.filter(pc.equal(told["step"], 2)))
        starts = windows(lot, open_runs)
        h1, h2 = lot.full_ranks(starts)
        order, new = _runs_of(h1, h2)
        twice = np.zeros(len(order), bool)
        twice[order] = ~(new & np.append(new[1:], True))
        k1, k2, _, _ = _read(told.filter(pc.equal(told["step"], 3)))
        twice |= C.lookup(h1, h2, k1, k2)
        edge = np.zeros(len(lot.data) + 1, np.int64)
        np.add.at(edge, lot.left[sure], 1)
        np.add.at(edge, lot.right[sure] + length, -1)
        np.add.at(edge, starts[twice], 1)
        np.add.at(edge, starts[twice] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.zeros(len(gone), bool)
        before[1:] = gone[:-1]
        before[lot.offsets[:-1][lot.offsets[:-1] < len(gone)]] = False
        sums, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, gone & ~before))
        a, b = lot.offsets[:-1], lot.offsets[1:]
        kept = [lot.data[x:y][~gone[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
        out = lot.table.drop_columns([blk])
        for n, x in (("n_bytes", b - a), ("n_removed", sums[b] - sums[a]), ("n_spans", spans[b] - spans[a])):
            out = out.append_column(n, pa.array(x, pa.int64()))
        return out.append_column("kept", pa.array(kept, pa.binary()))

    shared = base.groupBy(blk).applyInArrow(keepers, ASKED).groupBy("bucket").applyInArrow(answer_shared, ANSWER)
    told = base.groupBy(blk).cogroup(shared.groupBy("_blk")).applyInArrow(stretches, ASKED).groupBy("bucket").applyInArrow(answer_stretches, ANSWER)
    equal = base.groupBy(blk).cogroup(told.groupBy("_blk")).applyInArrow(ranks, ASKED).groupBy("bucket").applyInArrow(answer_shared, ANSWER)
    both = told.select("_blk", F.lit(2).alias("step"), *_COLUMNS).unionByName(equal.select("_blk", F.lit(3).alias("step"), *_COLUMNS))
    return base.groupBy(blk).cogroup(both.groupBy("_blk")).applyInArrow(close, schema)
