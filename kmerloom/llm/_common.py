"""Helpers that the corpus operators share: tables, the shared folder, and numpy hashing of units of text.

Texts reach Python as Arrow columns. A column is read as one byte array with offsets, so that splitting and hashing are
a few numpy passes over many documents at once instead of a loop over words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kmerloom.plans.lineage import discard, scratch, without_shuffle_files, written  # noqa: F401

#: Bytes of text that one numpy pass takes; a longer document is one pass of its own. A worker keeps some 60 bytes for each.
CHUNK_BYTES = 1 << 18
#: Order of null ids: before all others.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark wherever the folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); unset, a local session gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder; what is written there goes when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def free_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and no executor holds the only copy."""
    return written(df, new_path(df.sparkSession, what), keep)


def majority(hashes: np.ndarray) -> np.uint64:
    """A number with the bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


# ---- Arrow text as bytes ------------------------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, "" if not pa.types.is_binary(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ids_of(column) -> np.ndarray:
    """Integer ids; null sorts first."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.int64())
    if array.null_count:
        array = pc.fill_null(array, NULL_ID)
    return np.asarray(array, dtype=np.int64)


def chunks(offsets: np.ndarray, limit: int | None = None):
    """(first, end) document ranges of at most limit bytes (CHUNK_BYTES), or one document."""
    n, a, limit = len(offsets) - 1, 0, limit or CHUNK_BYTES
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def small_batches(batches, rows: int = 1000):
    """The batches in slices of at most so many rows, so that what a task makes of them stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


#: Cached functions whose results a Python worker need not keep for tasks that do not call them.
CACHES: list = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Empty CACHES and return free memory to the system, which allocators keep for a worker's life otherwise."""
    for own in CACHES:
        own.cache_clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run):
    """run, a function for mapInArrow, in a worker that gives back what earlier tasks left, and what this one leaves."""

    @wraps(run)
    def own(batches):
        give_back()
        yield from run(batches)
        give_back()

    return own


def packed(arrays, kind) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], kind)


def unpacked(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers by byte place, compressed."""
    raw = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    own = pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True)
    return np.frombuffer(own, np.uint8).reshape(8, n).T.copy().view(np.int64).ravel()


def deltas(values: np.ndarray) -> bytes:
    """squeezed() for numbers that mostly grow."""
    return squeezed(np.diff(values, prepend=0))


def from_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(raw))


# ---- Hashing ------------------------------------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Lane:
    """One of two independent polynomial hashes modulo 2**64: byte codes and powers of an odd base."""

    def __init__(self, seed: int):
        own = np.random.Generator(np.random.PCG64(seed))
        self.code = own.integers(0, 1 << 64, 256, dtype=_U) | _U(1)
        self.base = int(own.integers(0, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


LANES = (_Lane(20), _Lane(77))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hash of values[start:end] for each range; equal contents give equal hashes wherever they stand."""
    up, down = LANES[lane].powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    return range_hash(LANES[lane].code[data], starts, ends, lane)


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray):
    """Maximal runs of bytes not in the 256-entry mask outside, never across documents: starts, ends, first run of each document."""
    n = len(data)
    inside = ~outside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """Lines between newlines; every document has at least one, which may be empty."""
    breaks = np.flatnonzero(data == 10)
    docs = len(offsets) - 1
    owner = np.searchsorted(offsets, breaks, "right") - 1
    counts = np.bincount(owner, minlength=docs) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    starts[heads], starts[~heads] = offsets[:-1], breaks + 1
    tails = np.zeros(first[-1], bool)
    tails[first[1:] - 1] = True
    ends[tails], ends[~tails] = offsets[1:], breaks
    return starts, ends, first


def mask_of(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: What separates words: the bytes 0x09 to 0x0D and 0x20.
SPACE = mask_of(9, 10, 11, 12, 13, 32)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in [start, start + length) for any start."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def lookup(h1: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Which pairs (h1, h2) are among the pairs (k1, k2)."""
    found = np.zeros(len(h1), bool)
    if not len(k1) or not len(h1):
        return found
    order = np.argsort(k1)
    k1, k2 = k1[order], k2[order]
    at = np.searchsorted(k1, h1)
    live = np.flatnonzero(k1[np.minimum(at, len(k1) - 1)] == h1)
    at = at[live]
    while len(live):
        found[live] |= k2[at] == h2[live]
        at = at + 1
        more = at < len(k1)
        live, at = live[more], at[more]
        more = (k1[at] == h1[live]) & ~found[live]
        live, at = live[more], at[more]
    return found


def later_local(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which entries have an equal pair at a smaller index."""
    out = np.zeros(len(h1), bool)
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    many = np.zeros(len(h1), bool)
    many[1:] |= same
    many[:-1] |= same
    some = np.sort(order[many])
    some = some[np.lexsort((h2[some], h1[some]))]
    a, b = some[:-1], some[1:]
    out[b[(h1[a] == h1[b]) & (h2[a] == h2[b])]] = True
    return out
