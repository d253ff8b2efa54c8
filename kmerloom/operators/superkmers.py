"""Counting k-mers in bins of minimizers.

The minimizer of a k-mer is the least of its m-mers in an order that looks random. Neighbouring k-mers mostly share
theirs, so a sequence is cut where the minimizer changes, and a stretch of n k-mers (a super-k-mer) is shuffled as n + k -
1 bases of two bits, packed with others for the same bin, where the k-mers themselves would take eight bytes each. All
occurrences of a k-mer have the same minimizer, hence meet in one bin, which counts them in one sort.

Minimizers are weighed first, in a table of 4**m numbers at most, and shared out to bins up to a budget of k-mers. One
that is heavier than the budget by itself is split: its equal stretches become one with a weight before they are
shuffled, the others are dealt by content over as many parts as it needs, and Spark adds up the counts of these parts.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.occurrences import chunks, rolled
from kmerloom.plans.lineage import cut

#: Bases of a minimizer at most, and least k for which stretches pay: below, there are few different k-mers.
M, LEAST_K = 10, 12
#: K-mers of a bin, and bytes of packed stretches that a task holds before it passes them on.
BIN_KMERS, HELD_BYTES = 1 << 20, 1 << 22
#: Bits of a filter of k-mers: one megabyte to 16.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27
#: Bytes of pieces, and of packed stretches, that are hashed at once: a hash takes eight bytes a base.
BATCH, UNPACKED = 1 << 18, 1 << 16
#: Bases of a piece; a stretch is never longer.
PIECE = 1 << 15


def minimizer_size(k: int) -> int:
    return min(M, (k + 1) // 2)


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, by doubling."""
    done, size = values, 1
    while 2 * size <= width:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    return np.minimum(done[: len(values) - width + 1], done[width - size :][: len(values) - width + 1])


def _mixed(x: np.ndarray) -> np.ndarray:
    """An order of m-mers that looks random and is without ties; the low bits are the m-mer itself."""
    y = x.astype(np.uint64)
    for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        y = (y + np.uint64(1)) * np.uint64(factor)
        y ^= y >> np.uint64(shift)
    low = np.uint64((1 << 2 * M) - 1)
    return (y & ~low) | x.astype(np.uint64)


def code_table(encoding: str) -> np.ndarray:
    """The code of each byte; 4 for what is no base. N counts as code 0."""
    table = np.full(256, 4, np.uint8)
    for i, base in enumerate(K.check_encoding(encoding)):
        table[[ord(base), ord(base.lower())]] = i
    table[[ord("N"), ord("n")]] = 0
    return table


class Asked:
    """A Bloom filter of k-mers: what it lets through is all that were put in, and few others while it is not too full.

    Its bits are at most MOST_BITS, whatever is asked; filled up, it lets more through, and nothing else changes.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(kmers: np.ndarray, bits: int) -> np.ndarray:
        """Two bits of each k-mer."""
        h = kmers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return np.stack([h >> np.uint64(34), (h ^ h >> np.uint64(29)) & np.uint64(0x3FFFFFFF)]) % np.uint64(bits)

    def holds(self, kmers: np.ndarray) -> np.ndarray:
        at = self.places(kmers, 64 * len(self.words))
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def asked_kmers(kmers: DataFrame) -> Asked:
    """The filter of a table of k-mers (column kmer). Tasks fill bits, and Spark joins them word by word; the driver gets
    16 bits for each row, between LEAST_BITS and MOST_BITS."""
    n = kmers.count()
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = Asked.places(np.asarray(batch.column(0), np.int64), bits).ravel()
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(words[there].view(np.int64))], ["place", "word"])

    rows = kmers.select("kmer").where("kmer IS NOT NULL").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(rows["place"])] = np.asarray(rows["word"]).view(np.uint64)
    return Asked(words)


def stretches(texts: list[bytes], k: int, table: np.ndarray, asked: Asked | None = None, reverse: bool = False):
    """(codes, first, n, minimizer, text): the stretches of k-mers with one minimizer in some texts.

    codes: of all texts on end; first: the place of a stretch's first base there; n: its k-mers; text: which text it is in.
    K-mers with other characters than bases are in none, nor are those that are not asked (if reverse, in reverse order).
    """
    return _stretches(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64), k, table, asked, reverse)


def _stretches(data: np.ndarray, sizes: np.ndarray, k: int, table: np.ndarray, asked: Asked | None, reverse: bool):
    """stretches() of texts on end and their sizes."""
    codes = table[data]
    m = minimizer_size(k)
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return codes, none, none, none, none
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    ends = np.cumsum(sizes)
    live = (np.repeat(ends, sizes) - np.arange(len(codes)) >= k)[: len(codes) - k + 1] & (bad[k:] == bad[: len(codes) - k + 1])
    if asked is not None:
        live &= asked.holds(rolled(codes & 3, k, reverse))
    least = _least_in_window(_mixed(rolled(codes & 3, m)), k - m + 1) & np.uint64((1 << 2 * M) - 1)
    at = np.flatnonzero(live)
    own = least[at].astype(np.int64)
    head = np.ones(len(at), bool)
    head[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    place = np.flatnonzero(head)
    first = at[place]
    return codes & 3, first, np.diff(np.append(place, len(at))), own[place], np.searchsorted(ends, first, "right")


def _pieces(sequences: DataFrame, k: int, weight: str | None) -> DataFrame:
    """(piece, weight): overlapping pieces of the sequences, cut where they are read; nothing is shuffled yet."""
    own = sequences.select("seq", (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("weight"))
    return chunks(own, k, "seq", PIECE - k + 1).select(F.col("piece").cast("binary").alias("piece"), "weight")


def _slices(starts: np.ndarray, size: int):
    """(a, b) of rows in a row whose starts (in bytes, ascending) lie in the same `size` bytes."""
    marks = [*np.flatnonzero(np.diff(starts // size, prepend=-1)).tolist(), len(starts)]
    yield from zip(marks[:-1], marks[1:], strict=True)


def _batches(batches):
    """(bytes, sizes, weights) of pieces, short ones together, about BATCH bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).cast(pa.large_binary())
        edges = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        data, weights = np.frombuffer(own.buffers()[2], np.uint8), np.asarray(batch.column(1), np.int64)
        for a, b in _slices(edges[:-1] - edges[0], BATCH):
            yield data[edges[a] : edges[b]], np.diff(edges[a : b + 1]), weights[a:b]


def few_counts(sequences: DataFrame, k: int, encoding: str = K.DEFAULT_ENCODING, reverse: bool = False, weight: str | None = None) -> DataFrame:
    """(kmer, frequency) for k below LEAST_K: a task adds up in a table of 4**k numbers and passes on what is not 0."""
    K.check_k(k)
    table = code_table(encoding)

    def run(batches):
        total = np.zeros(4**k, np.int64)
        for data, sizes, weights in _batches(batches):
            codes = table[data]
            if len(codes) < k:
                continue
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            live = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) >= k)[: len(codes) - k + 1] & (bad[k:] == bad[: len(codes) - k + 1])
            np.add.at(total, rolled(codes & 3, k, reverse)[live], np.repeat(weights, sizes)[: len(live)][live])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["kmer", "frequency"])

    return _pieces(sequences, k, weight).mapInArrow(run, "kmer long, frequency long").groupBy("kmer").agg(F.sum("frequency").alias("frequency"))


def minimizer_loads(pieces: DataFrame, k: int, encoding: str, asked: Asked | None = None, reverse: bool = False) -> DataFrame:
    """(minimizer, n): how many k-mers have each. A task passes on one number for each minimizer at most."""
    table, m = code_table(encoding), minimizer_size(k)

    def run(batches):
        total = np.zeros(4**m, np.int64)
        for data, sizes, _ in _batches(batches):
            _, _, n, minimizer, _ = _stretches(data, sizes, k, table, asked, reverse)
            np.add.at(total, minimizer, n)  # a bincount would pass over all minimizers
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["minimizer", "n"])

    return pieces.select("piece", "weight").mapInArrow(run, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))


def share_out(loads: DataFrame, k: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, parts) of every minimizer: bins fill up to the budget one after the other; a heavier minimizer has a bin for each
    of its parts. The table that the driver makes has 4**m entries, whatever the input."""
    rows = loads.toArrow()
    load = np.zeros(4 ** minimizer_size(k), np.int64)
    load[np.asarray(rows["minimizer"])] = np.asarray(rows["n"])
    parts = -(-load // budget)
    heavy = parts > 1
    light = np.where(heavy, 0, load)
    shared = np.where(light > 0, (np.cumsum(light) - light) // budget, 0)
    after = (int(light.sum()) // budget) + 1
    return np.where(heavy, after + np.cumsum(np.where(heavy, parts, 0)) - parts, shared).astype(np.int32), np.maximum(parts, 1).astype(np.int32)


def _packed_runs(codes: np.ndarray, first: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes): four bases a byte, each stretch in bytes of its own."""
    bases = n + k - 1
    sizes = (bases + 3) // 4
    ends = np.cumsum(sizes * 4)
    at = np.repeat(first - (ends - sizes * 4), sizes * 4) + np.arange(ends[-1] if len(ends) else 0)
    own = codes[np.minimum(at, len(codes) - 1)].reshape(-1, 4)  # what lies beyond a stretch is not looked at again
    return own[:, 0] << 6 | own[:, 1] << 4 | own[:, 2] << 2 | own[:, 3], sizes


def _without_rest(data: np.ndarray, sizes: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The packed bytes with zeros for what lies beyond each stretch, so that equal stretches have equal bytes."""
    last = np.cumsum(sizes) - 1
    spare = (4 * sizes - (n + k - 1)).astype(np.uint8)
    out = data.copy()
    out[last] = data[last] >> (2 * spare) << (2 * spare)
    return out


def binned_stretches(pieces: DataFrame, k: int, encoding: str, bins: np.ndarray, parts: np.ndarray, asked: Asked | None = None, reverse: bool = False) -> DataFrame:
    """(bin, split, n, weights, bases): stretches packed by bin; split marks parts of a heavy minimizer."""
    table, held = code_table(encoding), HELD_BYTES

    def rows(own):
        """own: lists of arrays (bin, split, n, weight, bytes of each, bytes)."""
        bin_, split, n, weight, sizes, data = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(bin_, kind="stable")
        ends = np.cumsum(sizes)
        at = np.repeat((ends - sizes)[order], sizes[order])
        new = np.cumsum(sizes[order])
        moved = data[at + np.arange(len(data)) - np.repeat(new - sizes[order], sizes[order])]
        bin_, split, n, weight = (x[order] for x in (bin_, split, n, weight))
        marks = [*np.flatnonzero(np.diff(bin_, prepend=-1)).tolist(), len(bin_)]
        edge = np.concatenate([[0], new])
        whole = [slice(a, b) for a, b in zip(marks[:-1], marks[1:], strict=True)]
        packed = [[x[c].tobytes() for c in whole] for x in (n.astype(np.uint16), weight)]
        ones = [b"" if (weight[c] == 1).all() else w for c, w in zip(whole, packed[1], strict=True)]
        bases = [moved[edge[a] : edge[b]].tobytes() for a, b in zip(marks[:-1], marks[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bin_[marks[:-1]]), pa.array(split[marks[:-1]]), pa.array(packed[0], pa.binary()), pa.array(ones, pa.binary()), pa.array(bases, pa.binary())], ["bin", "split", "n", "weights", "bases"]
        )

    def heavy_runs(runs: Counter):
        """The stretches of heavy minimizers, each once with its weight, dealt over the parts by content."""
        listed = list(runs.items())
        texts = [raw for (_, _, raw), _ in listed]
        low, many, n, weight = (np.array([f(x) for x in listed], np.int64) for f in (lambda x: bins[x[0][0]], lambda x: parts[x[0][0]], lambda x: x[0][1], lambda x: x[1]))
        part = np.array([crc32(t) for t in texts], np.int64) % many
        return low + part, np.ones(len(listed), bool), n, weight, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)

    def run(batches):
        own, size, runs = [], 0, Counter()
        for texts, lengths, weights in _batches(batches):
            codes, first, n, minimizer, text = _stretches(texts, lengths, k, table, asked, reverse)
            if not len(first):
                continue
            weight, heavy = weights[text], parts[minimizer] > 1
            data, sizes = _packed_runs(codes, first, n, k)
            if heavy.any():
                data = _without_rest(data, sizes, n, k)
                ends, each = np.cumsum(sizes), np.flatnonzero(heavy)
                raw = data.tobytes()
                for i, (a, b) in zip(each.tolist(), zip((ends - sizes)[each].tolist(), ends[each].tolist(), strict=True), strict=True):
                    runs[int(minimizer[i]), int(n[i]), raw[a:b]] += int(weight[i])
                stay = np.repeat(~heavy, sizes)
                data, n, minimizer, weight, sizes = data[stay], n[~heavy], minimizer[~heavy], weight[~heavy], sizes[~heavy]
            own.append((bins[minimizer].astype(np.int64), np.zeros(len(n), bool), n, weight, sizes, data))
            size += len(data) + 24 * len(n)
            if size + 100 * len(runs) >= held:
                yield from rows([*own, heavy_runs(runs)] if runs else own)
                own, size, runs = [], 0, Counter()
        if own or runs:
            yield from rows([*own, heavy_runs(runs)] if runs else own)

    return pieces.select("piece", "weight").mapInArrow(run, "bin long, split boolean, n binary, weights binary, bases binary")


def counts_of(table: pa.Table, k: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """(kmers, counts) of the stretches of one bin, in one sort. They are unpacked a few at a time, as single k-mers take 32 bases
    each."""
    n = np.concatenate([np.frombuffer(x, np.uint16) for x in table["n"].to_pylist()]).astype(np.int64)
    weights = np.concatenate([np.frombuffer(w, np.int64) if w else np.ones(len(x) // 2, np.int64) for w, x in zip(table["weights"].to_pylist(), table["n"].to_pylist(), strict=True)])
    data = np.frombuffer(b"".join(table["bases"].to_pylist()), np.uint8)
    edge, done = np.concatenate([[0], np.cumsum((n + k + 2) // 4)]), np.concatenate([[0], np.cumsum(n)])
    kmers = np.empty(done[-1], np.int64)
    for a, b in _slices(edge[:-1], UNPACKED):
        own = data[edge[a] : edge[b]]
        codes = np.stack([own >> 6, own >> 4 & 3, own >> 2 & 3, own & 3], axis=1).ravel()
        at = np.repeat(4 * (edge[a:b] - edge[a]) - (done[a:b] - done[a]), n[a:b]) + np.arange(done[b] - done[a])
        kmers[done[a] : done[b]] = rolled(codes, k, reverse)[at]
    if (weights == 1).all():
        return np.unique(kmers, return_counts=True)
    order = np.argsort(kmers, kind="stable")
    kmers, weight = kmers[order], np.repeat(weights, n)[order]
    first = np.flatnonzero(np.diff(kmers, prepend=-1))
    return kmers[first], np.add.reduceat(weight, first)


def superkmer_counts(sequences: DataFrame, k: int, encoding: str = K.DEFAULT_ENCODING, reverse: bool = False, weight: str | None = None, budget: int = BIN_KMERS, asked: Asked | None = None) -> DataFrame:
    """(kmer, frequency): how often each k bases in a row stand in the sequences (column seq), as counting them one by one
    gives. weight: a column that says how often a sequence counts. K-mers with other characters than bases, null and short
    sequences count nothing. asked: only k-mers that this filter lets through are shuffled and counted. k is LEAST_K or
    more."""
    if K.check_k(k) < LEAST_K:
        raise ValueError(f"k is {LEAST_K} or more here")
    pieces = _pieces(sequences, k, weight)
    bins, parts = share_out(minimizer_loads(pieces, k, encoding, asked, reverse), k, budget)

    def count(table: pa.Table) -> pa.Table:
        kmers, n = counts_of(table, k, reverse)
        return pa.table({"kmer": kmers, "frequency": n, "split": pa.array(np.full(len(kmers), table["split"][0].as_py()))})

    packed = binned_stretches(pieces, k, encoding, bins, parts, asked, reverse)
    packed = packed.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bin")  # few bytes, much work: not drawn together
    counted = packed.groupBy("bin").applyInArrow(count, "kmer long, frequency long, split boolean")
    if (parts == 1).all():
        return counted.select("kmer", "frequency")
    counted = cut(counted, "counted")  # read twice: counts of split bins are parts
    whole = counted.where("NOT split").select("kmer", "frequency")
    return whole.unionByName(counted.where("split").groupBy("kmer").agg(F.sum("frequency").alias("frequency")))
