"""SimHash near-dedup with a generalised pigeonhole filter.

64-bit fingerprints of word shingles link at a small Hamming distance t. Bits that agree often are grouped into m
partitions; partition i gets its own threshold t_i >= -1 with sum(t_i) = t - m + 1, so that any pair within t agrees on
some partition within its threshold. A dynamic program over candidate counts, taken from all fingerprints, chooses the
thresholds (and m). Fingerprints meet on the partition's value, either side up to one bit off, and the full distance
verifies them. A meeting that costs more than splitting it is split once more: all bits that are left are then one
partition, whose threshold is the whole distance, so its rows meet with every neighbour one bit off. That last step is no
pigeonhole any more; splitting by several partitions again would triple the rows of a dense cluster in each round.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kmerloom.llm import _common as C
from kmerloom.llm.components import connected_components
from kmerloom.llm.near_duplicates import similar_components

BITS = 64
#: Words in a shingle, seed of its XXH64, greatest Hamming distance of a link.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Partition counts the plan may choose from in the first rounds, and the number of these; later all bits left are one.
PARTITIONS, ROUNDS = (2, 3, 4), 1
#: A meeting is split once each of its rows stands before more than so many pairs for each row that splitting makes of it.
WORTH = 1.0
_ALL = (1 << BITS) - 1

_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned: bit i is set if more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        h = np.array([_hash(b" ".join(words))], np.uint64)
    else:
        h = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, len(words) - shingle + 1)
    return int(C.majority(h))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; no words (null, empty, white space) give 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits i and j (a 64 x 64 table, summed by Spark)."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            h = np.asarray(batch.column(0), np.int64).view(np.uint64)
            for a in range(0, len(h), 1 << 14):
                x = np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(x)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*i, BITS], pa.int32()), pa.array([*j, BITS], pa.int32()), pa.array([*total[i, j].astype(np.int64), n], pa.int64())], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, c in rows:
        if i == BITS:
            n = c
        else:
            both[i, j] = both[j, i] = c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int, bits=range(BITS)) -> list[list[int]]:
    """The bits in m groups of nearly equal size; each group grows by the bit most correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, groups = set(bits), []
    for g in range(m):
        size = len(left) // (m - g)
        seed = max(sorted(left), key=lambda b: phi[b, sorted(left)].sum())
        own = [seed]
        left.remove(seed)
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: phi[b, own].sum()))
            left.remove(own[-1])
        groups.append(sorted(own))
    return groups


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _left(done: int) -> list[int]:
    """The bits that are not in the mask."""
    return [b for b in range(BITS) if not done >> b & 1]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition with the given sum, of least total cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in own.items():
                if s + t not in step or cost + c < step[s + t][0]:
                    step[s + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def plan(rows: DataFrame, dones: list[int], stats: tuple[int, np.ndarray], distance: int, partitions=PARTITIONS) -> dict[int, list[tuple[int, int]]]:
    """(mask of a partition, threshold) of the partitions to probe, for each mask of bits on which rows have met before.

    rows: (done, w, fp), done and w as in links(). Candidates are counted over all rows, in one pass for every layout.
    """
    n, both = stats
    p = np.diag(both) / max(n, 1)
    flip = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) * (1 - p), 1e-9)  # odds that a pair differs in a bit
    layouts = {d: [group_bits(n, both, m, _left(d)) for m in partitions if m <= len(_left(d))] for d in dones}
    flat = [(d, k, i, bits) for d, own in layouts.items() for k, groups in enumerate(own) for i, bits in enumerate(groups)]
    value = lambda d, bits: F.col("w").bitwiseAND(F.lit(_signed(d | _mask(bits) & _ALL)))
    keys = {d: F.array(*(F.struct(F.lit(x).alias("at"), value(d, bits).alias("v")) for x, (e, _, _, bits) in enumerate(flat) if e == d)) for d in dones}
    chosen = reduce(lambda w, d: w.when(F.col("done") == _signed(d), keys[d]), dones, F)
    met = rows.select(F.explode(chosen).alias("k")).groupBy("k").count()
    counts = {r["at"]: r for r in met.groupBy("k.at").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    out = {}
    for d, own in layouts.items():
        best = None
        for k, groups in enumerate(own):
            costs = []
            for i, bits in enumerate(groups):
                seen = counts.get(flat.index((d, k, i, bits)))
                size, equal = (seen["n"], seen["pairs"] if len(groups) > 1 else 0) if seen else (0, 0)  # one partition leaves no bit open
                cost, e = {-1: 0.0}, np.zeros(distance + 1)
                e[0] = 1
                for b in bits:  # elementary symmetric sums: pairs at 1, 2, ... flips for each equal pair
                    e[1:] = e[1:] + e[:-1] * flip[b]
                for t in range(distance + 1):
                    cost[t] = equal * e[: t + 1].sum() + size * (1 + len(bits) * (t > 0))
                costs.append(cost)
            total, thresholds = allocate(costs, distance - len(groups) + 1)
            if best is None or total < best[0]:
                best = (total, [(_mask(g) & _ALL, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
        out[d] = best[1]
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect exactly what pairs of distinct fingerprints within the distance (at most 2) connect.

    A row is (done, w, fp): w is fp with at most one bit flipped, and rows meet where they agree in w on the bits of the
    mask done. Two fingerprints within 2 differ in a partition by no more than its threshold for some partition, and so
    meet there when each flips one of those bits at most; the same holds again for the bits that are left. So every
    round is the same step on the rows of the meetings that are worth splitting. The thresholds of the first round come
    from the program; after it all bits left are one partition, and as then all bits are in the mask, a meeting holds no
    more than the neighbours of one value. Rows grow with the fingerprints, whatever the groups.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance is 0, 1 or 2")
    stats = bit_counts(fps)
    rows, dones, found = fps.select(F.lit(0).cast("long").alias("done"), F.col("fp").alias("w"), "fp"), [0], []
    for depth in count():
        plans = plan(rows, dones, stats, distance, PARTITIONS if depth < ROUNDS else (1,))
        spread = F
        for d, own in plans.items():
            still, turned = [], []
            for mask, t in own:
                done = F.lit(_signed(d | mask)).alias("done")
                still.append(F.struct(done, F.col("w").alias("w")))
                turned += [F.struct(done, F.col("w").bitwiseXOR(F.lit(_mask([b]))).alias("w")) for b in range(BITS) if t > 0 and mask >> b & 1]
            every = F.when(F.col("w") == F.col("fp"), F.array(*still, *turned)).otherwise(F.array(*still)) if turned else F.array(*still)
            spread = spread.when(F.col("done") == _signed(d), every)
        dones = sorted({d | mask for d, own in plans.items() for mask, _ in own} - {_ALL})
        met = C.materialize(rows.select("fp", F.explode(spread).alias("k")).select("k.done", "k.w", "fp", F.col("k.w").bitwiseAND(F.col("k.done")).alias("v")), "met")
        sizes = C.materialize(met.groupBy("done", "v").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        sized = met.join(sizes, ["done", "v"])
        most = 2 * WORTH * (1 + BITS - F.bit_count("done"))
        split = (F.col("done") != -1) & (F.col("n") > most)
        near = sized.where(~split).groupBy("done", "v").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
        pairs = near.select("done", "fps", F.explode("fps").alias("a"))
        close = F.filter("fps", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= distance))
        if distance == 2:  # the neighbours of one value are all within 2, so one of them stands for the rest
            close = F.when(F.col("done") == -1, F.when(F.col("a") > F.get("fps", F.lit(0)), F.slice("fps", 1, 1))).otherwise(close)
        found.append(pairs.select("a", F.explode(close).alias("b")))
        rows = C.materialize(sized.where(split).select("done", "w", "fp"), "split")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def simhash_components(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    fingerprint: 16 hex digits. component_id: the least id reachable over fingerprints that differ in at most distance
    bits. Equal fingerprints count once, so copies cost nothing beyond their row. Rows without words (null, empty or
    white space) share fingerprint zero and are linked like any other. Texts of any length are taken whole. Repeated
    rows share a component; null ids never become a component_id unless the component has no other. Other columns are
    not looked at, whatever their names. An empty table gives none.
    """
    own = C.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = C.materialize(own.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    placed = C.materialize(rooted(classes, distance), "placed")
    named = C.materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_print = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return own.join(by_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(classes: DataFrame, distance: int) -> DataFrame:
    """classes, one row for each fp, with root: the least fp that links lead to."""
    roots = connected_components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] | None = None) -> DataFrame:
    """docs with exactly one row kept of each component: that of the least id, null last, then of the least text hash.

    Components are those of fingerprints within the distance. With similar, a fraction such as (4, 5), they are those of
    sets of word shingles with at least this Jaccard similarity: fingerprints within the distance are then candidates
    like any other, see similar_components(). Rows are told apart by id and text, so ids may be null or repeat; of rows
    that repeat both one stays. Null, empty and white-space texts are copies of each other. Texts of any length are
    taken whole. All columns pass through, whatever their names; an empty table gives none.
    """
    with C.scratch(docs.sparkSession):
        if similar:
            rows = similar_components(docs, links, distance, similar, id_col, text_col, shingle)
        else:
            hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
            own = C.materialize(fingerprints(hashed.select(F.struct("id", "text_hash").alias("row"), "text"), "row", "text", shingle), "fingerprints")
            roots = C.materialize(rooted(own.select("fp").distinct(), distance), "placed")
            rows = own.join(roots, "fp").select("row.id", "row.text_hash", "root")
        least = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("m")).select("m.id", "m.text_hash")
        least = C.materialize(least, "kept", keep=True)
    # one column as key, so that rows are dealt once for both steps; within it a null id equals another
    hidden, row = C.free_name(docs, "row"), lambda i, t: F.struct(F.col(i).alias("id"), t.alias("text_hash"))
    stay = least.select(row("id", F.col("text_hash")).alias(hidden))
    own = docs.withColumn(hidden, row(id_col, F.xxhash64(text_col)).cast(stay.schema[hidden].dataType))
    return own.join(stay, hidden, "left_semi").dropDuplicates([hidden]).select(docs.columns)
