"""Enumerating k-mers along every path.

An occurrence is a start position in a non-empty node and a path from there on which k bases end inside the non-empty
last node, with at most so many non-reference nodes. Paths grow by one equi-join with the edge table a step; each step
carries only the last k-1 bases of the start node and the first k-1 of what follows, and the budget of variant nodes is
tested in the join, so nothing grows that cannot end in a k-mer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph

if TYPE_CHECKING:
    from kmerloom.operators.unitigs import Unitigs

#: Bases that one row of a long node spans before its k-mers are taken apart.
CHUNK = 1 << 15
#: Bases whose k-mers are hashed at once.
HASHED = 1 << 18
#: Steps after which a path must have ended; each takes it on by a base at least.
MAX_STEPS = 10_000
#: Steps of a walk between two writes to the shared folder.
ROUND = 3


def chunks(sequences: DataFrame, k: int, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """sequences with piece and piece_start instead of seq: pieces of chunk bases that overlap by k - 1.

    Every k-mer lies in exactly one piece, so megabase nodes spread over rows. Pieces are cut from bytes, where a place
    is found without walking the text.
    """
    raw = F.col(seq).cast("binary")
    starts = F.explode(F.expr(f"CASE WHEN length({seq}) >= {k} THEN sequence(0, length({seq}) - {k}, {chunk}) END"))
    cutout = sequences.withColumn("piece_start", starts)
    return cutout.withColumn("piece", F.substr(raw, F.col("piece_start") + 1, F.lit(chunk + k - 1)).cast("string")).drop(seq)


def rolled(codes: np.ndarray, k: int, reverse: bool = False) -> np.ndarray:
    """The hash of every k codes in a row, by doubling: the hash of 2n codes from those of n at two places."""
    out, done = np.zeros(len(codes) - k + 1, np.int64), 0
    step, size = codes.astype(np.int64), 1
    while True:
        if k & size:
            part = step[done : done + len(out)]
            out = out | part << 2 * done if reverse else out << 2 * size | part
            done += size
        if done == k:
            return out
        step = step[:-size] | step[size:] << 2 * size if reverse else step[:-size] << 2 * size | step[size:]
        size *= 2


def linear_kmers(sequences: DataFrame, k: int, seq: str = "seq", encoding: str = K.DEFAULT_ENCODING, reverse: bool = False, positions: bool = True) -> DataFrame:
    """One row for each k bases in a row of each sequence: the other columns, position (if asked for) and kmer (hash).

    K-mers over other characters than A, C, G, T, N have null hashes; null and short sequences give no row. Pieces are
    hashed as arrays, all k-mers of an Arrow batch at once.
    """
    K.check_k(k)
    table = np.full(256, 4, np.uint8)
    for i, base in enumerate(K.check_encoding(encoding)):
        table[[ord(base), ord(base.lower())]] = i
    table[[ord("N"), ord("n")]] = 0
    # pieces are dealt anew: one long sequence, or one large file, would else be taken apart by one task. This moves each
    # base once, where the k-mers that follow take eight bytes for each
    pieces = chunks(sequences, k, seq).repartition(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in pieces.columns if c not in ("piece", "piece_start")]
    pieces = pieces.select(*others, "piece_start", "piece")
    out = pieces.select(*others, *[F.lit(0).cast("long").alias("position")] * positions, F.lit(None).cast("long").alias("kmer"))
    names = out.columns

    def run(batches):
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(len(others) + 1).cast(pa.binary())), np.int64)
            marks = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // HASHED, prepend=-1)).tolist()  # short pieces are hashed together
            for a, b in zip(marks, [*marks[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                texts = [x.as_buffer() for x in part.column(len(others) + 1).cast(pa.binary())]
                sizes = lengths[a:b]
                codes = table[np.frombuffer(b"".join(texts), np.uint8)]
                ends = np.cumsum(sizes)
                live = np.repeat(ends, sizes) - np.arange(len(codes)) >= k  # starts whose k bases lie in one piece
                at = np.flatnonzero(live)
                bad = np.concatenate([[0], np.cumsum(codes > 3)])
                kmers = rolled(codes & 3, k, reverse)[at]
                columns = [pa.array(kmers, mask=bad[at + k] > bad[at])]
                if others or positions:
                    row = np.repeat(np.arange(len(texts)), sizes)[at]
                    starts = np.asarray(part.column(len(others)), dtype=np.int64) - (ends - sizes)
                    columns = [*part.select(range(len(others))).take(pa.array(row)).columns, *[pa.array(at + starts[row])] * positions, *columns]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pieces.mapInArrow(run, out.schema)


def over_empty_runs(steps: DataFrame, max_variant_nodes: int) -> DataFrame:
    """steps that lead over runs of empty nodes to the next node with bases: src, dst, run, ords, v, more, prefix.

    run: the nodes of the step, dst last; ords: the out-list places of its edges; v: its variant nodes, within the limit.
    Runs are joined by doubling: with all ways of at most n edges to a node with bases, and all ways of n edges among empty
    nodes, there are those of 2n. So rounds grow with the logarithm of the longest run. A way of more edges than there
    are empty nodes, none of them a variant, has a cycle: RuntimeError.
    """
    fits = F.col("v") <= max_variant_nodes
    one = steps.where(fits).select("src", "dst", F.array("dst").alias("run"), F.array("out_ord").alias("ords"), "v", (F.col("more") == 0).alias("soft"))
    soft = one.where("soft").drop("soft")
    ways = one.where("NOT soft").drop("soft")
    ahead = steps.select("dst", "more", "prefix").where("more > 0").dropDuplicates(["dst"])
    if soft.isEmpty():
        return ways.join(ahead.hint("merge"), "dst")
    empty, edges = steps.where("more = 0").select("dst").distinct().count(), 1
    soft = cut(soft, "runs")

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        """The ways of a that those of b go on from where they end."""
        on = b.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("run").alias("_run"), F.col("ords").alias("_ords"), F.col("v").alias("_v"))
        both = a.join(on.hint("merge"), "dst").where(f"v + _v <= {max_variant_nodes}")
        return both.select("src", F.col("_to").alias("dst"), F.concat("run", "_run").alias("run"), F.concat("ords", "_ords").alias("ords"), (F.col("v") + F.col("_v")).alias("v"))

    while not soft.isEmpty():
        if edges > empty and not soft.where("v = 0").isEmpty():  # with variant nodes in it, the limit ends a way
            raise RuntimeError("there is a cycle of empty nodes")
        ways = cut(ways.unionByName(then(soft, ways)), "runs")
        soft, edges = cut(then(soft, soft), "runs"), 2 * edges
    return ways.join(ahead.hint("merge"), "dst")


def _steps(graph: SequenceGraph, k: int) -> DataFrame:
    """Edges with what a path needs of the node they lead to."""
    ahead = graph.nodes.select(F.col("node_id").alias("dst"), F.least(F.col("length"), F.lit(k - 1)).alias("more"), F.substring("seq", 1, k - 1).alias("prefix"), (~F.col("is_ref")).cast("int").alias("v"))
    return graph.edges.select("src", "dst", "out_ord").join(ahead, "dst")


@dataclass(frozen=True)
class Walk:
    """All paths that can end in a k-mer, written: nodes to start from, and a table for each round of steps.

    inner: (start_node, seq) with the k-mers that need no step, each from one of the first bases of start_node on. A row of
    grown is a path: text holds the last bases of its first node (suffix of them) and ext bases of what follows;
    the k-mers that end in its last node are those that end after low + 1 to ext of these.
    """

    graph: SequenceGraph
    k: int
    inner: DataFrame
    grown: list[DataFrame]
    carried: tuple[str, ...] = ()
    units: Unitigs | None = None

    @property
    def ending(self) -> list[DataFrame]:
        return [g.where("ext > low") for g in self.grown]


def walk(
    graph: SequenceGraph, k: int, max_variant_nodes: int = 255, starts: DataFrame | None = None, max_steps: int = MAX_STEPS, paths: bool = True, units: Unitigs | None = None
) -> Walk:
    """The paths from the nodes in starts (node_id; all by default), within the limit on variant nodes.

    paths: carry path, offsets and ords, see occurrences(); without them only hops, the edges of the path. units: the
    unitigs of the graph for this k; paths then start in nodes and go on over unitigs, of which path and offsets tell, the
    first being that of the start node. Every step leads to a node with bases, so there are k - 1 at most, whatever runs
    of empty nodes lie between; RuntimeError if empty reference nodes form a cycle.
    """
    K.check_k(k)
    K.check_budget(max_variant_nodes)
    nodes = graph.nodes.where(f"length > 0 AND int(NOT is_ref) <= {max_variant_nodes}")
    if starts is not None:
        nodes = nodes.join(starts.select("node_id").distinct(), "node_id", "left_semi")
    if units:
        nodes = units.fronts(nodes)
    else:
        nodes = nodes.select("*", F.col("node_id").alias("unitig"), F.lit("").alias("ahead"), F.lit(0).alias("rest"))
    inner = nodes.select(F.col("node_id").alias("start_node"), F.concat("seq", "ahead").alias("seq") if units else "seq")
    first = {"path": F.array("last"), "offsets": F.expr("array(0)"), "ords": F.expr("cast(array() as array<int>)")} if paths else {"hops": F.lit(0)}
    if k == 1:
        return Walk(graph, k, inner, [], tuple(first), units)
    front = nodes.where(f"rest < {k - 1}").select(
        F.col("node_id").alias("start_node"),
        F.col("length").alias("len0"),
        F.expr(f"concat(right(seq, {k - 1}), ahead)").alias("text"),
        F.expr(f"least(length, {k - 1})").alias("suffix"),
        F.col("unitig").alias("last"),
        F.expr("int(NOT is_ref)").alias("n_var"),
        F.col("rest").alias("ext"),
    ).select("*", *(c.alias(n) for n, c in first.items()))
    front = front.repartition(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), "start_node")  # paths grow where they are dealt, also over a small edge table
    longer = {"path": F.expr("concat(path, run)"), "offsets": F.expr("concat(offsets, array_repeat(len0 + ext, size(run)))"), "ords": F.expr("concat(ords, step_ords)"), "hops": F.expr("hops + size(run)")}
    grow = [
        F.col("start_node"),
        F.col("len0"),
        F.expr(f"concat(text, left(prefix, least(ext + more, {k - 1}) - ext))").alias("text"),
        F.col("suffix"),
        F.col("dst").alias("last"),
        (F.col("n_var") + F.col("v")).alias("n_var"),
        F.expr(f"least(ext + more, {k - 1})").alias("ext"),
        *(longer[n].alias(n) for n in first),
        F.expr(f"greatest(ext, {k - 1} - suffix)").alias("low"),
    ]
    fits = F.expr(f"last = src AND n_var + v <= {max_variant_nodes}")
    steps, tables = cut(over_empty_runs(units.steps if units else cut(_steps(graph, k), "edges"), max_variant_nodes).withColumnRenamed("ords", "step_ords"), "steps"), []
    steps = steps.hint("merge") if units else steps  # a table of the whole graph, in each of many steps
    for _ in range(0, max_steps, ROUND):
        rounds = []  # several steps between two writes; Spark shares their exchanges
        for i in range(ROUND):
            rounds.append(front.join(steps, fits).select(*grow, F.lit(i).alias("step")))
            front = rounds[-1].where(f"ext < {k - 1}").drop("low", "step")
        grown = cut(reduce(DataFrame.unionByName, rounds), "paths")
        tables.append(grown)
        front = grown.where(f"step = {ROUND - 1} AND ext < {k - 1}").drop("low", "step")
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"paths still grow after {max_steps} steps")
    return Walk(graph, k, inner, tables, tuple(first), units)


def occurrences_of(walked: Walk, reverse: bool = False) -> DataFrame:
    """The occurrences along a walk's paths, see occurrences()."""
    graph, k = walked.graph, walked.k
    paths = "path" in walked.carried
    inner = linear_kmers(walked.inner, k, "seq", graph.encoding, reverse)
    first = {"path": F.array("start_node"), "offsets": F.expr("array(0)"), "ords": F.expr("cast(array() as array<int>)")} if paths else {}
    found = [inner.select("start_node", F.col("position").cast("int").alias("p"), *(c.alias(n) for n, c in first.items()), "kmer")]
    own = K.digits(F.expr(f"substr(text, suffix - {k} + e + 1, {k})"), graph.encoding)
    ended = [F.col("start_node"), F.expr(f"len0 - {k} + e").alias("p"), *first, K.hash_digits(F.reverse(own) if reverse else own).alias("kmer")]
    found += [g.withColumn("e", F.explode(F.expr("sequence(low + 1, ext)"))).select(ended) for g in walked.ending]
    return reduce(DataFrame.unionByName, found)


def stretches_of(walked: Walk) -> DataFrame:
    """(seq, nodes): sequences whose k-mers, each once, are those of the walk's occurrences: whole nodes, and for each path
    the bases of the k-mers that end in its last node. nodes: how many nodes such an occurrence's path has, unless the walk
    was over unitigs."""
    k = walked.k
    found = [walked.inner.select("seq", F.lit(1).alias("nodes"))]
    nodes = F.size("path") if "path" in walked.carried else F.col("hops") + 1
    found += [g.select(F.expr(f"substr(text, suffix - {k} + low + 2, ext - low + {k - 1})").alias("seq"), nodes.alias("nodes")) for g in walked.ending]
    return reduce(DataFrame.unionByName, found)


def occurrences(
    graph: SequenceGraph, k: int, max_variant_nodes: int = 255, starts: DataFrame | None = None, reverse: bool = False, max_steps: int = MAX_STEPS, paths: bool = True
) -> DataFrame:
    """(start_node, p, path, offsets, ords, kmer) of every occurrence, each once; only start_node, p and kmer without paths.

    path: its nodes; offsets: their places counted from the start of the first node (the first is 0); ords: the out-list
    places of its edges; p: where the k-mer starts in the first node; kmer: its hash, of the reversed bases if reverse.
    starts and errors: see walk().
    """
    return occurrences_of(walk(graph, k, max_variant_nodes, starts, max_steps, paths), reverse)


def spread(found: DataFrame) -> DataFrame:
    """One row for each node of each occurrence's path: base start_position of node_id is base kmer_position of the k-mer."""
    each = found.select("*", F.posexplode("path").alias("i", "node_id"))
    at = F.expr("offsets[i]")
    return each.withColumns(
        {"start_position": F.when(F.col("i") == 0, F.col("p")).otherwise(0), "kmer_position": F.when(F.col("i") == 0, 0).otherwise(at - F.col("p"))}
    ).drop("i")


def paths_over(walked: Walk, centres: DataFrame) -> DataFrame:
    """(centre, start_node, ords, off, first, seq): a row for each node among the centres on each path of a walk with paths.

    The k-mers of seq are those of the path's occurrences, the first at base `first` of the start node; the centre begins
    off bases behind the start node's first one, so off is 0 for the start node only. An inner k-mer of a long node is in
    one of several rows, as chunks() cuts the node.
    """
    k = walked.k
    inner = chunks(walked.inner, k).select("start_node", F.expr("cast(array() as array<int>)").alias("ords"), F.col("piece_start").alias("first"), F.col("piece").alias("seq"))
    inner = inner.select(F.col("start_node").alias("centre"), "start_node", "ords", F.lit(0).alias("off"), "first", "seq")
    own = F.expr(f"substr(text, suffix - {k} + low + 2, ext - low + {k - 1})")
    found = [inner]
    for g in walked.ending:
        each = g.select("start_node", "ords", "offsets", F.expr(f"len0 - {k} + low + 1").alias("first"), own.alias("seq"), F.posexplode("path").alias("i", "centre"))
        found.append(each.select("centre", "start_node", "ords", F.expr("offsets[i]").alias("off"), "first", "seq"))
    return reduce(DataFrame.unionByName, found).join(centres.select("centre").distinct(), "centre", "left_semi")


def kmers_over(paths: DataFrame, k: int, encoding: str = K.DEFAULT_ENCODING, reverse: bool = False) -> DataFrame:
    """paths_over() with a row for each k-mer in place of off, first and seq: start_position, kmer_position, p and kmer.

    A path row keeps the columns that are given with it; kmer is of the reversed bases if reverse. Base start_position of the centre is base kmer_position of the k-mer.
    """
    others = [c for c in paths.columns if c not in ("off", "first", "seq")]
    # at most 31 k-mers at a time: two numbers hold their bases, and each k-mer is a cut out of these
    most = 31
    part = K.digits(F.substr("seq", F.col("at") + 1, F.lit(most + k - 1)), encoding)
    each = paths.select(*others, "off", "first", "seq", F.explode(F.expr(f"sequence(0, length(seq) - {k}, {most})")).alias("at"))
    each = each.select(*others, "off", (F.col("first") + F.col("at")).alias("first"), (F.reverse(part) if reverse else part).alias("part"))
    # number of the first k bases, and of those behind them, n of these
    each = each.select(*others, "off", "first", K.hash_digits(F.substring("part", 1, k)).alias("head"), F.coalesce(K.hash_digits(F.expr(f"substr(part, {k + 1})")), F.lit(0)).alias("tail"), F.expr(f"length(part) - {k}").alias("n"))
    each = each.select(*others, "off", "first", "head", "tail", "n", F.explode(F.expr("sequence(0, n)")).alias("e"))
    kmer = F.expr(f"(shiftleft(head, 2 * e) | shiftright(tail, 2 * (n - e))) & {4**k - 1}L")
    each = each.select(*others, "off", F.expr("first + n - e" if reverse else "first + e").alias("p"), kmer.alias("kmer"))
    here = F.col("off") == 0
    return each.select(*others, F.when(here, F.col("p")).otherwise(0).alias("start_position"), F.when(here, 0).otherwise(F.col("off") - F.col("p")).alias("kmer_position"), "p", "kmer")


def _over_units(walked: Walk, reverse: bool) -> DataFrame:
    """(start_node, p, kmer, units): the occurrences of a walk over unitigs, with what they cover behind the start node, see
    Unitigs.node_rows()."""
    k, own = walked.k, walked.units.members.select(F.col("node_id").alias("start_node"), F.col("unitig").alias("unit0"), "off", F.col("length").alias("len0"))
    found = occurrences_of(walked, reverse).join(own.hint("merge"), "start_node")
    # behind the start node in its own unitig, then in each unitig of the path from its first base on
    here = F.struct(F.col("unit0").alias("unitig"), (F.col("off") + F.col("len0")).alias("low"), (F.col("off") + F.col("p") + k - 1).alias("high"), (-F.col("off") - F.col("p")).alias("shift"))
    there = F.expr(f"transform(slice(path, 2, size(path)), (u, i) -> struct(u AS unitig, 0L AS low, {k - 1}L - offsets[i + 1] + p AS high, cast(offsets[i + 1] - p AS long) AS shift))")
    return found.select("start_node", "p", "kmer", F.concat(F.array(here), there).alias("units"))


def find(
    graph: SequenceGraph, k: int, include_spanning_nodes: bool = False, max_variant_nodes: int = 255, reverse: bool = False, node_id: int | None = None, units: Unitigs | None = None
) -> DataFrame:
    """(kmer, node_id, start_position, kmer_position) of all occurrences: a row at the first node, or one for each node.

    node_id: only the rows of that node; paths then start only where they can have one. units: the unitigs of the graph for
    this k (see unitigs()), which spare a walk over long chains most of its rounds; the rows are the same.
    """
    starts = None
    if node_id is not None:
        centre = graph.spark.createDataFrame([(node_id,)], "centre long")
        starts = behind(graph, centre, k).select("node_id") if include_spanning_nodes else centre.select(F.col("centre").alias("node_id"))
    walked = walk(graph, k, max_variant_nodes, starts, paths=include_spanning_nodes, units=units)
    if include_spanning_nodes and units:
        out = units.node_rows(_over_units(walked, reverse))
        return out if node_id is None else out.where(F.col("node_id") == node_id)
    found = occurrences_of(walked, reverse)
    if include_spanning_nodes:
        out = spread(found).select("kmer", "node_id", "start_position", "kmer_position")
    else:
        out = found.select("kmer", F.col("start_node").alias("node_id"), F.col("p").alias("start_position"), F.lit(0).alias("kmer_position"))
    return out if node_id is None else out.where(F.col("node_id") == node_id)


def behind(graph: SequenceGraph, centres: DataFrame, k: int, max_steps: int = MAX_STEPS) -> DataFrame:
    """(node_id): nodes from which some path reaches one of the centres with at most k - 2 bases of other nodes between.

    centres: centre. A node keeps one label, the least number of bases to any centre, so rows grow with the nodes reached,
    whatever the number of centres.
    """
    size = graph.nodes.select(F.col("node_id").alias("new"), "length")
    back_edges = graph.edges.select(F.col("src").alias("new"), F.col("dst").alias("node_id")).distinct().join(size, "new")
    # used: the least number of bases from a node's first one to a centre; 0 for a centre itself
    best = front = cut(centres.select(F.col("centre").cast("long").alias("node_id"), F.lit(0).alias("used")).distinct())
    if k == 1:
        return best.select("node_id")
    back = cut(back_edges, "edges")
    for _ in range(max_steps):
        step = front.where(f"used <= {k - 2}").join(back, "node_id").groupBy("new").agg(F.min(F.col("used") + F.col("length")).alias("used"))
        known = best.select(F.col("node_id").alias("new"), F.col("used").alias("had"))
        step = step.join(known, "new", "left").where("had IS NULL OR used < had")
        front = cut(step.select(F.col("new").alias("node_id"), "used"))
        if front.isEmpty():
            return best.select("node_id")
        best = cut(best.unionByName(front).groupBy("node_id").agg(F.min("used").alias("used")))
    raise RuntimeError(f"the search backwards still grows after {max_steps} steps")


def occurrences_over(graph: SequenceGraph, k: int, centres: DataFrame, max_variant_nodes: int = 255, reverse: bool = False) -> DataFrame:
    """Rows of kmers_over() at each centre: all occurrences whose path holds it, each once.

    Paths start only where one can reach a centre.
    """
    walked = walk(graph, k, max_variant_nodes, behind(graph, centres, k).select("node_id"))
    return kmers_over(paths_over(walked, centres).select("centre", "off", "first", "seq"), k, graph.encoding, reverse)


def find_spanning_node(graph: SequenceGraph, k: int, node_id: int, max_variant_nodes: int = 255, include_spanning_nodes: bool = False, reverse: bool = False) -> DataFrame:
    """kmer of every occurrence whose path holds the node; with include_spanning_nodes all rows of those paths."""
    centre = graph.spark.createDataFrame([(node_id,)], "centre long")
    if not include_spanning_nodes:
        return occurrences_over(graph, k, centre, max_variant_nodes, reverse).select("kmer")
    reach = behind(graph, centre, k)
    found = occurrences(graph, k, max_variant_nodes, reach.select("node_id"), reverse)
    return spread(found.where(F.array_contains("path", F.lit(node_id).cast("long")))).select("kmer", "node_id", "start_position", "kmer_position")


def variant_kmers(graph: SequenceGraph, k: int, pairs: DataFrame, max_variant_nodes: int = 255, reverse: bool = False) -> DataFrame:
    """(pair_id, side, kmer, node_id, start_position, kmer_position): k-mers over the two nodes of each pair.

    pairs: pair_id, ref_node, var_node. side is ref or var; a node that is in many pairs is searched once.
    """
    wanted = sides(pairs)
    rows = occurrences_over(graph, k, wanted.select("centre"), max_variant_nodes, reverse)
    return rows.join(wanted, "centre").select("pair_id", "side", "kmer", F.col("centre").alias("node_id"), "start_position", "kmer_position")


def sides(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, centre): the two nodes of each pair."""
    both = F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("ref_node").cast("long").alias("centre")), F.struct(F.lit("var").alias("side"), F.col("var_node").cast("long").alias("centre"))))
    return pairs.select("pair_id", both.alias("x")).select("pair_id", "x.*")
