"""Graphs from Python values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions.kmers import DEFAULT_ENCODING, check_encoding
from kmerloom.plans.model import EDGES, NODES, SequenceGraph, node_table, with_in_order
from kmerloom.plans.numbering import number_rows


def from_lists(spark: SparkSession, sequences: Sequence[str], edges: Sequence[Sequence[int]], encoding: str = DEFAULT_ENCODING, ref: Iterable[int] | None = None) -> SequenceGraph:
    """Node i has sequences[i] and out-list edges[i]. ref lists the reference nodes; without it all are. No reference order."""
    if len(sequences) != len(edges):
        raise ValueError("as many out-lists as sequences are needed")
    chosen = None if ref is None else set(ref)
    rows = [(i, s, len(s), chosen is None or i in chosen, None) for i, s in enumerate(sequences)]
    links = [(a, int(b), i) for a, own in enumerate(edges) for i, b in enumerate(own)]
    nodes = spark.createDataFrame(rows, NODES)
    return SequenceGraph(nodes, with_in_order(spark.createDataFrame(links, "src long, dst long, out_ord int")), encoding).validate()


def from_tables(nodes: DataFrame, encoding: str = DEFAULT_ENCODING, ref: DataFrame | None = None) -> SequenceGraph:
    """The same from a table (node_id, seq, edges array); ref: node_id of reference nodes."""
    own = nodes.select("node_id", "seq", "edges")
    if ref is None:
        marked = own.withColumn("is_ref", F.lit(True))
    else:
        marked = own.join(ref.select("node_id", F.lit(True).alias("is_ref")).distinct(), "node_id", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False)))
    links = own.select(F.col("node_id").cast("long").alias("src"), F.posexplode("edges").alias("out_ord", "dst")).withColumn("dst", F.col("dst").cast("long"))
    return SequenceGraph(node_table(marked), with_in_order(links), encoding)


def from_codes(spark: SparkSession, codes: Sequence[Sequence[int]], edges: Sequence[Sequence[int]], is_ref: Sequence[bool], encoding: str = DEFAULT_ENCODING) -> SequenceGraph:
    """A graph from ragged base codes 0 to 3 in the given encoding, out-lists and a reference mask."""
    order = check_encoding(encoding)
    if not len(codes) == len(edges) == len(is_ref):
        raise ValueError("codes, edges and is_ref differ in length")
    if any(not 0 <= int(c) < 4 for own in codes for c in own):
        raise ValueError("codes are from 0 to 3")
    return from_lists(spark, ["".join(order[int(c)] for c in own) for own in codes], edges, encoding, [i for i, r in enumerate(is_ref) if r])


def from_code_table(table: DataFrame, encoding: str = DEFAULT_ENCODING) -> SequenceGraph:
    """The same as from_codes() from a table (node_id, codes array, edges array, is_ref), as to_arrays() gives it."""
    order = check_encoding(encoding)
    letters = F.array(*(F.lit(c) for c in order))
    own = table.select("node_id", F.array_join(F.transform("codes", lambda c: F.get(letters, c)), "").alias("seq"), "edges", "is_ref")
    links = own.select(F.col("node_id").cast("long").alias("src"), F.posexplode("edges").alias("out_ord", "dst")).withColumn("dst", F.col("dst").cast("long"))
    return SequenceGraph(node_table(own), with_in_order(links), encoding)


def add_nodes(graph: SequenceGraph, table: DataFrame, *order: str) -> SequenceGraph:
    """The graph with nodes (seq, is_ref) of a table after its own, ids counting on in the given order, without ties."""
    top = graph.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("top"))
    new = number_rows(table.select(*dict.fromkeys(("seq", "is_ref", *order))), "i", *order).crossJoin(F.broadcast(top))  # one row
    return graph.with_tables(graph.nodes.unionByName(node_table(new.withColumn("node_id", F.col("i") + F.col("top") + 1))), graph.edges)


def add_edges(graph: SequenceGraph, table: DataFrame, *order: str) -> SequenceGraph:
    """The graph with edges (src, dst) of a table after those that the nodes' lists have, in the given order."""
    new = table.select("src", "dst", *(c for c in order if c not in ("src", "dst")))
    for end, place in (("src", "out_ord"), ("dst", "in_ord")):
        had = graph.edges.groupBy(end).agg((F.max(place) + 1).alias("_had"))
        at = F.row_number().over(W.partitionBy(end).orderBy(*order)) - 1
        new = new.withColumn(place, at).join(had, end, "left").withColumn(place, (F.col(place) + F.coalesce("_had", F.lit(0))).cast("int")).drop("_had")
    return graph.with_tables(graph.nodes, graph.edges.unionByName(new.select("src", "dst", "out_ord", "in_ord")))


class GraphBuilder:
    """Collects nodes and edges one by one on the driver, for small graphs; ids are dense, in the order of adding.

    add_nodes() and add_edges() do the same with tables.
    """

    def __init__(self, encoding: str = DEFAULT_ENCODING):
        self.encoding = check_encoding(encoding)
        self._nodes: list[tuple] = []
        self._edges: list[tuple] = []
        self._out: dict[int, int] = {}
        self._in: dict[int, int] = {}

    def add_node(self, seq: str = "", is_ref: bool = True, ref_index: int | None = None) -> int:
        self._nodes.append((len(self._nodes), seq, len(seq), is_ref, ref_index))
        return len(self._nodes) - 1

    def add_empty_node(self) -> int:
        return self.add_node("", False)

    def add_edge(self, src: int, dst: int) -> None:
        for end in (src, dst):
            if not 0 <= end < len(self._nodes):
                raise ValueError(f"there is no node {end}")
        out, into = self._out.get(src, 0), self._in.get(dst, 0)
        self._out[src], self._in[dst] = out + 1, into + 1
        self._edges.append((src, dst, out, into))

    def build(self, spark: SparkSession) -> SequenceGraph:
        """The graph; in-lists in the order in which the edges were added."""
        return SequenceGraph(spark.createDataFrame(self._nodes, NODES), spark.createDataFrame(self._edges, EDGES), self.encoding).validate()
