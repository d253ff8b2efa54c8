"""Compaction before a walk: chains of reference nodes become unitigs, paths grow over these, and rows lead back to nodes.

A unitig is a longest chain of reference nodes in which each leads only to the next, and the next is led to only by it.
Other nodes are unitigs of one node, so the limit on variant nodes means the same. An occurrence in the graph of unitigs is
one in the graph of nodes: where it starts in a node, the node's bases and the k - 1 that follow in its unitig are at
hand, and a path needs a step only where it leaves a unitig, so a walk has as many rounds as unitigs, not nodes, within
k - 1 bases. Which nodes lie under an occurrence follows from their offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.graph import chain_map
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph
from kmerloom.plans.numbering import running
from kmerloom.sources.merge import cut_ranges

#: Bases of a unitig in one row while it is put together.
PIECE = 1 << 14


@dataclass(frozen=True)
class Unitigs:
    """The back map of a compacted graph for one k.

    members: node_id, unitig, off (its first base there), length, and ahead, the bases of the unitig behind it, k - 1 at most.
    steps: unitig edges (src, dst, out_ord) with more, prefix and v of the unitig that they lead to, as a walk takes them.
    """

    graph: SequenceGraph
    k: int
    members: DataFrame
    steps: DataFrame

    def fronts(self, nodes: DataFrame) -> DataFrame:
        """nodes with unitig, ahead and rest, the number of these bases."""
        return nodes.join(self.members.select("node_id", "unitig", "ahead").hint("merge"), "node_id").withColumn("rest", F.length("ahead"))

    def node_rows(self, found: DataFrame) -> DataFrame:
        """A row for each node of each occurrence: found with node_id, start_position and kmer_position.

        found: start_node, p and units, an array of (unitig, low, high, shift): where its k-mer covers bases low to high of
        a unitig, behind the start node, base low being number low + shift of the k-mer.
        """
        k = self.k
        first = found.select("kmer", F.col("start_node").alias("node_id"), F.col("p").alias("start_position"), F.lit(0).alias("kmer_position"))
        each = found.select("kmer", F.explode("units").alias("u")).select("kmer", "u.*").where("low <= high")
        each = each.withColumn("bucket", F.explode(F.expr(f"sequence(low div {k}, high div {k})")))
        placed = self.members.select(F.col("unitig"), F.expr(f"off div {k}").alias("bucket"), "node_id", "off")
        later = each.join(placed.hint("merge"), ["unitig", "bucket"]).where("off BETWEEN low AND high")
        return first.unionByName(later.select("kmer", "node_id", F.lit(0).alias("start_position"), (F.col("off") + F.col("shift")).cast("int").alias("kmer_position")))


def unitigs(graph: SequenceGraph, k: int) -> Unitigs:
    """The unitigs of a graph. Offsets are running sums along each chain, and bases behind a node come from pieces of its
    unitig, so that no task has a whole unitig, however long."""
    K.check_k(k)
    chains = chain_map(graph, reference=True).select("node_id", F.col("head").alias("unitig"), "place")
    rows = graph.nodes.select("node_id", "seq", "length", "is_ref").join(chains.hint("merge"), "node_id")
    placed = running(rows, "unitig", ["place"], upto=("sum", "length")).withColumn("off", F.col("upto") - F.col("length"))
    placed = cut(placed, "placed")
    long = placed.where("place = 1").select("unitig").distinct()  # unitigs of more than one node
    inner = placed.join(long.hint("merge"), "unitig", "left_semi")
    at = inner.where("length > 0").withColumn("piece", F.explode(F.expr(f"sequence(off div {PIECE}, (upto - 1) div {PIECE})")))
    low = F.greatest(F.col("piece") * PIECE - F.col("off"), F.lit(0))
    part = F.substr("seq", (low + 1).cast("int"), F.least((F.col("piece") + 1) * PIECE - F.greatest("off", F.col("piece") * PIECE), F.lit(PIECE)).cast("int"))
    pieces = at.select("unitig", "piece", "off", part.alias("s")).groupBy(F.col("unitig").alias("chrom"), "piece")
    pieces = pieces.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "s"))), lambda x: x["s"]), "").alias("text"))
    pieces = cut(pieces, "pieces")
    size = F.lit(k - 1).cast("long").alias("size")
    behind = inner.select(F.col("unitig").alias("chrom"), "node_id", F.lit(True).alias("behind"), F.col("upto").alias("start"), size)
    heads = inner.where("place = 0").select(F.col("unitig").alias("chrom"), "node_id", F.lit(False).alias("behind"), F.lit(0).cast("long").alias("start"), size)
    found = cut(cut_ranges(pieces, behind.unionByName(heads), ["node_id", "behind"], PIECE).select("node_id", "behind", F.col("seq").alias("bases")), "ranges")
    ahead = found.where("behind").select("node_id", F.col("bases").alias("ahead"))
    members = placed.join(ahead.hint("merge"), "node_id", "left").select("node_id", "unitig", "off", "length", F.coalesce("ahead", F.lit("")).alias("ahead"))
    prefix = found.where("NOT behind").select(F.col("node_id").alias("unitig"), F.col("bases").alias("first"))
    whole = placed.where("place = 0").join(prefix.hint("merge"), "unitig", "left").select(F.col("unitig").alias("dst"), F.coalesce("first", F.substring("seq", 1, k - 1)).alias("prefix"), (~F.col("is_ref")).cast("int").alias("v"))
    onward = graph.edges.select(F.col("src").alias("node_id"), "dst", "out_ord").join(placed.select("node_id", "unitig").hint("merge"), "node_id")
    steps = onward.join(whole.hint("merge"), "dst").select(F.col("unitig").alias("src"), "dst", "out_ord", F.length("prefix").alias("more"), "prefix", "v")
    return Unitigs(graph, k, cut(members, "members"), cut(steps, "edges"))
