"""The library as one object: a graph and a k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kmers import MAX_K, check_k, reverse_hash
from kmerloom.operators import frequency, occurrences, signatures
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph
from kmerloom.sources import store
from kmerloom.sources.literals import from_codes


class KmerFinder:
    """Finds k-mers and variant signatures of a graph. reverse_kmers: hash the bases of each k-mer in reverse order."""

    def __init__(self, graph: SequenceGraph, k: int, reverse_kmers: bool = False):
        self.graph, self.k, self.reverse_kmers = graph, check_k(k), reverse_kmers
        self._given: DataFrame | None = None
        self._counted: dict[int, DataFrame] = {}  # by the limit on variant nodes

    def find(self, include_spanning_nodes: bool = False, max_variant_nodes: int = 255, node_id: int | None = None) -> DataFrame:
        return occurrences.find(self.graph, self.k, include_spanning_nodes, max_variant_nodes, self.reverse_kmers, node_id)

    def find_kmers_spanning_node(self, node_id: int, max_variant_nodes: int = 255, include_spanning_nodes: bool = False) -> DataFrame:
        return occurrences.find_spanning_node(self.graph, self.k, node_id, max_variant_nodes, include_spanning_nodes, self.reverse_kmers)

    def find_kmers_for_variants(self, pairs: DataFrame, max_variant_nodes: int = 255) -> DataFrame:
        return occurrences.variant_kmers(self.graph, self.k, pairs, max_variant_nodes, self.reverse_kmers)

    def create_frequency_index(self, max_variant_nodes: int = 255, set_index: bool = True) -> DataFrame:
        """(kmer, frequency), keyed like find(); used by all later signatures if set_index. It is counted and
        written once, whatever the number of uses; write_index() of sources.store keeps it for other sessions."""
        if max_variant_nodes not in self._counted:
            self._counted[max_variant_nodes] = cut(frequency.frequency_index(self.graph, self.k, max_variant_nodes), "index")
        own = self._counted[max_variant_nodes]
        if set_index:
            self._given = own
        return own.withColumn("kmer", reverse_hash(F.col("kmer"), self.k)) if self.reverse_kmers else own

    def use_stored_index(self, path: str) -> None:
        """Use the frequencies that sources.store.write_index() has written for this k, keyed like find() without
        reverse_kmers. They are joined where they lie."""
        self._given = store.read_index(self.graph.spark, path, self.k)

    def set_frequency_index(self, given: DataFrame | Mapping[int, int]) -> None:
        """Use the caller's frequencies, keyed like find(); k-mers that are not in them count 0."""
        self._given = frequency.frequency_table(self.graph.spark, given, self.k, self.reverse_kmers)

    def find_variant_signatures(
        self, reference_nodes: Sequence[int] | DataFrame, variant_nodes: Sequence[int] | None = None, max_variant_nodes: int = 255, minimize_overlaps: bool = False, align_windows: bool = False
    ) -> DataFrame:
        """Signatures of pairs, given as two lists of node ids or as a table (pair_id, ref_node, var_node).

        Without an index set or made before, frequencies are those of this graph under the same number of variant nodes; only
        the k-mers of the windows are counted then. create_frequency_index() makes a whole index for many calls.
        """
        if isinstance(reference_nodes, DataFrame):
            pairs = reference_nodes
        else:
            if variant_nodes is None or len(reference_nodes) != len(variant_nodes):
                raise ValueError("as many variant as reference nodes are needed")
            rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(reference_nodes, variant_nodes, strict=True))]
            pairs = self.graph.spark.createDataFrame(rows, "pair_id long, ref_node long, var_node long")
        counts = self._given if self._given is not None else self._counted.get(max_variant_nodes)
        return signatures.find_variant_signatures(self.graph, self.k, pairs, counts, max_variant_nodes, minimize_overlaps, align_windows, self.reverse_kmers)


def get_variant_signatures(graph: SequenceGraph, pairs: DataFrame, frequencies: DataFrame | Mapping[int, int], k: int = MAX_K) -> DataFrame:
    """Signatures as genotyping uses them: reversed k-mers, at most 4 variant nodes, each side by itself, least overlap."""
    finder = KmerFinder(graph, k, reverse_kmers=True)
    finder.set_frequency_index(frequencies)
    return finder.find_variant_signatures(pairs, max_variant_nodes=4, minimize_overlaps=True)


__all__ = ["KmerFinder", "from_codes", "get_variant_signatures"]
