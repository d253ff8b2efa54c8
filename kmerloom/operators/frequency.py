"""k-mer frequencies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.occurrences import Walk, stretches_of, walk
from kmerloom.operators.superkmers import LEAST_K, asked_kmers, few_counts, superkmer_counts
from kmerloom.plans.model import SequenceGraph


def kmer_counts(rows: DataFrame) -> DataFrame:
    """(kmer, frequency): how often each k-mer stands in the rows; null k-mers are left out."""
    return rows.where("kmer IS NOT NULL").groupBy("kmer").agg(F.count("*").alias("frequency"))


def sequence_counts(sequences: DataFrame, k: int, encoding: str = K.DEFAULT_ENCODING, reverse: bool = False, weight: str | None = None) -> DataFrame:
    """(kmer, frequency) of the sequences (column seq): in bins of minimizers, or, where k allows few different k-mers, by
    adding up in each task first. weight: a column that says how often a sequence counts."""
    if k >= LEAST_K:
        return superkmer_counts(sequences, k, encoding, reverse, weight)
    return few_counts(sequences, k, encoding, reverse, weight)


def walk_counts(walked: Walk, include_spanning_nodes: bool = False, reverse: bool = False) -> DataFrame:
    """(kmer, frequency) of a walk's occurrences, counted from the bases along its paths without listing them."""
    return sequence_counts(stretches_of(walked), walked.k, walked.graph.encoding, reverse, "nodes" if include_spanning_nodes else None)


def asked_counts(walked: Walk, rows: DataFrame, reverse: bool = False) -> DataFrame:
    """(kmer, frequency) of a walk's occurrences, for all k-mers of the rows and perhaps some others.

    A Bloom filter of the rows' k-mers goes to where stretches are cut, so that other k-mers are neither shuffled nor
    counted; the join with the rows then is exact. Below LEAST_K all k-mers are counted, which are few.
    """
    if walked.k < LEAST_K:
        return walk_counts(walked, reverse=reverse)
    return superkmer_counts(stretches_of(walked), walked.k, walked.graph.encoding, reverse, asked=asked_kmers(rows))


def frequency_index(graph: SequenceGraph, k: int, max_variant_nodes: int = 255, include_spanning_nodes: bool = False, reverse: bool = False) -> DataFrame:
    """(kmer, frequency) over all occurrences, or over their rows at every path node."""
    return walk_counts(walk(graph, k, max_variant_nodes, paths=False), include_spanning_nodes, reverse)


def frequency_table(spark: SparkSession, given: DataFrame | Mapping[int, int], k: int, reverse: bool = False) -> DataFrame:
    """A caller's (kmer, frequency) table or mapping with keys as find() without reverse has them; repeats add up."""
    if isinstance(given, DataFrame):
        table = given.select(F.col("kmer").cast("long").alias("kmer"), F.col("frequency").cast("long").alias("frequency"))
    elif isinstance(given, Mapping):
        table = spark.createDataFrame([(int(a), int(b)) for a, b in given.items()], "kmer long, frequency long")
    else:
        raise TypeError("frequencies are a DataFrame or a mapping")
    if reverse:
        table = table.withColumn("kmer", K.reverse_hash(F.col("kmer"), k))
    return table.groupBy("kmer").agg(F.sum("frequency").alias("frequency"))


def with_frequency(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """rows with the frequency of their kmer, 0 where there is none."""
    return rows.join(frequencies, "kmer", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)).cast("long"))


def distinct_kmers(rows: DataFrame) -> DataFrame:
    """One row: how many different k-mers there are."""
    return rows.agg(F.count_distinct("kmer").alias("n_kmers"))
