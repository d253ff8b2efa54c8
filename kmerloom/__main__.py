"""python -m kmerloom FASTA VCF OUT: merge a reference and its variants, write the graph, print its number of nodes."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.merge import from_fasta_vcf
from kmerloom.sources.store import read_graph, write_graph


def build(spark: SparkSession, fasta: str, vcf: str, out: str) -> DataFrame:
    """Merge the files, write the graph to out, and give its size (n_nodes) as read from there."""
    write_graph(from_fasta_vcf(spark, fasta, vcf), out)
    return read_graph(spark, out).nodes.agg(F.count("*").alias("n_nodes"))


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__)
        return 2
    print(build(SparkSession.builder.getOrCreate(), *args).first().n_nodes)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
