"""A directed sequence graph as two tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions.kmers import DEFAULT_ENCODING, check_encoding, is_bases

NODES = "node_id long, seq string, length int, is_ref boolean, ref_index long"
EDGES = "src long, dst long, out_ord int, in_ord int"


@dataclass(frozen=True)
class SequenceGraph:
    """nodes: node_id, seq (may be empty), length, is_ref, ref_index (null where the builder knows no reference order).
    edges: src, dst, and the edge's place in the out-list of src and in the in-list of dst, from 0.
    """

    nodes: DataFrame
    edges: DataFrame
    encoding: str = DEFAULT_ENCODING

    def __post_init__(self):
        object.__setattr__(self, "encoding", check_encoding(self.encoding))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_tables(self, nodes: DataFrame, edges: DataFrame) -> SequenceGraph:
        return replace(self, nodes=nodes, edges=edges)

    def validate(self) -> SequenceGraph:
        """self, or ValueError if sequences hold other characters, ids repeat, or edges lead nowhere."""
        if not self.nodes.where(~is_bases(F.col("seq")) | F.col("seq").isNull() | F.col("node_id").isNull()).isEmpty():
            raise ValueError("a node without id or with characters other than A, C, G, T, N")
        if not self.nodes.groupBy("node_id").count().where("count > 1").isEmpty():
            raise ValueError("node ids repeat")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
        if not ends.join(self.nodes, "node_id", "left_anti").isEmpty():
            raise ValueError("an edge to or from a node that isn't there")
        return self


def node_table(df: DataFrame, ref_index: Column | None = None) -> DataFrame:
    """node_id, seq and is_ref completed to the node schema."""
    index = F.lit(None) if ref_index is None else ref_index
    return df.select(
        F.col("node_id").cast("long"), F.col("seq"), F.length("seq").alias("length"), F.col("is_ref"), index.cast("long").alias("ref_index")
    )


def edge_table(df: DataFrame, *order: Column) -> DataFrame:
    """src and dst completed to the edge schema; out-lists follow the given order, in-lists ascending source, then out-list."""
    out = df.withColumn("out_ord", (F.row_number().over(W.partitionBy("src").orderBy(*order)) - 1).cast("int"))
    return with_in_order(out.select(F.col("src").cast("long"), F.col("dst").cast("long"), "out_ord"))


def with_in_order(edges: DataFrame) -> DataFrame:
    """The in-list places that follow from sources and their out-lists."""
    at = F.row_number().over(W.partitionBy("dst").orderBy("src", "out_ord")) - 1
    return edges.select("src", "dst", "out_ord", at.cast("int").alias("in_ord"))
