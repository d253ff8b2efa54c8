"""Graphs and results on disk: parquet, a compact binary file, k-mer text."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.kmers import check_encoding, decode_kmer, digits
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import NODES, SequenceGraph, with_in_order

#: Head of the binary graph file (fixed values of the format): magic and version.
MAGIC, VERSION = b"BIOCYGRAPH", 1


def write_graph(graph: SequenceGraph, path: str) -> None:
    """The graph as parquet tables under path, with its reference order and both edge lists."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.spark.createDataFrame([(graph.encoding,)], "encoding string").write.mode("overwrite").parquet(f"{path}/encoding")


def read_graph(spark: SparkSession, path: str) -> SequenceGraph:
    return SequenceGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/encoding").first()[0])


def write_index(counts: DataFrame, path: str, k: int, buckets: int | None = None) -> None:
    """(kmer, frequency), one row for each k-mer, under path: in files of k-mers by hash, sorted.

    buckets: how many files, by default as many as shuffle partitions. Joins and groups by k-mer over what read_index()
    gives then need no exchange of the index, whatever its size.
    """
    spark = counts.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _index_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = counts.select(F.col("kmer").cast("long").alias("kmer"), F.col("frequency").cast("long").alias("frequency")).repartition(n, "kmer")
    rows.write.mode("overwrite").format("parquet").option("path", f"{path}/counts").bucketBy(n, "kmer").sortBy("kmer").saveAsTable(name)
    spark.createDataFrame([(k, n)], "k int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _index_name(path: str) -> str:
    return "kmer_index_" + hashlib.md5(path.encode()).hexdigest()


def read_index(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The (kmer, frequency) that write_index() has stored under path, in any session; ValueError if it is for another k."""
    own, buckets = spark.read.parquet(f"{path}/about").first()
    if own != k:
        raise ValueError(f"the index holds k-mers of {own} bases, not {k}")
    name = _index_name(path)
    if not spark.catalog.tableExists(name):  # another session has written it: its buckets are known by the names of its files
        place = f"{path}/counts".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (kmer BIGINT, frequency BIGINT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def forget_index(spark: SparkSession, path: str) -> None:
    """Drop the name of a stored index from the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_index_name(path)}")


def _parse(content: bytes):
    if content[: len(MAGIC)] != MAGIC or content[len(MAGIC)] != VERSION:
        raise ValueError("not a binary graph of version 1")
    at = len(MAGIC) + 1
    order = content[at : at + 4].decode()
    (count,) = struct.unpack_from("<I", content, at + 4)
    at += 8
    for node in range(count):
        length, words = struct.unpack_from("<II", content, at)
        packed = struct.unpack_from(f"<{words}Q", content, at + 8)
        at += 8 + 8 * words
        degree = content[at]
        edges = struct.unpack_from(f"<{degree}I", content, at + 1)
        at += 1 + 4 * degree
        bits = "".join(f"{w:064b}" for w in packed)
        yield node, "".join(order[int(bits[2 * i : 2 * i + 2], 2)] for i in range(length)), list(edges), bool(content[at]), order
        at += 1


def read_binary(spark: SparkSession, path: str) -> SequenceGraph:
    """The graph of a binary file: magic, version byte, 4 encoding characters, u32 nodes, then of each node u32 bases, u32
    words, the words (32 bases each, 2 bits a base from the high bits on), u8 edges, the u32 edges, u8 reference flag.

    The format holds no reference order and no in-lists; the latter follow from the edges. One file is read by one task.
    """

    def parse(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(_parse(content)), columns=["node_id", "seq", "edges", "is_ref", "encoding"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = cut(files.mapInPandas(parse, "node_id long, seq string, edges array<long>, is_ref boolean, encoding string"))
    order = rows.select("encoding").first()
    nodes = rows.select("node_id", "seq", F.length("seq").alias("length"), "is_ref", F.lit(None).cast("long").alias("ref_index"))
    links = rows.select(F.col("node_id").alias("src"), F.posexplode("edges").alias("out_ord", "dst"))
    return SequenceGraph(nodes, with_in_order(links), order[0] if order else "ACGT")


def binary_nodes(graph: SequenceGraph) -> DataFrame:
    """(node_id, record): each node as the binary file has it."""
    order = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("out_ord", "dst"))), lambda x: x["dst"]).alias("edges"))
    rows = graph.nodes.join(order, "node_id", "left").select("node_id", digits(F.col("seq"), graph.encoding).alias("codes"), "edges", "is_ref")

    def pack(frames):
        for frame in frames:
            records = []
            for codes, edges, is_ref in zip(frame["codes"], frame["edges"], frame["is_ref"], strict=True):
                own = [] if edges is None else list(edges)
                if len(own) > 255:
                    raise ValueError("the format has at most 255 edges a node")
                words = [int(codes[a : a + 32].ljust(32, "0"), 4) for a in range(0, len(codes), 32)]
                records.append(struct.pack(f"<II{len(words)}QB{len(own)}IB", len(codes), len(words), *words, len(own), *own, is_ref))
            yield pd.DataFrame({"node_id": frame["node_id"], "record": records})

    return rows.mapInPandas(pack, "node_id long, record binary")


def write_binary(graph: SequenceGraph, path: str) -> None:
    """The graph as one binary file on any file system that Spark reaches; node ids must be dense.

    Tasks pack the nodes and sort them; the driver passes the packed records on to the one file, a partition at a time,
    and puts it into place when it is whole. write_graph() is the way without one file.
    """
    spark = graph.spark
    n, top = graph.nodes.agg(F.count("*"), F.coalesce(F.max("node_id"), F.lit(-1))).first()
    if top + 1 != n:
        raise ValueError("the format needs dense ids")
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        buffer = bytearray(MAGIC + bytes([VERSION]) + graph.encoding.encode() + struct.pack("<I", n))
        for row in cut(binary_nodes(graph).orderBy("node_id"), "binary").orderBy("node_id").select("record").toLocalIterator():
            buffer += row.record
            if len(buffer) >= 1 << 20:
                out.write(buffer)
                buffer = bytearray()
        out.write(buffer)
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


def kmer_lines(rows: DataFrame) -> DataFrame:
    """(value): a text line for each found row, kmer, tab, node:start_position:kmer_position."""
    return rows.select(F.format_string("%d\t%d:%d:%d", "kmer", "node_id", "start_position", "kmer_position").alias("value"))


def write_kmers(rows: DataFrame, path: str) -> None:
    kmer_lines(rows).write.mode("overwrite").text(path)


def signature_text(signatures: DataFrame, k: int, encoding: str = "ACGT") -> DataFrame:
    """(pair_id, reference, variant, max_frequency): signatures with k-mers as text."""
    check_encoding(encoding)
    named = [F.transform(c, lambda x: decode_kmer(x, k, encoding)).alias(n) for c, n in (("reference_kmers", "reference"), ("variant_kmers", "variant"))]
    return signatures.select("pair_id", *named, "max_frequency")


def to_arrays(graph: SequenceGraph) -> DataFrame:
    """(node_id, length, codes, edges, is_ref, is_nonempty_ref): the graph as array columns, by node."""
    order = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("out_ord", "dst"))), lambda x: x["dst"]).alias("edges"))
    codes = F.when(F.col("length") > 0, F.transform(F.split(digits(F.col("seq"), graph.encoding), ""), lambda x: x.cast("int"))).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))
    return graph.nodes.join(order, "node_id", "left").select(
        "node_id", "length", codes.alias("codes"), F.coalesce("edges", F.array().cast(T.ArrayType(T.LongType()))).alias("edges"), "is_ref", (F.col("is_ref") & (F.col("length") > 0)).alias("is_nonempty_ref")
    )


def chromosome_start(graph: SequenceGraph) -> DataFrame:
    """(node_id): the least node with out-edges that no edge leads to; null if there is none."""
    out, into = graph.edges.select(F.col("src").alias("node_id")), graph.edges.select(F.col("dst").alias("node_id"))
    return graph.nodes.select("node_id").join(out, "node_id", "left_semi").join(into, "node_id", "left_anti").agg(F.min("node_id").alias("node_id"))


def empty_graph(spark: SparkSession, encoding: str = "ACGT") -> SequenceGraph:
    return SequenceGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], "src long, dst long, out_ord int, in_ord int"), encoding)
