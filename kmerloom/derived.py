"""Sequence graphs and text formats derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.plans.lineage import new_path
from kmerloom.plans.model import SequenceGraph, with_in_order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: Column) -> Column:
    """32 bases that follow from a text."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGT" * 4)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, ref, alt): a reference allele for each part, and an alternative, maybe empty, for each third one."""
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("site"),
        F.substr(bases(key), F.lit(1), F.col("p_size") % 12 + 1).alias("ref"),
        F.when(F.col("p_partkey") % 3 == 1, F.substr(bases(F.concat(F.lit("v"), key)), F.lit(1), F.col("p_size") % 4)).alias("alt"),
    )


def bubble_graph(spark: SparkSession, sf_dir: str) -> SequenceGraph:
    """Site i has reference node 2i and, with an alternative, variant node 2i + 1; every node of a site leads to all of the next."""
    own = sites(spark, sf_dir)
    alleles = own.select("site", F.explode(F.array(F.struct((F.col("site") * 2).alias("node_id"), F.col("ref").alias("seq"), F.lit(True).alias("is_ref")), F.struct((F.col("site") * 2 + 1).alias("node_id"), F.col("alt").alias("seq"), F.lit(False).alias("is_ref")))).alias("x"))
    rows = alleles.select("site", "x.*").where("seq IS NOT NULL")
    nodes = rows.select("node_id", "seq", F.length("seq").alias("length"), "is_ref", F.when(F.col("is_ref"), F.col("site")).alias("ref_index"))
    # out-lists are known without a window: the next site's reference node, then its variant
    edges = rows.select(F.col("node_id").alias("src"), (F.col("site") + 1).alias("site")).join(rows.select("site", F.col("node_id").alias("dst")), "site")
    return SequenceGraph(nodes, with_in_order(edges.select("src", "dst", (F.col("dst") % 2).cast("int").alias("out_ord"))))


def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref_node, var_node) of every site with an alternative."""
    return sites(spark, sf_dir).where("alt IS NOT NULL").select(F.col("site").alias("pair_id"), (F.col("site") * 2).alias("ref_node"), (F.col("site") * 2 + 1).alias("var_node"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): the letters A, C, G and T of every document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def chain_graph(spark: SparkSession, sf_dir: str) -> SequenceGraph:
    """Nodes of single parts; part i leads to i + 1 unless 5 divides i, and to i + 2 if 7 divides it. No reference order."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.substr(bases(F.col("p_partkey").cast("string")), F.lit(1), F.col("p_size") % 12 + 1).alias("seq"), (F.col("p_partkey") % 4 != 3).alias("is_ref"))
    nodes = nodes.select("node_id", "seq", F.length("seq").alias("length"), "is_ref", F.when(F.col("is_ref"), F.col("node_id")).alias("ref_index"))
    ends = part.select(F.col("p_partkey").alias("src"), F.explode(F.array_compact(F.array(F.when(F.col("p_partkey") % 5 != 0, 0), F.when(F.col("p_partkey") % 7 == 0, 1)))).alias("out"))
    edges = ends.select("src", (F.col("src") + 1 + F.col("out")).alias("dst"), F.col("out").alias("out_ord")).join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return SequenceGraph(nodes, with_in_order(edges))


def long_chain_graph(spark: SparkSession, sf_dir: str) -> SequenceGraph:
    """Nodes of up to three bases, some empty, of single parts; part i leads to i + 1 unless 97 divides it, and to i + 2 if
    20 divides it. One node in 40 is a variant."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.substr(bases(F.col("p_partkey").cast("string")), F.lit(1), F.col("p_size") % 4).alias("seq"), (F.col("p_partkey") % 40 != 3).alias("is_ref"))
    nodes = nodes.select("node_id", "seq", F.length("seq").alias("length"), "is_ref", F.when(F.col("is_ref"), F.col("node_id")).alias("ref_index"))
    ends = part.select(F.col("p_partkey").alias("src"), F.explode(F.array_compact(F.array(F.when(F.col("p_partkey") % 97 != 0, 0), F.when(F.col("p_partkey") % 20 == 0, 1)))).alias("out"))
    edges = ends.select("src", (F.col("src") + 1 + F.col("out")).alias("dst"), F.col("out").alias("out_ord")).join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return SequenceGraph(nodes, with_in_order(edges))


def gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, line_no): a header, a segment for each node of the bubble graph, its links, and a path over reference nodes
    for each hundred sites. Segment names are 3 times the node id and so leave gaps."""
    graph = bubble_graph(spark, sf_dir)
    head = spark.range(1).select(F.lit("H\tVN:Z:1.0").alias("value"), F.lit(-1).cast("long").alias("line_no"))
    s = graph.nodes.select(F.concat_ws("\t", F.lit("S"), (F.col("node_id") * 3).cast("string"), "seq").alias("value"), F.col("node_id").alias("line_no"))
    line = F.concat_ws("\t", F.lit("L"), (F.col("src") * 3).cast("string"), F.lit("+"), (F.col("dst") * 3).cast("string"), F.lit("+"), F.lit("0M"))
    links = graph.edges.select(line.alias("value"), (F.col("src") * 2 + F.col("out_ord") + 10_000_000_000).alias("line_no"))
    ref = graph.nodes.where("is_ref").select("node_id", F.floor(F.col("ref_index") / 100).alias("g"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("node_id")), lambda x: F.concat((x * 3).cast("string"), F.lit("+"))), ",")
    paths = ref.groupBy("g").agg(listed.alias("nodes")).select(F.concat_ws("\t", F.lit("P"), F.concat(F.lit("p"), F.col("g").cast("string")), "nodes", F.lit("*")).alias("value"), (F.col("g") + 20_000_000_000).alias("line_no"))
    return head.unionByName(s).unionByName(links).unionByName(paths)


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, line_no): two header lines and a variant for each part.

    Row i gives a variant near base 7i of chromosome 1 + i mod 3; kinds turn over single bases, insertions,
    deletions, two alternatives, points, and structural ones."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), "p_size")
    b, c = bases(F.col("i").cast("string")), bases(F.concat(F.lit("w"), F.col("i").cast("string")))
    ref = F.substr(b, F.lit(1), F.col("p_size") % 4 + 1)
    kind = F.col("i") % 7
    alt = (
        F.when(kind == 0, F.substr(c, F.lit(1), F.lit(1)))
        .when(kind == 1, F.concat(ref, F.substr(c, F.lit(1), F.lit(3))))
        .when(kind == 2, F.substr(b, F.lit(1), F.lit(1)))
        .when(kind == 3, F.concat(F.substr(b, F.lit(1), F.lit(1)), F.lit("A,"), F.substr(b, F.lit(1), F.lit(1)), F.lit("CC")))
        .when(kind == 4, F.lit("."))
        .when(kind == 5, F.lit("<DEL>"))
        .otherwise(F.lower(F.substr(c, F.lit(2), F.lit(2))))
    )
    row = F.concat_ws("\t", F.concat(F.when(F.col("i") % 2 == 0, F.lit("chr")).otherwise(F.lit("")), (F.col("i") % 3 + 1).cast("string")), (F.col("i") * 7 + F.col("p_size")).cast("string"), F.lit("."), ref, alt, F.lit("."))
    head = spark.range(2).select(F.when(F.col("id") == 0, "##fileformat=VCFv4.2").otherwise("#CHROM\tPOS\tID\tREF\tALT").alias("value"), (F.col("id") - 2).alias("line_no"))
    return head.unionByName(part.select(row.alias("value"), F.col("i").alias("line_no")))


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, line_no): contigs 1 to 3, each the bases of one line for every part (with some lower case, N and other
    letters), long enough for vcf_lines()."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    n = F.col("n")
    size = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    own = bases(F.concat_ws("-", F.col("c").cast("string"), F.col("i").cast("string")))
    text = F.when(F.col("i") % 5 == 0, F.lower(own)).when(F.col("i") % 11 == 0, F.concat(own, F.lit("NRYn"))).otherwise(own)
    each = part.crossJoin(spark.range(1, 4).select(F.col("id").alias("c")))  # three contigs
    lines = each.crossJoin(F.broadcast(size)).select(text.alias("value"), ((n + 1) * (F.col("c") - 1) + 1 + F.col("i")).alias("line_no"))
    heads = spark.range(1, 4).crossJoin(F.broadcast(size)).select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" contig")).alias("value"), ((n + 1) * (F.col("id") - 1)).alias("line_no"))
    return heads.unionByName(lines)


def fasta_vcf_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The FASTA and the VCF lines as text files in the shared folder."""
    paths = new_path(spark, "fasta"), new_path(spark, "vcf")
    for lines, path in zip((fasta_lines(spark, sf_dir), vcf_lines(spark, sf_dir)), paths, strict=True):
        lines.orderBy("line_no").select("value").write.text(path)
    return paths


def gfa_file(spark: SparkSession, sf_dir: str) -> str:
    """The GFA lines as text files in the shared folder."""
    path = new_path(spark, "gfa")
    gfa_lines(spark, sf_dir).orderBy("line_no").select("value").write.text(path)
    return path


def chain_gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, line_no): chain_graph() as text, names without gaps from 100 on; every fourth node is off the one path."""
    graph = chain_graph(spark, sf_dir)
    name = lambda c: (F.col(c) + 100).cast("string")
    s = graph.nodes.select(F.concat_ws("\t", F.lit("S"), name("node_id"), "seq").alias("value"), F.col("node_id").alias("line_no"))
    line = F.concat_ws("\t", F.lit("L"), name("src"), F.lit("+"), name("dst"), F.lit("+"), F.lit("0M"))
    links = graph.edges.select(line.alias("value"), (F.col("src") * 2 + F.col("out_ord") + 10_000_000_000).alias("line_no"))
    paths = graph.nodes.where("is_ref").select(F.concat(F.lit("P\tp"), name("node_id"), F.lit("\t"), name("node_id"), F.lit("+\t*")).alias("value"), (F.col("node_id") + 20_000_000_000).alias("line_no"))
    return s.unionByName(links).unionByName(paths)


def heap_graph(spark: SparkSession, sf_dir: str) -> SequenceGraph:
    """Nodes of single parts; part i leads to 2i, 2i + 1 and 3i, so that walks are short and of several lengths."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    nodes = part.select(F.col("i").alias("node_id"), F.lit("A").alias("seq"), F.lit(1).alias("length"), F.lit(True).alias("is_ref"), F.lit(None).cast("long").alias("ref_index"))
    ends = part.select(F.col("i").alias("src"), F.posexplode(F.array(F.col("i") * 2, F.col("i") * 2 + 1, F.col("i") * 3)).alias("out_ord", "dst"))
    return SequenceGraph(nodes, with_in_order(ends.where("dst > src").join(part.select(F.col("i").alias("dst")), "dst", "left_semi")))
