"""A linear reference and its variants merged into a graph of bubbles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions.kmers import DEFAULT_ENCODING
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph, with_in_order
from kmerloom.plans.numbering import number_rows, running
from kmerloom.sources.fasta import PIECE, read_fasta
from kmerloom.sources.vcf import ALL, read_vcf


def next_kept(variants: DataFrame) -> DataFrame:
    """variants (numbered: rank, in order of chromosome, position and row) with nxt: the rank of the variant that is kept
    next if this one is, the first that begins at or past its end; null after the last.

    Beginnings and ends are read together from the last place to the first; what an end has seen last is what follows it.
    """
    begins = variants.select("chrom", F.col("pos").alias("at"), F.lit(0).alias("kind"), "rank", (-F.col("rank")).alias("seen"))
    ends = variants.select("chrom", (F.col("pos") + F.length("ref")).alias("at"), F.lit(1).alias("kind"), "rank", F.lit(None).cast("long").alias("seen"))
    swept = running(begins.unionByName(ends).withColumn("back", -F.col("at")), "chrom", ["back", "kind", "rank"], near=("max", "seen"))
    found = swept.where("kind = 1").select("rank", (-F.col("near")).alias("near"))
    last = variants.groupBy("chrom").agg(F.max("rank").alias("last"))
    # a variant without reference bases ends where it begins: the next one in order follows
    following = F.when(F.col("near").isNotNull(), F.greatest("near", F.col("rank") + 1))
    out = variants.join(found, "rank").join(last, "chrom").withColumn("nxt", following)
    return out.withColumn("nxt", F.when(F.col("nxt") <= F.col("last"), F.col("nxt"))).drop("near", "last")


def kept_variants(variants: DataFrame) -> DataFrame:
    """variants without those that begin before the end of the last kept one, in order of (pos, row_id) per chromosome.

    A variant that begins at or past the end of all before it is kept, whatever came before. From each of these the kept
    ones are a chain: each links to the first that begins past its end. Links are doubled, and in each round the targets
    of kept variants are kept too, so a chain takes as many rounds as the logarithm of its length, and no task has a
    whole stretch of overlapping variants.
    """
    ranked = number_rows(variants, "rank", "chrom", "pos", "row_id")
    ends = running(ranked, "chrom", ["pos", "row_id"], past=("max", "pos + length(ref)"))
    linked = cut(next_kept(ends.withColumn("head", F.expr("past IS NULL OR pos >= past"))), "linked")
    heads = linked.where("head").select(F.col("rank").alias("nxt"), F.lit(True).alias("is_head"))
    # links to heads need not be followed: they are kept anyway
    inner = linked.where("nxt IS NOT NULL").join(heads, "nxt", "left").where("is_head IS NULL").select("rank", "nxt")
    jumps = cut(inner, "jumps")
    kept = cut(linked.where("head").select("rank"), "kept")
    while True:
        reached = cut(jumps.join(kept, "rank", "left_semi").select(F.col("nxt").alias("rank")), "reached")
        if reached.isEmpty():
            break
        kept = cut(kept.unionByName(reached).distinct(), "kept")
        jumps = cut(jumps.join(jumps.select(F.col("rank").alias("nxt"), F.col("nxt").alias("then")), "nxt").select("rank", F.col("then").alias("nxt")), "jumps")
    return linked.join(kept, "rank", "left_semi").select("chrom", "pos", "row_id", "ref", "alts")


def in_pieces(contigs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(chrom, n, piece, text) of contigs that are whole (chrom, seq) or in such pieces already."""
    if "piece" in contigs.columns:
        return contigs.select("chrom", "n", "piece", "text")
    raw = contigs.select("chrom", F.col("seq").cast("binary").alias("seq"), F.length("seq").cast("long").alias("n"))
    at = raw.withColumn("piece", F.explode(F.expr(f"CASE WHEN n > 0 THEN sequence(0L, (n - 1) div {piece}) ELSE array(0L) END")))
    return at.select("chrom", "n", "piece", F.substr("seq", (F.col("piece") * piece + 1).cast("int"), F.lit(piece)).cast("string").alias("text"))


def cut_ranges(pieces: DataFrame, ranges: DataFrame, key: list[str], piece: int = PIECE) -> DataFrame:
    """ranges (chrom, key, start, size) with seq, taken from in_pieces() of the same size over a join."""
    own = pieces.select("chrom", "piece", F.col("text").cast("binary").alias("_text"))
    wanted = ranges.withColumn("piece", F.explode(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {piece}, (start + size - 1) div {piece}) END")))
    found = wanted.join(own, ["chrom", "piece"]).withColumn("low", F.greatest(F.col("start") - F.col("piece") * piece, F.lit(0)))
    part = F.substr("_text", (F.col("low") + 1).cast("int"), (F.least(F.col("start") + F.col("size") - F.col("piece") * piece, F.lit(piece)) - F.col("low")).cast("int")).cast("string")
    joined = found.withColumn("s", part).groupBy("chrom", *key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"]), "").alias("seq"))
    return ranges.join(joined, ["chrom", *key], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def merge(contigs: DataFrame, variants: DataFrame, encoding: str = DEFAULT_ENCODING) -> SequenceGraph:
    """The bubble graph of contigs, see in_pieces(), and normalised variants (row_id, chrom, pos, ref, alts).

    Along each chromosome: a reference node for every gap between kept variants and for the tail; for each variant a
    reference node of its bases as the contig has them (empty for an insertion) and a non-reference node for each alt
    (empty for a deletion). Every node of a site follows the node before it, or, side by side, every node of the site
    before. Ids and reference indices count on over the chromosomes in order. Variants beyond the contig's end are left
    out, and so are those of chromosomes without a contig.
    """
    pieces = cut(in_pieces(contigs), "pieces")
    sizes = pieces.where("piece = 0").select("chrom", "n")
    kept = kept_variants(variants.join(sizes, "chrom").where("pos >= 0 AND pos + length(ref) <= n").select(variants.columns))
    sites = cut(running(kept, "chrom", ["pos", "row_id"], prev=("max", "pos + length(ref)"), site=("sum", "1")).withColumn("prev", F.coalesce("prev", F.lit(0).cast("long"))), "sites")
    # rows in order of (chrom, site, part): the gap before a site is part 0, its reference allele 1, its alts from 2 on
    gaps = sites.where("pos > prev").select("chrom", "site", F.lit(0).alias("part"), F.col("prev").alias("start"), (F.col("pos") - F.col("prev")).alias("size"))
    refs = sites.select("chrom", "site", F.lit(1).alias("part"), F.col("pos").alias("start"), F.length("ref").cast("long").alias("size"))
    ends = sizes.join(sites.groupBy("chrom").agg(F.max("site").alias("site"), F.max(F.col("pos") + F.length("ref")).alias("start")), "chrom", "left")
    tails = ends.select("chrom", (F.coalesce("site", F.lit(0)) + 1).alias("site"), F.lit(0).alias("part"), F.coalesce("start", F.lit(0).cast("long")).alias("start"), "n")
    tails = tails.withColumn("size", F.col("n") - F.col("start")).where("size > 0").drop("n")
    reference = cut_ranges(pieces, gaps.unionByName(refs).unionByName(tails), ["site", "part"]).select("chrom", "site", "part", "seq", F.lit(True).alias("is_ref"))
    alts = sites.select("chrom", "site", F.posexplode("alts").alias("i", "seq")).select("chrom", "site", (F.col("i") + 2).alias("part"), "seq", F.lit(False).alias("is_ref"))
    rows = number_rows(reference.unionByName(alts), "node_id", "chrom", "site", "part")
    rows = cut(running(rows, None, ["node_id"], refs=("sum", "int(is_ref)")).withColumn("ref_index", F.expr("CASE WHEN is_ref THEN refs - 1 END")), "nodes")
    # a step is a gap by itself (even) or all nodes of a site (odd); it is followed by the next number, or, after a site
    # without a gap behind it, by the one after that
    steps = rows.select("chrom", "node_id", (F.col("site") * 2 + F.when(F.col("part") > 0, 1).otherwise(0)).alias("step"))
    gap = steps.where("step % 2 = 0").select("chrom", (F.col("step") - 1).alias("step"), F.lit(True).alias("gap"))
    onward = steps.join(gap, ["chrom", "step"], "left").select("chrom", F.col("node_id").alias("src"), F.expr("step + CASE WHEN step % 2 = 0 OR gap THEN 1 ELSE 2 END").alias("step"))
    edges = onward.join(steps.select("chrom", F.col("node_id").alias("dst"), "step"), ["chrom", "step"])
    edges = edges.withColumn("out_ord", (F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1).cast("int"))
    nodes = rows.select("node_id", "seq", F.length("seq").alias("length"), "is_ref", F.col("ref_index").cast("long").alias("ref_index"))
    return SequenceGraph(nodes, with_in_order(edges.select("src", "dst", "out_ord")), encoding)


def from_fasta_vcf(spark: SparkSession, fasta: str, vcf: str, chromosome: int = ALL, encoding: str = DEFAULT_ENCODING) -> SequenceGraph:
    """The bubble graph of a FASTA and a VCF file, of one chromosome or all."""
    return merge(read_fasta(spark, fasta, chromosome), read_vcf(spark, vcf, chromosome), encoding)
