"""FASTA text: contigs by the integer their header begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.plans.lineage import cut
from kmerloom.plans.numbering import running
from kmerloom.sources.indexed import indexed_lines
from kmerloom.sources.lines import read_lines
from kmerloom.sources.vcf import ALL, chromosome_number

#: Bases in a piece of a contig.
PIECE = 1 << 16


def _owned(lines: DataFrame) -> DataFrame:
    """(value, line_no, contig, head): each line with the header it stands below; lines before the first belong to none."""
    at = lines.select("value", "line_no", F.expr("CASE WHEN value LIKE '>%' THEN line_no END").alias("head"))
    above = running(at, None, ["line_no"], above=("max", "head"))
    return above.withColumn("contig", F.coalesce("head", "above")).where("contig IS NOT NULL").select("value", "line_no", "contig", "head")


def _named(heads: DataFrame) -> DataFrame:
    """(contig, name, chrom) of header lines."""
    return heads.select("contig", F.expr("substring(value, 2)").alias("name")).withColumn("chrom", chromosome_number(F.col("name")))


def contig_pieces(lines: DataFrame, chromosome: int = ALL, piece: int = PIECE) -> DataFrame:
    """(contig, name, chrom, n, piece, text) of FASTA lines (value, line_no): contigs in pieces of so many bases.

    contig is the header's line_no, n the number of bases of the whole contig, piece counts from 0. A sequence keeps its
    A, C, G, T and N in either case and nothing else, so other letters shift what follows. A header without a sequence
    has one empty piece. No row holds more than one piece or one line.
    """
    owned = cut(_owned(lines).withColumn("s", F.when(F.col("head").isNull(), F.regexp_replace("value", "[^ACGTNacgtn]", "")).otherwise("")), "lines")
    heads = _named(owned.where("head IS NOT NULL"))
    heads = heads if chromosome == ALL else heads.where(F.col("chrom") == chromosome)
    placed = running(owned.select("contig", "line_no", "s"), "contig", ["line_no"], until=("sum", "length(s)"))
    each = placed.where("length(s) > 0").withColumn("start", F.col("until") - F.length("s"))
    parts = each.select("contig", "start", "s", F.explode(F.expr(f"sequence(start div {piece}, (until - 1) div {piece})")).alias("piece"))
    low = F.greatest(F.col("piece") * piece - F.col("start"), F.lit(0))
    high = F.least((F.col("piece") + 1) * piece - F.col("start"), F.length("s"))
    parts = parts.select("contig", "piece", F.struct("start", F.substr("s", (low + 1).cast("int"), (high - low).cast("int")).alias("s")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "")
    whole = parts.groupBy("contig", "piece").agg(text.alias("text"))
    sizes = placed.groupBy("contig").agg(F.max("until").alias("n"))
    out = heads.join(sizes, "contig").join(whole, "contig", "left")
    return out.select("contig", "name", "chrom", F.col("n").cast("long").alias("n"), F.coalesce("piece", F.lit(0).cast("long")).alias("piece"), F.coalesce("text", F.lit("")).alias("text"))


def contigs(lines: DataFrame, chromosome: int = ALL) -> DataFrame:
    """(contig, name, chrom, seq): contig_pieces() put together, for contigs that fit into a row."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "")
    return contig_pieces(lines, chromosome).groupBy("contig", "name", "chrom").agg(text.alias("seq"))


def read_fasta(spark: SparkSession, path: str, chromosome: int = ALL, index: str | None = None) -> DataFrame:
    """contig_pieces() of a file. With its stored line index only the chromosome's byte ranges are read."""
    if index is None:
        return contig_pieces(read_lines(spark, path), chromosome)
    return contig_pieces(indexed_lines(spark, index, *([] if chromosome == ALL else [chromosome])), chromosome)
