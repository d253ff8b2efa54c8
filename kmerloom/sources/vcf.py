"""VCF text: normalised small variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.indexed import indexed_lines
from kmerloom.sources.lines import read_lines

#: Every chromosome, each by itself.
ALL = -1


def chromosome_number(name: Column) -> Column:
    """The integer a chromosome's name begins with, after an optional chr; 0 if there is none."""
    own = F.regexp_extract(name, "^(?i:chr)?([0-9]+)", 1)
    return F.when(own == "", 0).otherwise(own.cast("int"))


def _once(value: Column) -> Column:
    """A generator of one row with the value. What later columns make of it reads it; they would else work it out each by itself,
    and inside a lambda for each element."""
    return F.explode(F.array(value))


def is_structural(allele: Column) -> Column:
    """Whether an allele column holds more than bases and commas; one that begins with a point does not count as such."""
    return ~(allele.startswith(".") | allele.rlike("^[ACGTNacgtn,]*$"))


def records(lines: DataFrame, chromosome: int = ALL) -> DataFrame:
    """(row_id, chrom, pos, ref, alt) of the variant lines as written, of one chromosome or all; pos counts from 1.

    Lines with fewer than five columns, or whose position is no integer, are left out.
    """
    own = [F.get("own", F.lit(i)) for i in range(5)]
    rows = lines.where("value NOT LIKE '#%' AND value <> ''").select("line_no", _once(F.split("value", "\t")).alias("own")).select(
        F.col("line_no").alias("row_id"), chromosome_number(own[0]).alias("chrom"), own[1].try_cast("long").alias("pos"), own[3].alias("ref"), own[4].alias("alt")
    ).where("pos IS NOT NULL AND alt IS NOT NULL")
    return rows if chromosome == ALL else rows.where(F.col("chrom") == chromosome)


def small_variants(rows: DataFrame) -> DataFrame:
    """rows without structural variants."""
    return rows.where(~is_structural(F.col("ref")) & ~is_structural(F.col("alt")))


def normalised(rows: DataFrame) -> DataFrame:
    """(row_id, chrom, pos, ref, alts): the prefix common to ref and every alt cut off, pos moved on and counted from 0.

    A point stands for an empty allele. Prefixes are compared by case.
    """
    split = rows.select("row_id", "chrom", "pos", _once(F.struct("ref", F.split("alt", ",").alias("alts"))).alias("x")).select("row_id", "chrom", "pos", "x.*")
    same = F.expr("size(filter(CASE WHEN length(ref) > 0 THEN sequence(1, length(ref)) ELSE array() END, i -> forall(alts, a -> left(a, i) = left(ref, i))))")
    cutoff = split.select("*", _once(same).alias("n"))
    bare = lambda x: F.when(x == ".", "").otherwise(x)
    return cutoff.select(
        "row_id", "chrom", (F.col("pos") + F.col("n") - 1).alias("pos"), bare(F.expr("substring(ref, n + 1)")).alias("ref"), F.transform(F.expr("transform(alts, a -> substring(a, n + 1))"), bare).alias("alts")
    )


def from_vcf_lines(lines: DataFrame, chromosome: int = ALL) -> DataFrame:
    return normalised(small_variants(records(lines, chromosome)))


def read_vcf(spark: SparkSession, path: str, chromosome: int = ALL, index: str | None = None) -> DataFrame:
    """Normalised small variants of a VCF file. With its stored line index only byte ranges that may hold the chromosome
    are read."""
    if index is None:
        return from_vcf_lines(read_lines(spark, path), chromosome)
    return from_vcf_lines(indexed_lines(spark, index, *([] if chromosome == ALL else [chromosome])), chromosome)
