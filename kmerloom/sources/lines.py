"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.plans.numbering import number_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a text file, or of several in the order of their names; line_no counts from 0 over all."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return number_rows(raw.withColumn("_id", F.monotonically_increasing_id()), "line_no", "_file", "_block", "_id").select("value", "line_no")
