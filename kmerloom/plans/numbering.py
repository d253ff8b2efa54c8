"""Numbers and running values in an order, without sending all rows, or all rows of a key, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.plans.lineage import cut


def _placed(df: DataFrame, *order: str | Column) -> DataFrame:
    """df range-sorted over partitions, written, with the number of its partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def number_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a column that counts its rows from 0 in the given order, which must be without ties.

    Rows are range-sorted over partitions and counted in each; what joins back is one offset a partition.
    """
    placed = _placed(df, *order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    local = placed.withColumn("_i", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_part", "_before", "_i")


def running(df: DataFrame, key: str | None, order: list[str], **values: tuple[str, str]) -> DataFrame:
    """df with columns of running values in an order without ties, within each key (None: over all rows).

    values: name=(kind, SQL): kind sum adds up to and with the row itself, max is the greatest of the rows before (null
    for the first). Rows are range-sorted by (key, order), so a key with most of the rows spreads over many tasks; every
    partition hands on one row for each key it holds.
    """
    group = ["_key"]
    keyed = df.withColumn("_key", F.lit(0) if key is None else F.col(key))
    placed = _placed(keyed.withColumns({f"_{n}": F.expr(e) for n, (_, e) in values.items()}), "_key", *order)
    own = W.partitionBy("_part", "_key").orderBy(*order)
    past = own.rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns({f"_l_{n}": F.sum(f"_{n}").over(own.rowsBetween(W.unboundedPreceding, 0)) if kind == "sum" else F.max(f"_{n}").over(past) for n, (kind, _) in values.items()})
    totals = placed.groupBy("_part", *group).agg(*(getattr(F, kind)(f"_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()))
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of a key
    carried = totals.select("_part", *group, *(getattr(F, kind)(f"_t_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in values.items()))
    out = local.join(carried, ["_part", *group])
    for n, (kind, _) in values.items():
        mine, handed = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        out = out.withColumn(n, mine + F.coalesce(handed, F.lit(0)) if kind == "sum" else F.greatest(mine, handed))
    return out.select(*df.columns, *values)
