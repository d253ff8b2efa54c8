"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C


#: Parts that the links of one node are dealt into where they join its least neighbour; Spark splits larger ones further.
PARTS = 4


def _salted(links: DataFrame, least: DataFrame) -> DataFrame:
    """links with the row of least for their a, dealt by a and a part of b, so that no task has all links of a node."""
    own = links.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    return own.join(least.withColumn("part", F.explode(F.array(*(F.lit(i).cast("long") for i in range(PARTS))))), ["a", "part"]).drop("part")


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """links: a > b. Hang the larger (small: the smaller) neighbours of each node on the least of its neighbourhood."""
    if small:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = _salted(links, least).select(F.col("b").alias("a"), "m").unionByName(least.select("a", "m"))
    else:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        out = _salted(both, least).where("b > a").select(F.col("b").alias("a"), "m")
    return out.select("a", F.col("m").alias("b")).where("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the least node reachable.

    Links are undirected; loops, repeats and nulls are ignored. Each round is two joins on a node and is written to the
    shared folder, so lineage stays short; rounds grow with the logarithm of the longest path, not with group sizes.
    """
    spark = links.sparkSession
    links = C.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while not links.isEmpty():
        path = links.inputFiles()[0].rsplit("/", 1)[0] if state is not None and links.inputFiles() else None
        after = C.materialize(_stars(_stars(links, False), True), "stars")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if path:
            C.discard(spark, path)
        links = after
        if tuple(new) == state:
            break
        state = tuple(new)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
