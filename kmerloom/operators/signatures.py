"""Variant signatures: the rarest k-mer windows that tell two nodes apart, for all pairs in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.frequency import asked_counts, walk_counts, with_frequency
from kmerloom.operators.occurrences import MAX_STEPS, Walk, behind, kmers_over, paths_over, sides, stretches_of, walk
from kmerloom.operators.superkmers import LEAST_K, MOST_BITS
from kmerloom.plans.lineage import cut, scratch
from kmerloom.plans.model import SequenceGraph

#: Bits of a filter for each k-mer that it is asked for, below which it lets too much through.
LEAST_BITS_EACH = 4


def _back_paths(graph: SequenceGraph, k: int, starts: DataFrame, only_starts: bool, max_steps: int, packed: bool = True) -> DataFrame:
    """(centre, start_node, back_key) of the starts that paths backwards from their centre reach: the least array of negated
    in-list places over these paths. only_starts: a path goes on from starts of its centre and empty nodes only.

    While all places of the longest path fit one number, back_key is that number, in the same order: the first place in its
    highest bits, none as 0, and the least of many is found without sorting them. Otherwise it is the array.
    """
    size = graph.nodes.select(F.col("node_id").alias("src"), "length")
    back = cut(graph.edges.select("src", F.col("dst").alias("node_id"), "in_ord").join(size, "src"), "edges")
    bits = ((back.agg(F.coalesce(F.max("in_ord"), F.lit(0))).first()[0] + 2) - 1).bit_length()  # places from 1 on, as 0 is none
    own = starts.select("centre", F.col("start_node").alias("node_id"), F.lit(True).alias("own"))
    none = F.lit(0).cast("long") if packed else F.expr("cast(array() as array<int>)")
    front = starts.select("centre").distinct().select("centre", F.col("centre").alias("node_id"), F.lit(0).alias("used"), none.alias("back_key"))
    front, found = cut(front.join(own, ["centre", "node_id"], "left")), []
    for i in range(max_steps):
        if packed and (i + 1) * bits > 63:
            return _back_paths(graph, k, starts, only_starts, max_steps, packed=False)
        found.append(front.where("own").select("centre", "node_id", "back_key"))
        step = front.where(f"used <= {k - 2}").select("centre", "node_id", "used", "back_key").join(back, "node_id")
        longer = F.expr(f"back_key + shiftleft({(1 << bits) - 1}L - in_ord, {63 - (i + 1) * bits})") if packed else F.array_append("back_key", -F.col("in_ord"))
        step = step.select("centre", F.col("src").alias("node_id"), (F.col("used") + F.col("length")).alias("used"), longer.alias("back_key"), "length")
        step = step.join(own, ["centre", "node_id"], "left").where("length = 0 OR own" if only_starts else "true")
        front = cut(step.groupBy("centre", "node_id", "used", "own").agg(F.min("back_key").alias("back_key")))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("centre", F.col("node_id").alias("start_node")).agg(F.min("back_key").alias("back_key"))
    raise RuntimeError(f"the search backwards still grows after {max_steps} steps")


def back_keys(graph: SequenceGraph, k: int, starts: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """(centre, start_node, late, back_key): where a start node comes in the order of discovery.

    starts: centre, start_node of nodes that start an occurrence over the centre. back_key is the least array of negated
    in-list places over paths from the centre backwards whose inner nodes are empty or starts themselves. Starts that no
    such path reaches, as happens near a node without out-edges, come after all others (late), by the least array over
    all paths.
    """
    starts = cut(starts.select("centre", "start_node").distinct())
    found = cut(_back_paths(graph, k, starts, True, max_steps))
    missed = cut(starts.join(found, ["centre", "start_node"], "left_anti"))
    out = found.select("centre", "start_node", F.lit(False).alias("late"), "back_key")
    if missed.isEmpty():
        return out
    rest = _back_paths(graph, k, missed, False, max_steps)
    if dict(rest.dtypes)["back_key"] != dict(out.dtypes)["back_key"]:  # both as arrays, if one is
        out, rest = (x if "array" in dict(x.dtypes)["back_key"] else None for x in (out, rest))
        out = out if out is not None else _back_paths(graph, k, starts, True, max_steps, packed=False).withColumn("late", F.lit(False))
        rest = rest if rest is not None else _back_paths(graph, k, missed, False, max_steps, packed=False)
    return out.unionByName(rest.select("centre", "start_node", F.lit(True).alias("late"), "back_key"))


def _window_counts(walked: Walk, paths: DataFrame) -> DataFrame:
    """(kmer, frequency) of a walk's occurrences, for all k-mers of paths (see paths_over()) and perhaps some others.

    All are counted where the paths ask for a good part of them, or for more than a filter can tell apart.
    """
    k = walked.k
    if k < LEAST_K:
        return walk_counts(walked)
    size = F.coalesce(F.sum(F.length("seq").cast("long") - (k - 1)), F.lit(0))
    asked, there = (rows.where(f"length(seq) >= {k}").agg(size).first()[0] for rows in (paths, stretches_of(walked)))
    if asked * LEAST_BITS_EACH > MOST_BITS or asked * 4 > there:
        return walk_counts(walked)
    return asked_counts(walked, kmers_over(paths, k, walked.graph.encoding))


def kmer_windows(graph: SequenceGraph, k: int, pairs: DataFrame, frequencies: DataFrame | None, max_variant_nodes: int = 255, walked: Walk | None = None) -> DataFrame:
    """(pair_id, side, node_id, window, start_position, kmer_position, kmers, max_frequency) of both nodes of each pair.

    K-mers over a node that lie alike on it form a window. kmers keeps repeats, in order of discovery; window counts the
    windows of a side from 0 in the order of their first k-mer; max_frequency is the greatest of its k-mers. walked: the walk
    over the whole graph under the same k and limit, where it is at hand; without frequencies the k-mers of the windows,
    and only they, are counted along it.

    Paths over a node are ranked in the order of discovery before their k-mers are listed, so a k-mer carries numbers only.
    """
    wanted = sides(pairs)
    centres = wanted.select("centre")
    own = walked
    if own is None:
        own = walk(graph, k, max_variant_nodes, behind(graph, centres, k).select("node_id"))
    paths = cut(paths_over(own, centres), "over")
    if frequencies is None:
        counted = own if walked is not None else walk(graph, k, max_variant_nodes, paths=False)
        frequencies = _window_counts(counted, paths)
    if k < LEAST_K:
        frequencies = cut(frequencies, "counts")  # few and known to be few: k-mers need not move to meet them
    keyed = paths.join(back_keys(graph, k, paths.select("centre", "start_node")), ["centre", "start_node"])
    # one rank for all rows of a path, which a long node has several of. A centre's rows are dealt for it, and stay together
    # until they are windows
    ranked = keyed.withColumn("rank", F.dense_rank().over(W.partitionBy("centre").orderBy("late", "back_key", "ords")))
    listed = kmers_over(ranked.select("centre", "rank", "off", "first", "seq"), k, graph.encoding)
    listed = listed.withColumn("place", F.expr("shiftleft(cast(rank AS long), 32) + p")).drop("rank", "p")
    grouped = listed.groupBy("centre", "start_position", "kmer_position").agg(F.sort_array(F.collect_list(F.struct("place", "kmer"))).alias("own"))
    windows = grouped.select("centre", "start_position", "kmer_position", F.col("own.kmer").alias("kmers"), F.expr("own[0].place").alias("first"))
    at = F.row_number().over(W.partitionBy("centre").orderBy("first")) - 1
    lead = F.row_number().over(W.partitionBy("centre").orderBy("pair_id", "side")) == 1
    windows = windows.withColumn("window", at).join(wanted.withColumn("lead", lead), "centre")
    windows = cut(windows.select("pair_id", "side", F.col("centre").alias("node_id"), "window", "start_position", "kmer_position", "kmers", "lead"), "listed")
    # narrow rows meet the frequencies, once for a node that is in many pairs
    asked = windows.where("lead").select("node_id", "window", F.explode(F.array_distinct("kmers")).alias("kmer"))
    most = with_frequency(asked, frequencies).groupBy("node_id", "window").agg(F.max("frequency").alias("max_frequency"))
    return windows.join(cut(most, "most"), ["node_id", "window"]).select("pair_id", "side", "node_id", "window", "start_position", "kmer_position", "kmers", "max_frequency")


def window_pairs(graph: SequenceGraph, k: int, windows: DataFrame) -> DataFrame:
    """(pair_id, ref_window, var_window, reference_kmers, variant_kmers, max_frequency, hypotenuse_frequency).

    A reference and a variant window pair up if as many bases stand left of the node in both, or right of it. Windows are
    dealt by pair, and what is made of a pair's windows stays with them.
    """
    own = windows.select("pair_id", "node_id").distinct().join(graph.nodes.select("node_id", "length"), "node_id")
    lengths = own.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "length"))).alias("lengths"))
    sized = windows.repartition("pair_id").join(lengths, "pair_id").withColumn("length", F.expr("lengths[node_id]")).withColumns({"left": F.expr("kmer_position - start_position"), "right": F.expr(f"{k} + start_position - length - kmer_position")})
    at = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("at")) for c in ("left", "right"))))
    each = sized.select("pair_id", "side", at.alias("x"), F.struct("window", "left", "kmers", "max_frequency").alias("own"))
    # windows meet where they align, not all of a pair; those alike on both ends once
    met = each.groupBy("pair_id", "x.kind", "x.at").agg(*(F.collect_list(F.when(F.col("side") == c, F.col("own"))).alias(c) for c in ("ref", "var")))
    both = met.select("pair_id", "kind", F.explode("ref").alias("ref"), "var").select("pair_id", "kind", "ref", F.explode("var").alias("var")).where("kind = 'left' OR ref.left <> var.left")
    return both.select(
        "pair_id",
        F.col("ref.window").alias("ref_window"),
        F.col("var.window").alias("var_window"),
        F.col("ref.kmers").alias("reference_kmers"),
        F.col("var.kmers").alias("variant_kmers"),
        (F.col("ref.max_frequency") + F.col("var.max_frequency")).alias("max_frequency"),
        F.hypot("ref.max_frequency", "var.max_frequency").alias("hypotenuse_frequency"),
    )


def _shared(rows: DataFrame, keys: list[str], items) -> DataFrame:
    """rows, which keys tell apart and of which pair_id is one, with shared: for each of its items (side, kmer) how many
    items of the pair's other side have that k-mer, added up.

    Only one item of a row carries its columns along; where rows are dealt by pair, nothing is moved.
    """
    listed = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("row"), F.posexplode(items).alias("i", "item"))
    listed = listed.select(*keys, F.when(F.col("i") == 0, F.col("row")).alias("row"), "item.*")
    here = W.partitionBy("pair_id", "kmer")
    of = {x: F.count(F.when(F.col("side") == x, 1)).over(here) for x in ("ref", "var")}
    met = listed.withColumn("n", F.when(F.col("side") == "ref", of["var"]).otherwise(of["ref"]))
    return met.groupBy(*keys).agg(F.first("row", ignorenulls=True).alias("row"), F.sum("n").alias("shared")).select(*keys, "row.*", "shared")


def with_pair_overlap(aligned: DataFrame) -> DataFrame:
    """aligned with overlap: equal k-mers of its reference side and other window pairs' variant sides, and the reverse."""
    inside = F.expr("CASE WHEN arrays_overlap(reference_kmers, variant_kmers) THEN aggregate(reference_kmers, 0L, (s, a) -> s + size(filter(variant_kmers, b -> b = a))) ELSE 0L END")
    items = F.expr("concat(transform(reference_kmers, x -> struct('ref' AS side, x AS kmer)), transform(variant_kmers, x -> struct('var' AS side, x AS kmer)))")
    return _shared(aligned, ["pair_id", "ref_window", "var_window"], items).withColumn("overlap", F.col("shared") - 2 * inside).select(*aligned.columns, "overlap")


def aligned_signatures(aligned: DataFrame, minimize_overlaps: bool = False) -> DataFrame:
    """The window pair of each pair_id of least (overlap if asked for, hypotenuse frequency, order)."""
    scored = with_pair_overlap(aligned) if minimize_overlaps else aligned.withColumn("overlap", F.lit(0).cast("long"))
    best = F.min_by(F.struct("reference_kmers", "variant_kmers", "max_frequency", "hypotenuse_frequency"), F.struct("overlap", "hypotenuse_frequency", "ref_window", "var_window"))
    return scored.groupBy("pair_id").agg(best.alias("s")).select("pair_id", "s.*")


def unaligned_signatures(windows: DataFrame, minimize_overlaps: bool = False) -> DataFrame:
    """For each side of a pair_id by itself the window of least (overlap with the other side's, frequency, order)."""
    own = windows.select("pair_id", "side", "node_id", "window", "kmers", "max_frequency").repartition("pair_id")
    if minimize_overlaps:
        items = F.expr("transform(kmers, x -> struct(side AS side, x AS kmer))")
        own = _shared(own.withColumn("of", F.col("side")), ["pair_id", "of", "node_id", "window"], items).withColumnRenamed("shared", "overlap")
    else:
        own = own.withColumn("overlap", F.lit(0).cast("long"))
    order = F.struct("overlap", "max_frequency", "window")
    best = [F.min_by(F.struct("kmers", "max_frequency"), F.when(F.col("side") == name, order)).alias(alias) for name, alias in (("ref", "reference"), ("var", "variant"))]
    both = own.groupBy("pair_id").agg(*best)
    return both.select(
        "pair_id",
        F.col("reference.kmers").alias("reference_kmers"),
        F.col("variant.kmers").alias("variant_kmers"),
        F.expr("reference.max_frequency + variant.max_frequency").alias("max_frequency"),
        F.hypot("reference.max_frequency", "variant.max_frequency").alias("hypotenuse_frequency"),
    )


def find_variant_signatures(
    graph: SequenceGraph,
    k: int,
    pairs: DataFrame,
    frequencies: DataFrame | None,
    max_variant_nodes: int = 255,
    minimize_overlaps: bool = False,
    align_windows: bool = False,
    reverse: bool = False,
    walked: Walk | None = None,
) -> DataFrame:
    """(pair_id, reference_kmers, variant_kmers, max_frequency, hypotenuse_frequency), one row for each pair.

    pairs: pair_id, ref_node, var_node. frequencies: see frequency_table(); None for those of the graph. A pair without windows, or without an aligned
    pair of them, keeps its row with empty arrays and null scores. reverse: the k-mers found are hashed in reverse order.
    walked: see kmer_windows().
    """
    spark = graph.spark
    with scratch(spark):
        with scratch(spark):
            if frequencies is None and walked is None:
                walked = walk(graph, k, max_variant_nodes)  # one walk for the windows and their counts
            windows = cut(kmer_windows(graph, k, pairs, frequencies, max_variant_nodes, walked), "windows", keep=True)
        best = aligned_signatures(window_pairs(graph, k, windows), minimize_overlaps) if align_windows else unaligned_signatures(windows, minimize_overlaps)
        best = cut(best, "best", keep=True)
    out = pairs.select("pair_id").join(best, "pair_id", "left")
    for side in ("reference_kmers", "variant_kmers"):
        own = F.coalesce(F.col(side), F.expr("cast(array() as array<bigint>)"))
        out = out.withColumn(side, F.transform(own, lambda x: K.reverse_hash(x, k)) if reverse else own)
    return out
