"""Lookups and clean-up of sequence graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph, with_in_order
from kmerloom.plans.numbering import number_rows


def degrees(graph: SequenceGraph) -> DataFrame:
    """(node_id, out_degree, in_degree) of every node."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    none = graph.nodes.select("node_id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return none.unionByName(ends).groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def add_in_edges(graph: SequenceGraph) -> SequenceGraph:
    """The graph with in-lists in the order of ascending source, then of the source's out-list."""
    return graph.with_tables(graph.nodes, with_in_order(graph.edges))


def get_node(graph: SequenceGraph, node_id: int) -> DataFrame:
    """The node's row; none if there is no such node."""
    return graph.nodes.where(F.col("node_id") == node_id)


def get_nodes(graph: SequenceGraph, ids: DataFrame) -> DataFrame:
    """The rows of the nodes that a table (node_id) lists, each once."""
    return graph.nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def base_codes(nodes: DataFrame, i: int | Column, encoding: str = K.DEFAULT_ENCODING) -> DataFrame:
    """(node_id, code): the code of base i, counted from 0, of each node; null outside the node."""
    return nodes.select("node_id", K.base_code(F.col("seq"), i, encoding).alias("code"))


def node_base(graph: SequenceGraph, node_id: int, i: int) -> DataFrame:
    """(code) of one node's base i."""
    return base_codes(get_node(graph, node_id), i, graph.encoding).select("code")


def describe_nodes(graph: SequenceGraph) -> DataFrame:
    """The nodes with out_nodes and in_nodes, in the order of their lists."""
    out = graph.nodes
    for own, other, place, name in (("src", "dst", "out_ord", "out_nodes"), ("dst", "src", "in_ord", "in_nodes")):
        listed = graph.edges.groupBy(F.col(own).alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), F.col(other).alias("node")))), lambda x: x["node"]).alias(name))
        out = out.join(listed, "node_id", "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<bigint>)")))
    return out


def describe_node(graph: SequenceGraph, node_id: int) -> DataFrame:
    """One node's row of describe_nodes()."""
    near = graph.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    return describe_nodes(graph.with_tables(get_node(graph, node_id), near))


def root_node(graph: SequenceGraph) -> DataFrame:
    """(node_id): the least node that no edge leads to; null if there is none."""
    return graph.nodes.join(graph.edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti").agg(F.min("node_id").alias("node_id"))


def last_node(graph: SequenceGraph) -> DataFrame:
    """(node_id): the least node that no edge leaves; null if there is none."""
    return graph.nodes.join(graph.edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").agg(F.min("node_id").alias("node_id"))


def reference_node(graph: SequenceGraph, ref_index: int) -> DataFrame:
    """(node_id) of the reference node of that index."""
    return graph.nodes.where(F.col("is_ref") & (F.col("ref_index") == ref_index)).select("node_id")


def next_reference(graph: SequenceGraph) -> DataFrame:
    """(node_id, next_id): for each reference node its neighbour that is a reference node of the following index."""
    ref = graph.nodes.where("is_ref AND ref_index IS NOT NULL")
    a, b = (ref.select(F.col("node_id").alias(n), F.col("ref_index").alias(i)) for n, i in (("src", "at"), ("dst", "then")))
    return graph.edges.join(a, "src").join(b, "dst").where("then = at + 1").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("next_id"))


def has_edge(graph: SequenceGraph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with found: whether an edge leads from a to b."""
    there = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("found")).distinct()
    return pairs.join(there, ["a", "b"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def has_parent(graph: SequenceGraph) -> DataFrame:
    """(node_id, found): whether any edge leads to the node."""
    there = graph.edges.select(F.col("dst").alias("node_id"), F.lit(True).alias("found")).distinct()
    return graph.nodes.select("node_id").join(there, "node_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def required_empty_nodes(graph: SequenceGraph) -> DataFrame:
    """(node_id, n): of each node with edges, the out-neighbours that more than one edge leads to."""
    wide = graph.edges.groupBy("dst").agg((F.count("*") > 1).cast("long").alias("wide"))
    return graph.edges.join(wide, "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum("wide").alias("n"))


def _ends(edges: DataFrame) -> DataFrame:
    """(node, ins, outs) of the nodes of an edge table."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("ins"), F.sum("x.o").alias("outs"))


def contracted(graph: SequenceGraph, root: int, last: int) -> DataFrame:
    """(src, dst, low, high): the graph with runs of single nodes and side-by-side edges drawn together; low and high are the
    fewest and most edges of the paths that an edge stands for.

    Each round drops nodes that nothing leads to (but the root) and that lead nowhere (but the last), takes out nodes with
    one edge in and one out, no two in a row, chosen by hash, and keeps one edge for each pair of ends. So a graph of
    bubbles shrinks by a constant share a round, and the rows of all rounds are linear in its edges. It ends when a round
    takes little off. Cycles become edges from a node to itself.
    """
    kept = [root, last]
    edges = cut(graph.edges.select("src", "dst").distinct().select("*", F.lit(1).cast("long").alias("low"), F.lit(1).cast("long").alias("high")), "edges")
    size = edges.count()
    for turn in range(64):
        ends = _ends(edges).where(~F.col("node").isin(kept))
        dead = ends.where("ins = 0 OR outs = 0").select("node")
        live = edges.join(dead.select(F.col("node").alias("src")), "src", "left_anti").join(dead.select(F.col("node").alias("dst")), "dst", "left_anti")
        single = ends.where("ins = 1 AND outs = 1").select("node").where(F.xxhash64("node", F.lit(turn)) % 2 == 0)
        into = live.join(single.select(F.col("node").alias("dst")), "dst", "left_semi")
        # not where the node before is taken out as well, or the node is its own
        into = into.where("src <> dst").join(single.select(F.col("node").alias("src")), "src", "left_anti")
        taken = cut(into.select(F.col("src").alias("a"), F.col("dst").alias("mid"), F.col("low").alias("l1"), F.col("high").alias("h1")), "taken")
        onward = live.join(taken, live["src"] == taken["mid"]).select(F.col("a").alias("src"), "dst", (F.col("low") + F.col("l1")).alias("low"), (F.col("high") + F.col("h1")).alias("high"))
        gone = taken.select("mid").distinct()
        rest = live.join(gone.select(F.col("mid").alias("src")), "src", "left_anti").join(gone.select(F.col("mid").alias("dst")), "dst", "left_anti")
        both = rest.select("src", "dst", "low", "high").unionByName(onward)
        edges = cut(both.groupBy("src", "dst").agg(F.min("low").alias("low"), F.max("high").alias("high")), "edges")
        before, size = size, edges.count()
        if size * 20 > before * 19 or size < 8:
            break
    return edges


def required_empty_node_count(graph: SequenceGraph) -> int:
    """By how many edges the longest path from the root to the last node exceeds the shortest.

    What contracted() leaves is walked from the root, then peeled: a node is settled once all that lead to it are. Both
    take as many rounds as the longest path of the contracted graph. ValueError on a cycle that the root reaches; 0 if
    there is no root or no last node, or no path.
    """
    root, last = root_node(graph).first()[0], last_node(graph).first()[0]
    if root is None or last is None or root == last:
        return 0
    edges = contracted(graph, root, last)
    reached = front = cut(edges.where(F.col("src") == root).select(F.lit(root).cast("long").alias("node")).distinct())
    while not front.isEmpty():
        new = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(reached, "node", "left_anti"))
        reached = cut(reached.unionByName(front))
    open_edges = cut(edges.join(reached.select(F.col("node").alias("src")), "src", "left_semi"), "edges")
    settled = cut(graph.spark.createDataFrame([(root, 0, 0)], "node long, low long, high long"))
    found = 0
    while not settled.isEmpty():
        end = settled.where(F.col("node") == last).first()
        found = end["high"] - end["low"] if end else found
        here = settled.select(F.col("node").alias("src"), F.col("low").alias("l"), F.col("high").alias("h"))
        # edges from settled nodes carry their sums on; a target is settled when no other edge leads to it
        moved = open_edges.join(here, "src", "left").withColumns({"low": F.col("low") + F.coalesce("l", F.lit(0)), "high": F.col("high") + F.coalesce("h", F.lit(0)), "src": F.when(F.col("l").isNull(), F.col("src"))})
        moved = moved.groupBy("src", "dst").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        moved = cut(moved, "edges")
        waiting = moved.where("src IS NOT NULL").select("dst").distinct()
        settled = cut(moved.where("src IS NULL").join(waiting, "dst", "left_anti").select(F.col("dst").alias("node"), "low", "high"))
        open_edges = moved.join(settled.select(F.col("node").alias("dst")), "dst", "left_anti")
        open_edges = cut(open_edges, "edges")
    if not open_edges.isEmpty():
        raise ValueError("the graph has a cycle")
    return found


def chain_map(graph: SequenceGraph, reference: bool = False) -> DataFrame:
    """(node_id, head, place, new_id): the chain each node belongs to, and its place there. reference: chains of reference
    nodes only.

    A chain goes on over an edge whose source has no other out-edge and whose target no other in-edge. Heads are found by
    pointer jumping, so rounds grow with the logarithm of the longest chain. new_id counts chains by their head. The
    nodes of a cycle of such edges have no head and stay single. Tables as large as the graph are never broadcast: each goes
    through the driver, and there are several a round.
    """
    degree = degrees(graph)
    one_out, one_in = degree.where("out_degree = 1").select(F.col("node_id").alias("src")), degree.where("in_degree = 1").select(F.col("node_id").alias("dst"))
    links = graph.edges.select("src", "dst").where("src <> dst").join(one_out.hint("merge"), "src").join(one_in.hint("merge"), "dst")
    if reference:
        ref = graph.nodes.where("is_ref")
        links = links.join(ref.select(F.col("node_id").alias("src")).hint("merge"), "src", "left_semi").join(ref.select(F.col("node_id").alias("dst")).hint("merge"), "dst", "left_semi")
    state = graph.nodes.select("node_id").join(links.select(F.col("dst").alias("node_id"), F.col("src").alias("up")).hint("merge"), "node_id", "left")
    state = cut(state.select("node_id", F.coalesce("up", "node_id").alias("up"), F.col("up").isNotNull().cast("long").alias("place")))
    limit = max(1, state.count()).bit_length() + 1
    for _ in range(limit):
        jump = state.select(F.col("node_id").alias("up"), F.col("up").alias("to"), F.col("place").alias("more"))
        after = cut(state.join(jump.hint("merge"), "up").select("node_id", F.col("to").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("to") != F.col("up")).alias("moved")))
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    heads = state.where("node_id = up").select(F.col("node_id").alias("up"), F.lit(True).alias("is_head"))
    state = state.join(heads.hint("merge"), "up", "left").select("node_id", F.when(F.col("is_head"), F.col("up")).otherwise(F.col("node_id")).alias("head"), F.when(F.col("is_head"), F.col("place")).otherwise(0).alias("place"))
    numbers = number_rows(state.where("node_id = head").select("head"), "new_id", "head")
    return cut(state.join(numbers.hint("merge"), "head").select("node_id", "head", "place", "new_id"))


def compress(graph: SequenceGraph) -> SequenceGraph:
    """The graph with every chain as one node: sequences joined, in-edges and reference flag of the first node, out-edges
    of the last. Reference nodes are numbered anew, from 0 in the order of their old index, if they had one."""
    chains = chain_map(graph)
    joined = graph.nodes.join(chains.hint("merge"), "node_id")
    whole = joined.groupBy("new_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "seq"))), lambda x: x["seq"]), "").alias("seq"),
        F.min_by("is_ref", "place").alias("is_ref"),
        F.min_by("ref_index", "place").alias("old"),
    )
    order = number_rows(whole.where("is_ref AND old IS NOT NULL").select("new_id", "old"), "ref_index", "old", "new_id")
    nodes = whole.join(order.select("new_id", "ref_index").hint("merge"), "new_id", "left")
    nodes = nodes.select(F.col("new_id").alias("node_id"), "seq", F.length("seq").alias("length"), "is_ref", "ref_index")
    a = chains.select(F.col("node_id").alias("src"), F.col("head").alias("h1"), F.col("new_id").alias("a"), F.col("place").alias("p1"))
    b = chains.select(F.col("node_id").alias("dst"), F.col("head").alias("h2"), F.col("new_id").alias("b"), F.col("place").alias("p2"))
    outer = graph.edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("NOT (h1 = h2 AND p2 = p1 + 1)")
    return graph.with_tables(nodes, outer.select(F.col("a").alias("src"), F.col("b").alias("dst"), "out_ord", "in_ord"))


def add_empty_nodes(graph: SequenceGraph) -> SequenceGraph:
    """The graph with an empty non-reference node on each edge between reference nodes that skips one index (a deletion).

    New ids follow the greatest id, by source and target; the new node takes the edge's places in both lists.
    """
    ref = graph.nodes.where("is_ref AND ref_index IS NOT NULL")
    a, b = (ref.select(F.col("node_id").alias(n), F.col("ref_index").alias(i)) for n, i in (("src", "at"), ("dst", "then")))
    skipped = cut(graph.edges.join(a, "src").join(b, "dst").where("then = at + 2").select("src", "dst", "out_ord", "in_ord"))
    top = graph.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0]
    new = cut(number_rows(skipped, "i", "src", "dst", "out_ord").withColumn("mid", F.col("i") + top + 1))
    nodes = graph.nodes.unionByName(new.select(F.col("mid").alias("node_id"), F.lit("").alias("seq"), F.lit(0).alias("length"), F.lit(False).alias("is_ref"), F.lit(None).cast("long").alias("ref_index")))
    into = new.select("src", F.col("mid").alias("dst"), "out_ord", F.lit(0).alias("in_ord"))
    onward = new.select(F.col("mid").alias("src"), "dst", F.lit(0).alias("out_ord"), "in_ord")
    return graph.with_tables(nodes, graph.edges.join(skipped, ["src", "dst", "out_ord"], "left_anti").unionByName(into).unionByName(onward))
