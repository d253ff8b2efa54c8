"""GFA 1 text: segments, links and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions.kmers import DEFAULT_ENCODING
from kmerloom.operators.graph import compress as compact
from kmerloom.plans.lineage import cut
from kmerloom.plans.model import SequenceGraph, node_table
from kmerloom.plans.numbering import number_rows
from kmerloom.sources.indexed import indexed_lines
from kmerloom.sources.lines import read_lines


def _field(i: int) -> Column:
    return F.get(F.split(F.col("value"), "\t"), i)


def _records(lines: DataFrame, letter: str) -> DataFrame:
    """The lines of one kind of record."""
    return lines.where(F.col("value").startswith(letter + "\t"))


def segments(lines: DataFrame) -> DataFrame:
    """(line_no, name, seq) of the S lines; names are integers."""
    return _records(lines, "S").select("line_no", _field(1).try_cast("long").alias("name"), F.coalesce(_field(2), F.lit("")).alias("seq"))


def links(lines: DataFrame) -> DataFrame:
    """(line_no, a, b, forward) of the L lines; forward: both ends in forward orientation."""
    own = _records(lines, "L")
    return own.select("line_no", _field(1).try_cast("long").alias("a"), _field(3).try_cast("long").alias("b"), ((_field(2) == "+") & (_field(4) == "+")).alias("forward"))


def path_nodes(lines: DataFrame) -> DataFrame:
    """(name, ref_index): each node of any path, with its place in the last path that holds it (the last place there)."""
    own = _records(lines, "P").select("line_no", F.posexplode(F.regexp_extract_all(_field(2), F.lit("([0-9]+)[+-]"), 1)).alias("at", "name"))
    return own.groupBy(F.col("name").cast("long").alias("name")).agg(F.max_by("at", F.struct("line_no", "at")).cast("long").alias("ref_index"))


def dense_ids(found: DataFrame) -> DataFrame:
    """(name, node_id): names less the least one if they leave no gap, else counted in file order."""
    n, low, high = found.agg(F.count("*"), F.min("name"), F.max("name")).first()
    if n and high - low + 1 == n:
        return found.select("name", (F.col("name") - low).alias("node_id"))
    return number_rows(found.select("name", "line_no"), "node_id", "line_no").select("name", "node_id")


def from_gfa_lines(lines: DataFrame, encoding: str = DEFAULT_ENCODING, compress: bool = True) -> SequenceGraph:
    """A graph from GFA lines (value, line_no); nodes of paths are reference. compress joins chains into one node.

    Lines of other kinds are skipped. ValueError for links that are not forward at both ends, for names that are no
    integers or repeat, and for links or paths to missing segments.
    """
    return _from_records(lines, lines, lines, encoding, compress)


def _from_records(s_lines: DataFrame, l_lines: DataFrame, p_lines: DataFrame, encoding: str, compress: bool) -> SequenceGraph:
    found, joined = cut(segments(s_lines)), cut(links(l_lines))
    if not joined.where("NOT forward OR a IS NULL OR b IS NULL").isEmpty():
        raise ValueError("only links between forward ends of integer names are read")
    if not found.where("name IS NULL").isEmpty() or not found.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("segment names are distinct integers")
    ids, on_path = cut(dense_ids(found)), cut(path_nodes(p_lines))
    if not on_path.join(ids.hint("merge"), "name", "left_anti").isEmpty():
        raise ValueError("a path goes over a missing segment")
    nodes = found.join(ids.hint("merge"), "name").join(on_path.hint("merge"), "name", "left").withColumn("is_ref", F.col("ref_index").isNotNull())
    a, b = ids.select(F.col("name").alias("a"), F.col("node_id").alias("src")), ids.select(F.col("name").alias("b"), F.col("node_id").alias("dst"))
    ends = joined.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    out, into = (F.row_number().over(W.partitionBy(end).orderBy("line_no")) - 1 for end in ("src", "dst"))
    edges = ends.select("src", "dst", out.cast("int").alias("out_ord"), into.cast("int").alias("in_ord"))
    if edges.count() != joined.count():
        raise ValueError("a link to a missing segment")
    graph = SequenceGraph(node_table(nodes, F.col("ref_index")), edges, encoding).validate()
    return compact(graph) if compress else graph


def from_gfa(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING, compress: bool = True, index: str | None = None) -> SequenceGraph:
    """from_gfa_lines() of a file. With its stored line index each kind of record is read from its own byte ranges."""
    if index is None:
        return from_gfa_lines(read_lines(spark, path), encoding, compress)
    return _from_records(*(indexed_lines(spark, index, ord(x)) for x in "SLP"), encoding, compress)
