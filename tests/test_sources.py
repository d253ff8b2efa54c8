import pytest
from pyspark.sql import functions as F

from kmerloom.operators.graph import add_empty_nodes, compress, describe_node, get_node, node_base, required_empty_node_count, root_node
from kmerloom.sources import fasta, gfa, merge, store, vcf
from kmerloom.sources.literals import GraphBuilder, from_codes, from_lists, from_tables


def lines(spark, text):
    return spark.createDataFrame([(x, i) for i, x in enumerate(text.split("\n"))], "value string, line_no long")


def nodes(graph):
    return [tuple(r) for r in graph.nodes.select("node_id", "seq", "is_ref", "ref_index").orderBy("node_id").collect()]


def edges(graph):
    return sorted((r.src, r.dst) for r in graph.edges.collect())


GFA = "H\tVN:Z:1.0\nS\t10\tACG\nS\t12\tT\nS\t11\t\nL\t10\t+\t12\t+\t0M\nL\t10\t+\t11\t+\t0M\nL\t11\t+\t12\t+\t3M\nP\tx\t10+,11+\t*\nP\ty\t10+,12+\t12M,3M"


def test_gfa(spark):
    graph = gfa.from_gfa_lines(lines(spark, GFA), compress=False)
    assert nodes(graph) == [(0, "ACG", True, 0), (1, "", True, 1), (2, "T", True, 1)]
    assert edges(graph) == [(0, 1), (0, 2), (1, 2)]
    assert {(r.src, r.dst): (r.out_ord, r.in_ord) for r in graph.edges.collect()} == {(0, 2): (0, 0), (0, 1): (1, 0), (1, 2): (0, 1)}
    sparse = gfa.from_gfa_lines(lines(spark, GFA.replace("12", "99")), compress=False)
    assert [n[1] for n in nodes(sparse)] == ["ACG", "T", ""]
    for bad in (GFA.replace("11\t+\t0M", "11\t-\t0M"), GFA + "\nS\t10\tA", GFA + "\nL\t10\t+\t77\t+\t0M", GFA.replace("P\tx\t10+", "P\tx\t50+"), GFA + "\nS\tx\tA"):
        with pytest.raises(ValueError):
            gfa.from_gfa_lines(lines(spark, bad), compress=False)


def test_gfa_file_and_compaction_over_32_bases(spark, tmp_path):
    text = f"S\t1\t{'ACGT' * 9}\nS\t2\tGATTACA\nS\t3\t\nL\t1\t+\t2\t+\t0M\nL\t2\t+\t3\t+\t0M\nP\tp\t1+,2+,3+\t*\n"
    (tmp_path / "g.gfa").write_text(text)
    assert nodes(gfa.from_gfa(spark, str(tmp_path / "g.gfa"))) == [(0, "ACGT" * 9 + "GATTACA", True, 0)]


def test_compress_keeps_the_first_flag_and_outer_edges(spark):
    graph = from_lists(spark, ["A", "C", "", "G", "T", "A"], [[1, 3], [2], [4], [4], [5], []], ref=[0, 1, 4])
    small = compress(graph)
    assert [n[1:3] for n in nodes(small)] == [("A", True), ("C", True), ("G", False), ("TA", True)]
    assert edges(small) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    again = compress(small)
    assert (nodes(again), edges(again)) == (nodes(small), edges(small))
    ring = compress(from_lists(spark, ["A", "C", "G"], [[1], [0], []]))
    assert [n[1] for n in nodes(ring)] == ["A", "C", "G"] and edges(ring) == [(0, 1), (1, 0)]


def test_add_empty_nodes(spark):
    build = GraphBuilder()
    ids = [build.add_node(s, ref_index=i) for i, s in enumerate(["AC", "G", "TT"])]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        build.add_edge(ids[a], ids[b])
    graph = add_empty_nodes(build.build(spark))
    assert nodes(graph)[3] == (3, "", False, None)
    assert edges(graph) == [(0, 1), (0, 3), (1, 2), (3, 2)]
    assert {(r.src, r.dst): (r.out_ord, r.in_ord) for r in graph.edges.collect()}[(3, 2)] == (0, 0)


VCF = """##x
#CHROM\tPOS\tID\tREF\tALT
1\t3\t.\tA\tG\t.
chr1\t5\t.\tAC\tA\t.
1\t6\t.\tC\tT\t.
2\t1\t.\tA\tAT,ACC
1\t7\t.\tG\t<DEL>
1\t8\t.\tgt\tgtA
1\t9\t.\tT\t.
short"""


def test_vcf(spark):
    rows = vcf.from_vcf_lines(lines(spark, VCF)).orderBy("row_id").collect()
    assert [(r.chrom, r.pos, r.ref, r.alts) for r in rows] == [
        (1, 2, "A", ["G"]), (1, 5, "C", [""]), (1, 5, "C", ["T"]), (2, 1, "", ["T", "CC"]), (1, 9, "", ["A"]), (1, 8, "T", [""]),
    ]
    assert vcf.from_vcf_lines(lines(spark, VCF), 2).count() == 1


FASTA = "junk\n>1 one\nACgt\nNRA\n\n>2\nGG\nAX\n>3 empty\n>X\nT"


def test_fasta(spark):
    rows = {r.name: (r.chrom, r.seq) for r in fasta.contigs(lines(spark, FASTA)).collect()}
    assert rows == {"1 one": (1, "ACgtNA"), "2": (2, "GGA"), "3 empty": (3, ""), "X": (0, "T")}
    pieces = {(r.name, r.piece): (r.n, r.text) for r in fasta.contig_pieces(lines(spark, FASTA), piece=4).collect()}
    assert pieces == {("1 one", 0): (6, "ACgt"), ("1 one", 1): (6, "NA"), ("2", 0): (3, "GGA"), ("3 empty", 0): (0, ""), ("X", 0): (1, "T")}
    assert fasta.contigs(lines(spark, FASTA), 2).first().seq == "GGA"


def test_merge(spark):
    contigs = spark.createDataFrame([(1, "ACGTACGTAC")], "chrom int, seq string")
    rows = [(0, 1, 2, "G", ["A", ""]), (1, 1, 2, "G", ["T"]), (2, 1, 3, "", ["CC"]), (3, 1, 5, "CG", [""]), (4, 1, 6, "G", ["A"]), (5, 1, 40, "A", ["C"])]
    graph = merge.merge(contigs, spark.createDataFrame(rows, "row_id long, chrom int, pos long, ref string, alts array<string>"))
    assert nodes(graph) == [
        (0, "AC", True, 0), (1, "G", True, 1), (2, "A", False, None), (3, "", False, None), (4, "", True, 2), (5, "CC", False, None),
        (6, "TA", True, 3), (7, "CG", True, 4), (8, "", False, None), (9, "TAC", True, 5),
    ]
    assert edges(graph) == sorted([(0, 1), (0, 2), (0, 3)] + [(a, b) for a in (1, 2, 3) for b in (4, 5)] + [(4, 6), (5, 6), (6, 7), (6, 8), (7, 9), (8, 9)])
    at_start = merge.merge(contigs, spark.createDataFrame([(0, 1, 0, "A", ["C"])], "row_id long, chrom int, pos long, ref string, alts array<string>"))
    assert edges(at_start) == [(0, 2), (1, 2)]
    bare = merge.merge(contigs, spark.createDataFrame([], "row_id long, chrom int, pos long, ref string, alts array<string>"))
    assert nodes(bare) == [(0, "ACGTACGTAC", True, 0)]


def test_merge_reads_pieces_of_long_contigs(spark):
    contigs = spark.createDataFrame([(1, "ACGTTGCA" * 5)], "chrom int, seq string")
    ranges = spark.createDataFrame([(1, 0, 0, 40), (1, 1, 3, 9), (1, 2, 8, 0), (1, 3, 39, 1)], "chrom int, i int, start long, size long")
    got = {r.i: r.seq for r in merge.cut_ranges(merge.in_pieces(contigs, 4), ranges, ["i"], piece=4).collect()}
    text = "ACGTTGCA" * 5
    assert got == {0: text, 1: text[3:12], 2: "", 3: text[39:]}


def test_fasta_vcf_files_and_stores(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">1\nACGTACGT\n")
    (tmp_path / "v.vcf").write_text("#h\n1\t3\t.\tG\tT\n")
    graph = merge.from_fasta_vcf(spark, str(tmp_path / "r.fa"), str(tmp_path / "v.vcf"))
    assert [n[1] for n in nodes(graph)] == ["AC", "G", "T", "TACGT"]
    store.write_graph(graph, str(tmp_path / "g"))
    again = store.read_graph(spark, str(tmp_path / "g"))
    assert (nodes(again), edges(again)) == (nodes(graph), edges(graph))
    store.write_binary(graph, str(tmp_path / "g.bin"))
    third = store.read_binary(spark, str(tmp_path / "g.bin"))
    assert [n[:3] for n in nodes(third)] == [n[:3] for n in nodes(graph)] and edges(third) == edges(graph)


def test_binary_layout(spark, tmp_path):
    store.write_binary(from_lists(spark, ["ACGT" * 9, ""], [[1], []], encoding="CGAT", ref=[0]), str(tmp_path / "g.bin"))
    data = (tmp_path / "g.bin").read_bytes()
    assert data[:15] == b"BIOCYGRAPH\x01CGAT" and data[15:19] == b"\x02\0\0\0"
    assert data[19:27] == b"\x24\0\0\0\x02\0\0\0"
    assert int.from_bytes(data[27:35], "little") == int("2013" * 8, 4)  # C is 0, G is 1, A is 2 and T is 3
    back = store.read_binary(spark, str(tmp_path / "g.bin"))
    assert back.encoding == "CGAT" and [n[1] for n in nodes(back)] == ["ACGT" * 9, ""]
    (tmp_path / "bad.bin").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a binary graph"):
        store.read_binary(spark, str(tmp_path / "bad.bin"))


def test_builders_and_lookups(spark):
    graph = from_codes(spark, [[0, 1], [], [3]], [[1, 2], [2], []], [True, False, True], "GATC")
    assert [n[1:3] for n in nodes(graph)] == [("GA", True), ("", False), ("C", True)]
    assert get_node(graph, 2).first().seq == "C" and get_node(graph, 9).isEmpty()
    assert [node_base(graph, 0, i).first().code for i in (0, 1, 2)] == [0, 1, None]
    assert (describe_node(graph, 2).first().in_nodes, describe_node(graph, 0).first().out_nodes) == ([0, 1], [1, 2])
    table = spark.createDataFrame([(5, "AC", [6]), (6, "G", [])], "node_id long, seq string, edges array<long>")
    own = from_tables(table, ref=spark.createDataFrame([(5,)], "node_id long"))
    assert [n[2] for n in nodes(own)] == [True, False] and root_node(own).first().node_id == 5
    with pytest.raises(ValueError):
        from_codes(spark, [[4]], [[]], [True])
    with pytest.raises(ValueError):
        GraphBuilder().add_edge(0, 1)


def test_required_empty_node_count(spark):
    assert required_empty_node_count(from_lists(spark, ["A"] * 5, [[1, 4], [2, 3], [3], [4], []])) == 3
    assert required_empty_node_count(from_lists(spark, ["A"] * 2, [[1], [0]])) == 0
    with pytest.raises(ValueError, match="cycle"):
        required_empty_node_count(from_lists(spark, ["A"] * 4, [[1], [2, 3], [1], []]))


def test_empty_graph(spark):
    from kmerloom.operators.occurrences import find

    own = store.empty_graph(spark)
    assert find(own, 3, True).isEmpty() and compress(own).nodes.isEmpty() and add_empty_nodes(own).nodes.isEmpty()


def test_kept_variants_by_links(spark):
    """Chains of links against a sweep in order: ties, insertions, nested and touching variants, and one long deletion over
    very many others."""
    import random

    from kmerloom.sources.merge import kept_variants

    rnd = random.Random(8)
    rows = [(i, rnd.randint(1, 2), rnd.randint(0, 400), "A" * rnd.choice([0, 0, 1, 1, 2, 5, 30]), ["C"]) for i in range(500)]
    rows += [(1000 + i, 3, 7, "", ["C"]) for i in range(5)] + [(2000, 3, 7, "AC", ["C"]), (2001, 3, 8, "", ["C"]), (2002, 3, 9, "", ["C"])]

    def swept(own):
        out, at = [], {}
        for i, chrom, pos, ref, _ in sorted(own, key=lambda r: (r[1], r[2], r[0])):
            if pos >= at.get(chrom, -1):
                out.append((chrom, i))
                at[chrom] = pos + len(ref)
        return sorted(out)

    schema = "row_id long, chrom int, pos long, ref string, alts array<string>"
    assert sorted((r.chrom, r.row_id) for r in kept_variants(spark.createDataFrame(rows, schema)).collect()) == swept(rows)
    assert kept_variants(spark.createDataFrame([], schema)).collect() == []
    many = spark.range(100_000).selectExpr("id + 1 AS row_id", "1 AS chrom", "id * 2 + 10 AS pos", "'ACG' AS ref", "array('T') AS alts")
    over = spark.createDataFrame([(0, 1, 0, "A" * 100_000, [""])], schema).unionByName(many)
    got = kept_variants(over).selectExpr("count(*)", "min(row_id)", "sum(row_id)").first()
    later = [i + 1 for i in range(100_000) if i * 2 + 10 >= 100_000][::2]  # of those past the deletion, every second
    assert tuple(got) == (1 + len(later), 0, sum(later))


@pytest.mark.parametrize("seed", [1, 2])
def test_depth_difference_of_drawn_graphs(spark, seed):
    """Long chains, bubbles, dead ends and unreachable parts, against the layers of all walks."""
    import random

    rnd = random.Random(seed)
    n, edges = 60, [[] for _ in range(64)]
    for v in range(n - 1):
        if v != 40:  # node 40 is the last one
            edges[v] = sorted({min(n - 1, v + d) for d in rnd.choice([[1], [1], [1], [1, 3], [1, 2, 7]])})
    edges[60], edges[61], edges[62] = [61], [60, 62], [30]  # a cycle that the root does not reach
    edges[40] = []
    layer, depths, depth = {0}, [], 0
    while layer:
        depths += [depth] * (40 in layer)
        layer, depth = {w for v in layer for w in edges[v]}, depth + 1
    assert required_empty_node_count(from_lists(spark, ["A"] * 64, edges)) == max(depths) - min(depths) > 0


def test_variant_lines_are_made_and_split_once(spark):
    """What a line is made by stands in the plan for the filter on lines, its split and the filter that Spark adds to that; not
    for each column, and each prefix of an allele, that is read from it."""
    made = F.concat_ws("\t", F.lit("1"), (F.col("id") + 5).cast("string"), F.substring(F.md5(F.col("id").cast("string")), 1, 3), F.lit("AC"), F.lit("AG,A"))
    plan = vcf.from_vcf_lines(spark.range(4).select(made.alias("value"), F.col("id").alias("line_no")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 4
    assert [tuple(r) for r in plan.orderBy("row_id").limit(1).collect()] == [(0, 1, 5, "C", ["G", ""])]


def test_chains_are_not_broadcast(spark):
    from kmerloom.operators.graph import chain_map, compress
    from kmerloom.sources.literals import from_lists

    graph = from_lists(spark, ["A", "C", "G", "T"], [[1], [2], [3], []], ref=[0, 1, 2, 3])
    assert {(r.head, r.place) for r in chain_map(graph).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3)}
    assert "BroadcastHashJoin" not in compress(graph).edges._jdf.queryExecution().executedPlan().toString()
