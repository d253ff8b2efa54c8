"""Registered queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom import __main__ as command
from kmerloom import api
from kmerloom import derived as D
from kmerloom.functions import kmers as K
from kmerloom.operators import frequency, graph, occurrences, signatures, unitigs
from kmerloom.plans.lineage import cut, new_path
from kmerloom.sources import fasta, gfa, indexed, literals, merge, store, vcf

#: Parameters of the registered queries.
K_SMALL, K_LARGE, K_PAIRS, BUDGET = 5, 31, 9, 4
ENCODING = "CGAT"
#: Bytes of a range of the indexed files, small enough for many ranges in the derived text.
INDEX_RANGE = 1 << 12


def hash_decode_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_partkey").cast("string")
    own = D.table(spark, sf_dir, "part").select("p_partkey", F.substr(D.bases(name), F.lit(1), F.lit(12)).alias("kmer"))
    hashed = own.select("p_partkey", "kmer", K.hash_kmer(F.lower("kmer")).alias("hash"), K.hash_kmer(F.col("kmer"), ENCODING).alias("hash_cgat"))
    return hashed.withColumns({"decoded": K.decode_kmer(F.col("hash"), 12), "decoded_cgat": K.decode_kmer(F.col("hash_cgat"), 12, ENCODING), "reversed": K.reverse_hash(F.col("hash"), 12), "left": K.left_align(F.col("hash"), 12), "first_5": K.hash_first(F.col("kmer"), 5)})


def pack_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.transform(F.split(K.digits(D.bases(F.col("p_partkey").cast("string"))), ""), lambda x: x.cast("int"))
    own = D.table(spark, sf_dir, "part").select("p_partkey", codes.alias("codes"))
    return own.select("p_partkey", K.pack_codes(F.col("codes"), 8).alias("packed"), K.pack_codes(F.col("codes"), 8, 3).alias("packed_3"), K.pack_codes_left(F.col("codes"), 8, 3).alias("left_3"))


def linear_kmer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.sequence_counts(D.letters(spark, sf_dir), K_LARGE)


def distinct_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.distinct_kmers(occurrences.linear_kmers(D.letters(spark, sf_dir).select("seq"), K_SMALL, positions=False))


def find_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_LARGE, max_variant_nodes=BUDGET)


def find_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_SMALL, True, BUDGET)


def find_spanning_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_LARGE, True, BUDGET)


def find_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.long_chain_graph(spark, sf_dir)
    return occurrences.find(own, K_LARGE, max_variant_nodes=BUDGET, units=unitigs.unitigs(own, K_LARGE))


def find_compacted_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.long_chain_graph(spark, sf_dir)
    return occurrences.find(own, K_LARGE, True, BUDGET, units=unitigs.unitigs(own, K_LARGE))


def find_one_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_LARGE, True, BUDGET, node_id=21)


def find_max_variants_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_LARGE, True, 0)


def find_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find(D.bubble_graph(spark, sf_dir), K_SMALL, False, 1, reverse=True)


def found_kmer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.kmer_lines(occurrences.find(D.bubble_graph(spark, sf_dir), K_SMALL, True, 1))


def kmer_frequency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequency_index(D.bubble_graph(spark, sf_dir), K_LARGE, BUDGET)


def spanning_frequency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequency_index(D.bubble_graph(spark, sf_dir), K_SMALL, BUDGET, True)


def spanning_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.find_spanning_node(D.bubble_graph(spark, sf_dir), K_LARGE, 21, BUDGET)


def variant_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.variant_kmers(D.bubble_graph(spark, sf_dir), K_PAIRS, D.variant_pairs(spark, sf_dir), BUDGET)


def variant_kmers_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.variant_kmers(D.bubble_graph(spark, sf_dir), K_LARGE, D.variant_pairs(spark, sf_dir), BUDGET)


def _windows(spark: SparkSession, sf_dir: str):
    own = D.bubble_graph(spark, sf_dir)
    walked = occurrences.walk(own, K_PAIRS, BUDGET)
    return own, signatures.kmer_windows(own, K_PAIRS, D.variant_pairs(spark, sf_dir), None, BUDGET, walked)


def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windows(spark, sf_dir)[1]
    return rows.select("pair_id", "side", "node_id", "window", "start_position", "kmer_position", "max_frequency", F.posexplode("kmers").alias("ord", "kmer"))


def window_pairs_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, windows = _windows(spark, sf_dir)
    out = signatures.with_pair_overlap(cut(signatures.window_pairs(own, K_PAIRS, cut(windows))))
    return out.select("pair_id", "ref_window", "var_window", "max_frequency", "hypotenuse_frequency", "overlap")


def _listed(found: DataFrame) -> DataFrame:
    """A row for each k-mer of each side of a signature, and one without a k-mer for an empty side."""
    sides = F.explode_outer(F.array(F.struct(F.lit("ref").alias("side"), F.col("reference_kmers").alias("kmers")), F.struct(F.lit("var").alias("side"), F.col("variant_kmers").alias("kmers"))))
    each = found.select("pair_id", "max_frequency", "hypotenuse_frequency", sides.alias("x"))
    return each.select("pair_id", "max_frequency", "hypotenuse_frequency", F.col("x.side").alias("side"), F.posexplode_outer("x.kmers").alias("ord", "kmer"))


def _signatures(minimize: bool, align: bool, k: int = K_PAIRS):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        finder = api.KmerFinder(D.bubble_graph(spark, sf_dir), k)
        return _listed(finder.find_variant_signatures(D.variant_pairs(spark, sf_dir), max_variant_nodes=BUDGET, minimize_overlaps=minimize, align_windows=align))

    return query


def signatures_given_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the k-mer counts of the documents' letters in place of the graph's."""
    finder = api.KmerFinder(D.bubble_graph(spark, sf_dir), K_PAIRS)
    finder.set_frequency_index(frequency.sequence_counts(D.letters(spark, sf_dir), K_PAIRS))
    return _listed(finder.find_variant_signatures(D.variant_pairs(spark, sf_dir), max_variant_nodes=BUDGET))


def signatures_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.bubble_graph(spark, sf_dir)
    counts = api.KmerFinder(own, K_LARGE, reverse_kmers=True).create_frequency_index(BUDGET)
    return _listed(api.get_variant_signatures(own, D.variant_pairs(spark, sf_dir), counts, K_LARGE))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "index")
    store.write_index(frequency.frequency_index(D.bubble_graph(spark, sf_dir), K_LARGE, BUDGET), path, K_LARGE)
    return store.read_index(spark, path, K_LARGE)


def stored_index_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all pairs with a stored index of the whole graph."""
    own, path = D.bubble_graph(spark, sf_dir), new_path(spark, "index")
    store.write_index(frequency.frequency_index(own, K_PAIRS, BUDGET), path, K_PAIRS)
    finder = api.KmerFinder(own, K_PAIRS)
    finder.use_stored_index(path)
    return _listed(finder.find_variant_signatures(D.variant_pairs(spark, sf_dir), max_variant_nodes=BUDGET, minimize_overlaps=True))


def signature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.KmerFinder(D.bubble_graph(spark, sf_dir), K_PAIRS).find_variant_signatures(D.variant_pairs(spark, sf_dir), max_variant_nodes=BUDGET)
    text = store.signature_text(found, K_PAIRS)
    return text.select("pair_id", F.array_join("reference", ",").alias("reference"), F.array_join("variant", ",").alias("variant"), "max_frequency")


def in_edges_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.add_in_edges(D.bubble_graph(spark, sf_dir))
    listed = own.edges.groupBy(F.col("dst").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("in_ord", "src"))), lambda x: x["src"].cast("string")), ",").alias("in_nodes"))
    return graph.degrees(own).join(listed, "node_id", "left").withColumn("in_nodes", F.coalesce("in_nodes", F.lit("")))


def root_last_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.bubble_graph(spark, sf_dir)
    found = {"root": graph.root_node(own), "last": graph.last_node(own), "chromosome_start": store.chromosome_start(own), "reference_7": graph.reference_node(own, 7)}
    out = None
    for name, df in found.items():
        row = df.select(F.lit(name).alias("what"), F.col("node_id").cast("long").alias("node_id"))
        out = row if out is None else out.unionByName(row)
    return out


def edge_and_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.bubble_graph(spark, sf_dir)
    asked = D.sites(spark, sf_dir).select((F.col("site") * 2).alias("a"), (F.col("site") * 2 + 3).alias("b"))
    edges = graph.has_edge(own, asked).withColumnRenamed("found", "has_edge")
    parents = graph.has_parent(own).select(F.col("node_id").alias("a"), F.col("found").alias("has_parent"))
    empties = graph.required_empty_nodes(own).select(F.col("node_id").alias("a"), "n")
    return edges.join(parents, "a").join(empties, "a", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def graph_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return store.to_arrays(D.bubble_graph(spark, sf_dir)).select("node_id", "length", text("codes"), text("edges"), "is_ref", "is_nonempty_ref")


def _described(own) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return graph.describe_nodes(own).select("node_id", "seq", "is_ref", text("out_nodes"), text("in_nodes"))


def describe_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(D.bubble_graph(spark, sf_dir))


def edge_list_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.chain_graph(spark, sf_dir)
    listed = store.to_arrays(own).select("node_id", "edges")
    return _described(literals.from_tables(own.nodes.select("node_id", "seq").join(listed, "node_id"), ref=own.nodes.where("is_ref").select("node_id")))


def code_table_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(literals.from_code_table(store.to_arrays(D.chain_graph(spark, sf_dir)), ENCODING))


def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "graph")
    store.write_binary(graph.compress(D.chain_graph(spark, sf_dir)), path)
    return _described(store.read_binary(spark, path))


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "graph")
    store.write_graph(D.bubble_graph(spark, sf_dir), path)
    return _described(store.read_graph(spark, path))


def extended_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty node for every tenth site after the nodes that are there."""
    new = D.sites(spark, sf_dir).where("site % 10 = 0").select("site", F.lit("").alias("seq"), F.lit(False).alias("is_ref"))
    return literals.add_nodes(D.bubble_graph(spark, sf_dir), new, "site").nodes


def extended_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from every tenth site's reference node to that of the next site but one, after the edges that are there."""
    own = D.bubble_graph(spark, sf_dir)
    new = D.sites(spark, sf_dir).where("site % 10 = 0").select((F.col("site") * 2).alias("src"), (F.col("site") * 2 + 4).alias("dst"))
    return literals.add_edges(own, new.join(own.nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi"), "src", "dst").edges


def get_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.get_nodes(D.bubble_graph(spark, sf_dir), D.variant_pairs(spark, sf_dir).select(F.col("var_node").alias("node_id")))


def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.base_codes(D.bubble_graph(spark, sf_dir).nodes, F.col("node_id").cast("int") % 7)


def encoding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.substring(D.bases(F.col("p_partkey").cast("string")), 1, 3), F.when(F.col("p_partkey") % 2 == 0, "t").when(F.col("p_partkey") % 3 == 0, "AC").otherwise("G"))
    return D.table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("valid", K.is_encoding(F.col("name")))


def required_empty_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.required_empty_node_count(D.heap_graph(spark, sf_dir)),)], "n long")


def required_empty_node_count_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.required_empty_node_count(D.long_chain_graph(spark, sf_dir)),)], "n long")


def next_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_reference(D.bubble_graph(spark, sf_dir))


def compress_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compress(D.chain_graph(spark, sf_dir)).nodes


def compress_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compress(D.chain_graph(spark, sf_dir)).edges


def add_empty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.add_empty_nodes(_skip_graph(spark, sf_dir)).edges


def _skip_graph(spark: SparkSession, sf_dir: str):
    """Reference nodes in a row, with an edge over every fourth one: deletions."""
    own = D.bubble_graph(spark, sf_dir)
    ref = own.nodes.where("is_ref")
    rows = ref.select(F.col("node_id").alias("src"), F.explode(F.expr("if(ref_index % 4 = 0, array(1, 2), array(1))")).alias("step"))
    edges = rows.select("src", (F.col("src") + 2 * F.col("step")).alias("dst"), (F.col("step") - 1).alias("out_ord")).join(ref.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return graph.add_in_edges(own.with_tables(ref, edges.withColumn("in_ord", F.lit(0))))


def gfa_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.from_gfa_lines(D.gfa_lines(spark, sf_dir), compress=False).nodes


def gfa_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.from_gfa_lines(D.gfa_lines(spark, sf_dir), compress=False).edges


def gfa_dense_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.from_gfa_lines(D.chain_gfa_lines(spark, sf_dir), compress=False).nodes


def gfa_compressed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.from_gfa_lines(D.chain_gfa_lines(spark, sf_dir)).nodes


def vcf_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.from_vcf_lines(D.vcf_lines(spark, sf_dir)).withColumn("alts", F.array_join("alts", ","))


def vcf_structural_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vcf.records(D.vcf_lines(spark, sf_dir))
    return rows.withColumn("structural", vcf.is_structural(F.col("ref")) | vcf.is_structural(F.col("alt")))


def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.contigs(D.fasta_lines(spark, sf_dir)).select("contig", "name", "chrom", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("length"))


def fasta_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.contig_pieces(D.fasta_lines(spark, sf_dir)).withColumn("text", F.md5("text"))


def fasta_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.contig_pieces(D.fasta_lines(spark, sf_dir), 2).withColumn("text", F.md5("text"))


def indexed_fasta_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.fasta_vcf_files(spark, sf_dir)[0]
    index = indexed.write_line_index(spark, path, "fasta", new_path(spark, "line-index"), INDEX_RANGE)
    return fasta.read_fasta(spark, path, 2, index).withColumn("text", F.md5("text"))


def indexed_vcf_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.fasta_vcf_files(spark, sf_dir)[1]
    index = indexed.write_line_index(spark, path, "vcf", new_path(spark, "line-index"), INDEX_RANGE)
    return vcf.read_vcf(spark, path, 3, index).withColumn("alts", F.array_join("alts", ","))


def indexed_gfa_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.gfa_file(spark, sf_dir)
    index = indexed.write_line_index(spark, path, "gfa", new_path(spark, "line-index"), INDEX_RANGE)
    return gfa.from_gfa(spark, path, compress=False, index=index).nodes


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each chromosome of the FASTA text, counted by what the index says of them."""
    found = indexed.line_index(spark, D.fasta_vcf_files(spark, sf_dir)[0], "fasta", INDEX_RANGE)
    return found.groupBy(F.col("low").alias("chrom")).agg(F.min("first_line").alias("first_line"), F.sum(F.col("stop") - F.col("start")).alias("n_bytes"))


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return command.build(spark, *D.fasta_vcf_files(spark, sf_dir), new_path(spark, "graph"))


def _merged(spark: SparkSession, sf_dir: str):
    return merge.merge(fasta.contig_pieces(D.fasta_lines(spark, sf_dir)), vcf.from_vcf_lines(D.vcf_lines(spark, sf_dir)))


def kept_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.kept_variants(vcf.from_vcf_lines(D.vcf_lines(spark, sf_dir))).withColumn("alts", F.array_join("alts", ","))


def fasta_vcf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).nodes


def fasta_vcf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).edges


QUERIES = {
    f.__name__: f
    for f in (
        *(hash_decode_reverse, pack_kmers, encoding_check, linear_kmer_frequency, distinct_kmers),
        *(find_initial, find_spanning, find_spanning_large, find_max_variants_0, find_reversed, find_one_node, found_kmer_text, find_compacted, find_compacted_spanning),
        *(kmer_frequency_index, spanning_frequency_index, spanning_node, variant_kmers, variant_kmers_large, kmer_windows, window_pairs_aligned),
        *(signatures_given_frequencies, signatures_wrapper, signature_text, stored_index, stored_index_signatures),
        *(in_edges_degrees, root_last_nodes, edge_and_parent, graph_arrays, describe_nodes, get_nodes, base_codes, next_reference, required_empty_node_count, required_empty_node_count_chain),
        *(compress_nodes, compress_edges, add_empty_nodes, edge_list_graph, code_table_graph, binary_round_trip, stored_graph, extended_nodes, extended_edges),
        *(gfa_nodes, gfa_edges, gfa_dense_nodes, gfa_compressed_nodes, vcf_normalize, vcf_structural_filter),
        *(fasta_contigs, fasta_pieces, fasta_chromosome, kept_variants, fasta_vcf_nodes, fasta_vcf_edges, command_line),
        *(line_index, indexed_fasta_chromosome, indexed_vcf_chromosome, indexed_gfa_nodes),
    )
}
QUERIES |= {
    "signatures_unaligned": _signatures(False, False),
    "signatures_unaligned_min_overlap": _signatures(True, False),
    "signatures_aligned": _signatures(False, True),
    "signatures_aligned_min_overlap": _signatures(True, True),
    "signatures_large_unaligned_min_overlap": _signatures(True, False, K_LARGE),
    "signatures_large_aligned_min_overlap": _signatures(True, True, K_LARGE),
}

# ---- SQL ----------------------------------------------------------------------------------------------------------

#: The bubble graph derived from part.
_GRAPH = """
    site AS (SELECT p_partkey AS site,
                    substring(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (1 + p_size % 12)::INT) AS ref,
                    CASE WHEN p_partkey % 3 = 1 THEN substring(translate(md5('v' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (p_size % 4)::INT) END AS alt
             FROM part),
    node AS (SELECT site, site * 2 AS node_id, ref AS seq, true AS is_ref FROM site
             UNION ALL SELECT site, site * 2 + 1, alt, false FROM site WHERE alt IS NOT NULL),
    nodes AS (SELECT node_id, seq, length(seq)::INT AS length, is_ref, CASE WHEN is_ref THEN site END AS ref_index FROM node),
    edges AS (SELECT a.node_id AS src, b.node_id AS dst, (b.node_id % 2)::INT AS out_ord,
                     (row_number() OVER (PARTITION BY b.node_id ORDER BY a.node_id) - 1)::INT AS in_ord
              FROM node a JOIN node b ON b.site = a.site + 1)
"""


#: The graph of long chains derived from part.
_LONG = """
    nodes AS (SELECT p_partkey AS node_id, substring(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (p_size % 4)::INT) AS seq,
                     (p_size % 4)::INT AS length, p_partkey % 40 <> 3 AS is_ref FROM part),
    edges AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, (b.p_partkey - a.p_partkey - 1)::INT AS out_ord FROM part a JOIN part b
              ON b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 97 <> 0 OR b.p_partkey = a.p_partkey + 2 AND a.p_partkey % 20 = 0)
"""


def _hash(text: str) -> str:
    """A k-mer's base-4 number in DuckDB."""
    return f"list_reduce(list_transform(string_split(translate({text}, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b)"


def _occurrences(k: int, most: int) -> str:
    """occ(start_node, p, path, offs, ords, s): every occurrence, by a recursive walk over paths that are short of k bases.

    A start position p is carried as the text from there on; a step adds a node, and the walk ends once k bases are there.
    """
    return f"""
    walk(start_node, p, path, offs, ords, n_var, s, last_len) AS (
        SELECT node_id, p, [node_id], [0], []::INT[], (NOT is_ref)::INT, substring(seq, p + 1, {k}), length
        FROM nodes, unnest(range(0, length)) AS t(p) WHERE (NOT is_ref)::INT <= {most}
        UNION ALL
        SELECT start_node, p, list_append(path, n.node_id), list_append(offs, (CASE WHEN len(path) = 1 THEN m.length ELSE w.p + length(w.s) END)::INT),
               list_append(ords, e.out_ord), w.n_var + (NOT n.is_ref)::INT, substring(w.s || n.seq, 1, {k}), n.length
        FROM walk w JOIN edges e ON e.src = w.path[-1] JOIN nodes n ON n.node_id = e.dst JOIN nodes m ON m.node_id = w.start_node
        WHERE length(w.s) < {k} AND w.n_var + (NOT n.is_ref)::INT <= {most}),
    occ AS (SELECT start_node, p, path, offs, ords, s FROM walk WHERE length(s) = {k} AND last_len > 0),
    rows AS (SELECT start_node, p, ords, s, path[i] AS node_id, i, CASE WHEN i = 1 THEN p ELSE 0 END::INT AS start_position,
                    CASE WHEN i = 1 THEN 0 ELSE offs[i] - p END::INT AS kmer_position
             FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM occ))
    """


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


_K31 = _with(_GRAPH, _occurrences(K_LARGE, BUDGET))
_K5 = _with(_GRAPH, _occurrences(K_SMALL, BUDGET))

def _windows_sql(k: int = K_PAIRS, freq: str = "SELECT s, count(*) AS n FROM occ GROUP BY s", item: str = _hash("s")) -> str:
    """freq: frequencies (s, n); item: what stands for a k-mer s in the lists."""
    return f"""{_with(_GRAPH, _occurrences(k, BUDGET))},
    pair AS (SELECT site AS pair_id, site * 2 AS ref_node, site * 2 + 1 AS var_node FROM site WHERE alt IS NOT NULL),
    side AS (SELECT pair_id, 'ref' AS side, ref_node AS centre FROM pair UNION ALL SELECT pair_id, 'var', var_node FROM pair),
    freq AS ({freq}),
    over_centre AS (SELECT r.* FROM rows r JOIN (SELECT DISTINCT centre FROM side) c ON r.node_id = c.centre),
    live AS (SELECT DISTINCT node_id AS centre, start_node FROM over_centre),
    back(centre, node_id, used, key) AS (
        SELECT DISTINCT centre, centre, 0, []::INT[] FROM live
        UNION ALL
        SELECT b.centre, e.src, b.used + n.length, list_append(b.key, -e.in_ord)
        FROM back b JOIN edges e ON e.dst = b.node_id JOIN nodes n ON n.node_id = e.src LEFT JOIN live l ON l.centre = b.centre AND l.start_node = e.src
        WHERE b.used <= {k - 2} AND (n.length = 0 OR l.centre IS NOT NULL)),
    reached AS (SELECT b.centre, b.node_id AS start_node, min(b.key) AS key FROM back b JOIN live l ON l.centre = b.centre AND l.start_node = b.node_id GROUP BY ALL),
    missed AS (SELECT centre, start_node FROM live ANTI JOIN reached USING (centre, start_node)),
    rest(centre, node_id, used, key) AS (
        SELECT DISTINCT centre, centre, 0, []::INT[] FROM missed
        UNION ALL
        SELECT b.centre, e.src, b.used + n.length, list_append(b.key, -e.in_ord)
        FROM rest b JOIN edges e ON e.dst = b.node_id JOIN nodes n ON n.node_id = e.src WHERE b.used <= {k - 2}),
    keys AS (SELECT centre, start_node, false AS late, key FROM reached
             UNION ALL SELECT m.centre, m.start_node, true, min(b.key) FROM missed m JOIN rest b ON b.centre = m.centre AND b.node_id = m.start_node GROUP BY ALL),
    found AS (SELECT o.node_id AS centre, o.start_position, o.kmer_position, o.s, k.late, k.key, o.ords, o.p, coalesce(f.n, 0) AS n
              FROM over_centre o JOIN keys k ON k.centre = o.node_id AND k.start_node = o.start_node LEFT JOIN freq f ON f.s = o.s),
    grouped AS (SELECT centre, start_position, kmer_position, list({item} ORDER BY late, key, ords, p) AS kmers, max(n)::BIGINT AS max_frequency,
                       arg_min(row(late, key, ords, p), row(late, key, ords, p)) AS first
                FROM found GROUP BY ALL),
    numbered AS (SELECT *, (row_number() OVER (PARTITION BY centre ORDER BY first) - 1)::INT AS window_no FROM grouped),
    windows AS (SELECT s.pair_id, s.side, g.centre AS node_id, g.window_no AS "window", g.start_position, g.kmer_position, g.kmers, g.max_frequency
                FROM numbered g JOIN side s ON s.centre = g.centre)
    """


def _aligned_sql(k: int = K_PAIRS) -> str:
    return f"""{_windows_sql(k)},
    sized AS (SELECT w.*, w.kmer_position - w.start_position AS l, {k} + w.start_position - n.length - w.kmer_position AS r FROM windows w JOIN nodes n ON n.node_id = w.node_id),
    aligned AS (SELECT a.pair_id, a."window" AS ref_window, b."window" AS var_window, a.kmers AS reference_kmers, b.kmers AS variant_kmers,
                       a.max_frequency + b.max_frequency AS max_frequency, sqrt(a.max_frequency ** 2 + b.max_frequency ** 2) AS hypotenuse_frequency
                FROM sized a JOIN sized b ON a.pair_id = b.pair_id AND a.side = 'ref' AND b.side = 'var' AND (a.l = b.l OR a.r = b.r)),
    each_ref AS (SELECT pair_id, ref_window, var_window, unnest(reference_kmers) AS kmer FROM aligned),
    each_var AS (SELECT pair_id, ref_window, var_window, unnest(variant_kmers) AS kmer FROM aligned),
    shared AS (SELECT a.pair_id, a.ref_window, a.var_window FROM each_ref a JOIN each_var b ON a.pair_id = b.pair_id AND a.kmer = b.kmer AND (a.ref_window, a.var_window) <> (b.ref_window, b.var_window)
               UNION ALL
               SELECT a.pair_id, a.ref_window, a.var_window FROM each_var a JOIN each_ref b ON a.pair_id = b.pair_id AND a.kmer = b.kmer AND (a.ref_window, a.var_window) <> (b.ref_window, b.var_window)),
    overlap_counts AS (SELECT pair_id, ref_window, var_window, count(*) AS overlap FROM shared GROUP BY ALL)
    """


_TAIL = """
        both_sides AS (SELECT p.pair_id, max_frequency, hypotenuse_frequency, 'ref' AS side, reference_kmers AS kmers FROM pair p LEFT JOIN best USING (pair_id)
                 UNION ALL SELECT p.pair_id, max_frequency, hypotenuse_frequency, 'var', variant_kmers FROM pair p LEFT JOIN best USING (pair_id))
        SELECT pair_id, max_frequency, hypotenuse_frequency, side, ord::INT AS ord, kmers[ord + 1] AS kmer
        FROM (SELECT *, unnest(CASE WHEN coalesce(len(kmers), 0) = 0 THEN [NULL] ELSE range(0, len(kmers)) END) AS ord FROM both_sides)"""


def _signature_sql(minimize: bool, align: bool, k: int = K_PAIRS, **windows: str) -> str:
    """WITH clauses up to best: the signature of each pair."""
    if align:
        rank = f"{'coalesce(o.overlap, 0)' if minimize else '0'}, a.hypotenuse_frequency, a.ref_window, a.var_window"
        best = f"""
            best AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.pair_id ORDER BY {rank}) AS n
                     FROM aligned a LEFT JOIN overlap_counts o USING (pair_id, ref_window, var_window)) WHERE n = 1)"""
        head = _aligned_sql(k)
    else:
        head = (
            _windows_sql(k, **windows)
            + """,
            each AS (SELECT pair_id, side, "window", unnest(kmers) AS kmer FROM windows),
            overlap_counts AS (SELECT a.pair_id, a.side, a."window", count(*) AS overlap FROM each a JOIN each b ON a.pair_id = b.pair_id AND a.side <> b.side AND a.kmer = b.kmer GROUP BY ALL)
            """
        )
        rank = f"{'coalesce(o.overlap, 0)' if minimize else '0'}, w.max_frequency, w.\"window\""
        best = f"""
            picked AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY w.pair_id, w.side ORDER BY {rank}) AS n
                       FROM windows w LEFT JOIN overlap_counts o USING (pair_id, side, "window")) WHERE n = 1),
            best AS (SELECT pair_id, a.kmers AS reference_kmers, b.kmers AS variant_kmers, a.max_frequency + b.max_frequency AS max_frequency,
                            sqrt(a.max_frequency ** 2 + b.max_frequency ** 2) AS hypotenuse_frequency
                     FROM (SELECT * FROM picked WHERE side = 'ref') a FULL JOIN (SELECT * FROM picked WHERE side = 'var') b USING (pair_id))"""
    return f"{head}, {best}"


_VCF = """
    made AS (SELECT p_partkey AS i, p_size, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b,
                    translate(md5('w' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS c FROM part),
    raw AS (SELECT i AS row_id, (i % 3 + 1)::INT AS chrom, i * 7 + p_size AS pos, substring(b, 1, (p_size % 4 + 1)::INT) AS ref,
                   CASE i % 7 WHEN 0 THEN c[1:1] WHEN 1 THEN substring(b, 1, (p_size % 4 + 1)::INT) || c[1:3] WHEN 2 THEN b[1:1]
                              WHEN 3 THEN b[1:1] || 'A,' || b[1:1] || 'CC' WHEN 4 THEN '.' WHEN 5 THEN '<DEL>' ELSE lower(c[2:3]) END AS alt FROM made),
    judged AS (SELECT *, NOT (starts_with(ref, '.') OR regexp_full_match(ref, '[ACGTNacgtn,]*')) OR NOT (starts_with(alt, '.') OR regexp_full_match(alt, '[ACGTNacgtn,]*')) AS structural FROM raw),
    split AS (SELECT *, string_split(alt, ',') AS a FROM judged WHERE NOT structural),
    cut_off AS (SELECT *, len(list_filter(range(1, length(ref) + 1), lambda i: len(list_filter(a, lambda x: substring(x, 1, i) = substring(ref, 1, i))) = len(a))) AS n FROM split),
    variant AS (SELECT row_id, chrom, pos + n - 1 AS pos, CASE WHEN substring(ref, (n + 1)::INT) = '.' THEN '' ELSE substring(ref, (n + 1)::INT) END AS ref,
                       array_to_string(list_transform(a, lambda x: CASE WHEN substring(x, (n + 1)::INT) = '.' THEN '' ELSE substring(x, (n + 1)::INT) END), ',') AS alts FROM cut_off)
"""

#: The greedy sweep as a recursive walk: the next kept variant is the first that begins at or past the end of the last.
_KEPT = """
    kept(chrom, pos, row_id, ref, alts) AS (
        SELECT chrom, pos, row_id, ref, alts FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, row_id) AS n FROM variant) WHERE n = 1
        UNION ALL
        SELECT v.chrom, v.pos, v.row_id, v.ref, v.alts FROM (
            SELECT v.*, row_number() OVER (PARTITION BY v.chrom ORDER BY v.pos, v.row_id) AS n
            FROM kept k JOIN variant v ON v.chrom = k.chrom AND (v.pos, v.row_id) > (k.pos, k.row_id) AND v.pos >= k.pos + length(k.ref)) v WHERE n = 1)
"""

_CHAINS = """
    bits AS (SELECT p_partkey AS i, substring(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (p_size % 12 + 1)::INT) AS seq, p_partkey % 4 <> 3 AS is_ref FROM part),
    link AS (SELECT a.i AS src, b.i AS dst, o AS out_ord FROM bits a, (VALUES (0), (1)) t(o), bits b WHERE ((o = 0 AND a.i % 5 <> 0) OR (o = 1 AND a.i % 7 = 0)) AND b.i = a.i + 1 + o),
    edge AS (SELECT *, (row_number() OVER (PARTITION BY dst ORDER BY src, out_ord) - 1)::INT AS in_ord FROM link),
    one_out AS (SELECT src FROM edge GROUP BY src HAVING count(*) = 1),
    one_in AS (SELECT dst FROM edge GROUP BY dst HAVING count(*) = 1),
    chain AS (SELECT src, dst FROM edge WHERE src IN (FROM one_out) AND dst IN (FROM one_in)),
    place(head, i, n) AS (SELECT i, i, 0 FROM bits WHERE i NOT IN (SELECT dst FROM chain) UNION ALL SELECT p.head, c.dst, p.n + 1 FROM place p JOIN chain c ON c.src = p.i),
    ids AS (SELECT head, row_number() OVER (ORDER BY head) - 1 AS new_id FROM (SELECT DISTINCT head FROM place)),
    located AS (SELECT p.*, d.new_id FROM place p JOIN ids d USING (head))
"""

ORACLES: dict[str, str] = {
    "hash_decode_reverse": f"""
        SELECT p_partkey, kmer, {_hash('kmer')} AS hash, {_hash("translate(kmer, 'CGAT', 'ACGT')")} AS hash_cgat, kmer AS decoded, kmer AS decoded_cgat,
               {_hash('reverse(kmer)')} AS reversed, ({_hash('kmer')}::HUGEINT * 1099511627776 - CASE WHEN kmer[1] IN ('G', 'T') THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS "left",
               {_hash('kmer[1:5]')} AS first_5
        FROM (SELECT p_partkey, substring(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS kmer FROM part)
    """,
    "pack_kmers": f"""
        SELECT p_partkey, {_hash('b[1:8]')} AS packed, {_hash('b[4:11]')} AS packed_3,
               ({_hash('b[4:11]')}::HUGEINT * 281474976710656 - CASE WHEN b[4] IN ('G', 'T') THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS left_3
        FROM (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM part)
    """,
    "linear_kmer_frequency": f"""
        WITH l AS (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents),
        k AS (SELECT substring(s, p, {K_LARGE}) AS s FROM (SELECT s, unnest(range(1, length(s) - {K_LARGE - 2})) AS p FROM l WHERE length(s) >= {K_LARGE})),
        c AS (SELECT s, count(*) AS frequency FROM k GROUP BY s)
        SELECT {_hash('s')} AS kmer, frequency FROM c
    """,
    "distinct_kmers": f"""
        WITH l AS (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)
        SELECT count(DISTINCT substring(s, p, {K_SMALL})) AS n_kmers FROM (SELECT s, unnest(range(1, length(s) - {K_SMALL - 2})) AS p FROM l WHERE length(s) >= {K_SMALL})
    """,
    "find_initial": f"{_K31} SELECT {_hash('s')} AS kmer, start_node AS node_id, p::INT AS start_position, 0 AS kmer_position FROM occ",
    "find_spanning": f"{_K5} SELECT {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows",
    "find_max_variants_0": f"{_with(_GRAPH, _occurrences(K_LARGE, 0))} SELECT {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows",
    "find_reversed": f"{_with(_GRAPH, _occurrences(K_SMALL, 1))} SELECT {_hash('reverse(s)')} AS kmer, start_node AS node_id, p::INT AS start_position, 0 AS kmer_position FROM occ",
    "found_kmer_text": f"{_with(_GRAPH, _occurrences(K_SMALL, 1))} SELECT {_hash('s')} || chr(9) || node_id || ':' || start_position || ':' || kmer_position AS value FROM rows",
    "kmer_frequency_index": f"{_K31} SELECT {_hash('s')} AS kmer, frequency FROM (SELECT s, count(*) AS frequency FROM occ GROUP BY s)",
    "spanning_frequency_index": f"{_K5} SELECT {_hash('s')} AS kmer, frequency FROM (SELECT s, count(*) AS frequency FROM rows GROUP BY s)",
    "spanning_node": f"{_K31} SELECT {_hash('s')} AS kmer FROM occ WHERE list_contains(path, 21)",
    "variant_kmers": f"""
        {_with(_GRAPH, _occurrences(K_PAIRS, BUDGET))},
        side AS (SELECT site AS pair_id, 'ref' AS side, site * 2 AS centre FROM site WHERE alt IS NOT NULL UNION ALL SELECT site, 'var', site * 2 + 1 FROM site WHERE alt IS NOT NULL)
        SELECT pair_id, side, {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows JOIN side ON node_id = centre
    """,
    "kmer_windows": f"""
        {_windows_sql()} SELECT pair_id, side, node_id, "window", start_position, kmer_position, max_frequency, (i - 1)::INT AS ord, kmers[i] AS kmer
        FROM (SELECT *, unnest(range(1, len(kmers) + 1)) AS i FROM windows)
    """,
    "window_pairs_aligned": f"""
        {_aligned_sql()} SELECT pair_id, ref_window, var_window, max_frequency, hypotenuse_frequency, coalesce(overlap, 0)::BIGINT AS overlap
        FROM aligned LEFT JOIN overlap_counts USING (pair_id, ref_window, var_window)
    """,
    "signatures_unaligned": _signature_sql(False, False) + "," + _TAIL,
    "signatures_unaligned_min_overlap": _signature_sql(True, False) + "," + _TAIL,
    "signatures_aligned": _signature_sql(False, True) + "," + _TAIL,
    "signatures_aligned_min_overlap": _signature_sql(True, True) + "," + _TAIL,
    "signatures_large_unaligned_min_overlap": _signature_sql(True, False, K_LARGE) + "," + _TAIL,
    "signatures_large_aligned_min_overlap": _signature_sql(True, True, K_LARGE) + "," + _TAIL,
    "signatures_given_frequencies": _signature_sql(
        False, False, freq=f"""SELECT s, count(*) AS n FROM (SELECT substring(t, p, {K_PAIRS}) AS s FROM (SELECT t, unnest(range(1, length(t) - {K_PAIRS - 2})) AS p
                                FROM (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS t FROM documents) WHERE length(t) >= {K_PAIRS})) GROUP BY s"""
    ) + "," + _TAIL,
    "signatures_wrapper": _signature_sql(True, False, K_LARGE, item=_hash("reverse(s)")) + "," + _TAIL,
    "signature_text": _signature_sql(False, False, item="s")
    + """ SELECT pair_id, coalesce(array_to_string(reference_kmers, ','), '') AS reference, coalesce(array_to_string(variant_kmers, ','), '') AS variant, max_frequency
          FROM pair LEFT JOIN best USING (pair_id)""",
    "find_spanning_large": f"{_K31} SELECT {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows",
    "find_compacted": f"{_with(_LONG, _occurrences(K_LARGE, BUDGET))} SELECT {_hash('s')} AS kmer, start_node AS node_id, p::INT AS start_position, 0 AS kmer_position FROM occ",
    "find_compacted_spanning": f"{_with(_LONG, _occurrences(K_LARGE, BUDGET))} SELECT {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows",
    "find_one_node": f"{_K31} SELECT {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows WHERE node_id = 21",
    "variant_kmers_large": f"""
        {_K31},
        side AS (SELECT site AS pair_id, 'ref' AS side, site * 2 AS centre FROM site WHERE alt IS NOT NULL UNION ALL SELECT site, 'var', site * 2 + 1 FROM site WHERE alt IS NOT NULL)
        SELECT pair_id, side, {_hash('s')} AS kmer, node_id, start_position, kmer_position FROM rows JOIN side ON node_id = centre
    """,
    "encoding_check": """
        SELECT p_partkey, name, length(name) = 4 AND contains(upper(name), 'A') AND contains(upper(name), 'C') AND contains(upper(name), 'G') AND contains(upper(name), 'T') AS valid
        FROM (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')[1:3] || CASE WHEN p_partkey % 2 = 0 THEN 't' WHEN p_partkey % 3 = 0 THEN 'AC' ELSE 'G' END AS name FROM part)
    """,
    "describe_nodes": f"""
        WITH {_GRAPH} SELECT node_id, seq, is_ref, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY out_ord) FROM edges WHERE src = node_id), '') AS out_nodes,
        coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY in_ord) FROM edges WHERE dst = node_id), '') AS in_nodes FROM nodes
    """,
    "get_nodes": f"WITH {_GRAPH} SELECT * FROM nodes WHERE NOT is_ref",
    "base_codes": f"""
        WITH {_GRAPH} SELECT node_id, CASE WHEN node_id % 7 < length THEN translate(substring(seq, (node_id % 7 + 1)::INT, 1), 'ACGT', '0123')::INT END AS code FROM nodes
    """,
    "required_empty_node_count": """
        WITH RECURSIVE edge AS (SELECT p_partkey AS src, d AS dst FROM part, LATERAL (VALUES (p_partkey * 2), (p_partkey * 2 + 1), (p_partkey * 3)) t(d) WHERE d > p_partkey AND d IN (SELECT p_partkey FROM part)),
        root AS (SELECT min(p_partkey) AS i FROM part WHERE p_partkey NOT IN (SELECT dst FROM edge)), last AS (SELECT min(p_partkey) AS i FROM part WHERE p_partkey NOT IN (SELECT src FROM edge)),
        walk(i, d) AS (SELECT i, 0 FROM root UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edge e ON e.src = w.i)
        SELECT coalesce(max(d) - min(d), 0)::BIGINT AS n FROM walk WHERE i = (SELECT i FROM last)
    """,
    "required_empty_node_count_chain": f"""
        WITH RECURSIVE {_LONG},
        root AS (SELECT min(node_id) AS i FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)), last AS (SELECT min(node_id) AS i FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)),
        walk(i, d) AS (SELECT i, 0 FROM root UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.i)
        SELECT coalesce(max(d) - min(d), 0)::BIGINT AS n FROM walk WHERE i = (SELECT i FROM last)
    """,
    "edge_list_graph": f"""
        WITH RECURSIVE {_CHAINS} SELECT i AS node_id, seq, is_ref, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY out_ord) FROM edge WHERE src = i), '') AS out_nodes,
        coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM edge WHERE dst = i), '') AS in_nodes FROM bits
    """,
    "code_table_graph": f"""
        WITH RECURSIVE {_CHAINS} SELECT i AS node_id, translate(seq, 'ACGT', '{ENCODING}') AS seq, is_ref, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY out_ord) FROM edge WHERE src = i), '') AS out_nodes,
        coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM edge WHERE dst = i), '') AS in_nodes FROM bits
    """,
    "binary_round_trip": f"""
        WITH RECURSIVE {_CHAINS},
        whole AS (SELECT new_id, string_agg(seq, '' ORDER BY n) AS seq, arg_min(is_ref, n) AS is_ref FROM located JOIN bits USING (i) GROUP BY new_id),
        outer_edge AS (SELECT a.new_id AS src, b.new_id AS dst, out_ord FROM edge JOIN located a ON a.i = src JOIN located b ON b.i = dst WHERE NOT (a.head = b.head AND b.n = a.n + 1))
        SELECT new_id AS node_id, seq, is_ref, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY out_ord) FROM outer_edge WHERE src = new_id), '') AS out_nodes,
        coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM outer_edge WHERE dst = new_id), '') AS in_nodes FROM whole
    """,
    "extended_nodes": f"""
        WITH {_GRAPH} SELECT * FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY site), '', 0, false, NULL FROM site WHERE site % 10 = 0
    """,
    "extended_edges": f"""
        WITH {_GRAPH} SELECT * FROM edges UNION ALL SELECT site * 2, site * 2 + 4, (SELECT count(*) FROM edges WHERE src = site * 2)::INT, (SELECT count(*) FROM edges WHERE dst = site * 2 + 4)::INT
        FROM site WHERE site % 10 = 0 AND site + 2 IN (SELECT site FROM site)
    """,
    "gfa_dense_nodes": f"""
        WITH RECURSIVE {_CHAINS} SELECT i - (SELECT min(i) FROM bits) AS node_id, seq, length(seq)::INT AS length, is_ref, CASE WHEN is_ref THEN 0::BIGINT END AS ref_index FROM bits
    """,
    "in_edges_degrees": f"""
        WITH {_GRAPH} SELECT node_id, (SELECT count(*) FROM edges WHERE src = node_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = node_id) AS in_degree,
        coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY in_ord) FROM edges WHERE dst = node_id), '') AS in_nodes FROM nodes
    """,
    "root_last_nodes": f"""
        WITH {_GRAPH} SELECT 'root' AS what, min(node_id) AS node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
        UNION ALL SELECT 'last', min(node_id) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)
        UNION ALL SELECT 'chromosome_start', min(node_id) FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges) AND node_id IN (SELECT src FROM edges)
        UNION ALL SELECT 'reference_7', node_id FROM nodes WHERE is_ref AND ref_index = 7
    """,
    "edge_and_parent": f"""
        WITH {_GRAPH}, wide AS (SELECT dst FROM edges GROUP BY dst HAVING count(*) > 1)
        SELECT site * 2 AS a, site * 2 + 3 AS b, EXISTS (SELECT 1 FROM edges WHERE src = site * 2 AND dst = site * 2 + 3) AS has_edge,
               EXISTS (SELECT 1 FROM edges WHERE dst = site * 2) AS has_parent, (SELECT count(*) FROM edges WHERE src = site * 2 AND dst IN (FROM wide)) AS n FROM site
    """,
    "graph_arrays": f"""
        WITH {_GRAPH} SELECT node_id, length, array_to_string(string_split(translate(seq, 'ACGT', '0123'), ''), ',') AS codes,
        coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY out_ord) FROM edges WHERE src = node_id), '') AS edges, is_ref, is_ref AND length > 0 AS is_nonempty_ref FROM nodes
    """,
    "next_reference": f"WITH {_GRAPH} SELECT a.node_id, min(b.node_id) AS next_id FROM nodes a JOIN edges ON src = a.node_id JOIN nodes b ON dst = b.node_id WHERE a.is_ref AND b.is_ref AND b.ref_index = a.ref_index + 1 GROUP BY 1",
    "compress_nodes": f"""
        WITH RECURSIVE {_CHAINS},
        whole AS (SELECT new_id, string_agg(seq, '' ORDER BY n) AS seq, arg_min(is_ref, n) AS is_ref, head FROM located JOIN bits USING (i) GROUP BY new_id, head)
        SELECT new_id AS node_id, seq, length(seq)::INT AS length, is_ref, CASE WHEN is_ref THEN row_number() OVER (PARTITION BY is_ref ORDER BY head) - 1 END AS ref_index FROM whole
    """,
    "compress_edges": f"""
        WITH RECURSIVE {_CHAINS} SELECT a.new_id AS src, b.new_id AS dst, out_ord, in_ord FROM edge JOIN located a ON a.i = src JOIN located b ON b.i = dst
        WHERE NOT (a.head = b.head AND b.n = a.n + 1)
    """,
    "add_empty_nodes": f"""
        WITH {_GRAPH}, ref AS (SELECT node_id, ref_index FROM nodes WHERE is_ref),
        link AS (SELECT a.node_id AS src, b.node_id AS dst, step - 1 AS out_ord, step FROM ref a, (VALUES (1), (2)) t(step), ref b
                 WHERE (step = 1 OR a.ref_index % 4 = 0) AND b.ref_index = a.ref_index + step),
        listed AS (SELECT *, (row_number() OVER (PARTITION BY dst ORDER BY src, out_ord) - 1)::INT AS in_ord FROM link),
        mid AS (SELECT *, (SELECT max(node_id) FROM ref) + row_number() OVER (ORDER BY src, dst) AS m FROM listed WHERE step = 2)
        SELECT src, dst, out_ord, in_ord FROM listed WHERE step = 1 UNION ALL SELECT src, m, out_ord, 0 FROM mid UNION ALL SELECT m, dst, 0, in_ord FROM mid
    """,
    "gfa_nodes": f"""
        WITH {_GRAPH} SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, seq, length, is_ref, CASE WHEN is_ref THEN ref_index % 100 END AS ref_index FROM nodes
    """,
    "gfa_edges": f"""
        WITH {_GRAPH}, ids AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM nodes)
        SELECT a.i AS src, b.i AS dst, out_ord, in_ord FROM edges JOIN ids a ON a.node_id = src JOIN ids b ON b.node_id = dst
    """,
    "vcf_normalize": f"WITH {_VCF} SELECT row_id, chrom, pos, ref, alts FROM variant",
    "vcf_structural_filter": f"WITH {_VCF} SELECT row_id, chrom, pos, ref, alt, structural FROM judged",
    "kept_variants": f"WITH RECURSIVE {_VCF}, {_KEPT} SELECT chrom, pos, row_id, ref, alts FROM kept",
}

_CONTIGS = """
    letters AS (SELECT c, p_partkey AS i, translate(md5(c || '-' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM part, (VALUES (1), (2), (3)) t(c)),
    contig AS (SELECT c::INT AS chrom, string_agg(CASE WHEN i % 5 = 0 THEN lower(b) WHEN i % 11 = 0 THEN b || 'Nn' ELSE b END, '' ORDER BY i) AS seq FROM letters GROUP BY c)
"""


def _pieces_sql(which: str) -> str:
    return f"""
        WITH {_CONTIGS} SELECT (chrom - 1) * ((SELECT count(*) FROM part) + 1) AS contig, chrom || ' contig' AS name, chrom, length(seq)::BIGINT AS n, i AS piece,
        md5(substring(seq, (i * {fasta.PIECE} + 1)::INT, {fasta.PIECE})) AS text
        FROM (SELECT *, unnest(range(0, (length(seq) - 1) // {fasta.PIECE} + 1)) AS i FROM contig) WHERE {which}
    """


_MERGED = f"""
    {_VCF}, {_KEPT}, {_CONTIGS},
    site AS (SELECT k.*, coalesce(lag(pos + length(ref)) OVER w, 0) AS prev, row_number() OVER w AS site, string_split(alts, ',') AS alt_list
             FROM kept k WINDOW w AS (PARTITION BY chrom ORDER BY pos, row_id)),
    tail AS (SELECT c.chrom, coalesce(max(s.site), 0) + 1 AS site, coalesce(max(s.pos + length(s.ref)), 0) AS start, length(c.seq) AS n FROM contig c LEFT JOIN site s USING (chrom) GROUP BY c.chrom, c.seq),
    piece AS (SELECT chrom, site, 0 AS part, prev AS start, pos - prev AS size FROM site WHERE pos > prev
              UNION ALL SELECT chrom, site, 1, pos, length(ref) FROM site
              UNION ALL SELECT chrom, site, 0, start, n - start FROM tail WHERE n > start),
    entry AS (SELECT chrom, site, part, substring(seq, (start + 1)::INT, size::INT) AS seq, true AS is_ref FROM piece JOIN contig USING (chrom)
            UNION ALL SELECT chrom, site, 1 + unnest(range(1, len(alt_list) + 1)), unnest(alt_list), false FROM site),
    numbered AS (SELECT *, row_number() OVER (ORDER BY chrom, site, part) - 1 AS node_id, sum(is_ref::INT) OVER (ORDER BY chrom, site, part) - 1 AS r, site * 2 + (part > 0)::INT AS step FROM entry),
    follow AS (SELECT chrom, step, lead(step) OVER (PARTITION BY chrom ORDER BY step) AS next FROM (SELECT DISTINCT chrom, step FROM numbered))
"""

ORACLES |= {
    "stored_graph": ORACLES["describe_nodes"],
    "stored_index": ORACLES["kmer_frequency_index"],
    "stored_index_signatures": ORACLES["signatures_unaligned_min_overlap"],
    "gfa_compressed_nodes": ORACLES["compress_nodes"],
    "command_line": f"WITH RECURSIVE {_MERGED} SELECT count(*) AS n_nodes FROM numbered",
    "fasta_pieces": _pieces_sql("true"),
    "fasta_chromosome": _pieces_sql("chrom = 2"),
    "indexed_fasta_chromosome": _pieces_sql("chrom = 2"),
    "indexed_vcf_chromosome": f"WITH {_VCF} SELECT row_id + 2 AS row_id, chrom, pos, ref, alts FROM variant WHERE chrom = 3",
    "indexed_gfa_nodes": ORACLES["gfa_nodes"],
    "line_index": """
        SELECT c::INT AS chrom, (c - 1) * (count(*) + 1) AS first_line, sum(33 + CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 11 = 0 THEN 4 ELSE 0 END)::BIGINT + 10 AS n_bytes
        FROM part, (VALUES (1), (2), (3)) t(c) GROUP BY c
    """,
    "fasta_contigs": f"""
        WITH {_CONTIGS} SELECT (chrom - 1) * ((SELECT count(*) FROM part) + 1) AS contig, chrom || ' contig' AS name, chrom, md5(seq) AS seq_md5, length(seq) AS length FROM contig
    """,
    "fasta_vcf_nodes": f"WITH RECURSIVE {_MERGED} SELECT node_id, seq, length(seq)::INT AS length, is_ref, CASE WHEN is_ref THEN r::BIGINT END AS ref_index FROM numbered",
    "fasta_vcf_edges": f"""
        WITH RECURSIVE {_MERGED} SELECT a.node_id AS src, b.node_id AS dst, (row_number() OVER (PARTITION BY a.node_id ORDER BY b.node_id) - 1)::INT AS out_ord,
        (row_number() OVER (PARTITION BY b.node_id ORDER BY a.node_id) - 1)::INT AS in_ord
        FROM numbered a JOIN follow f ON f.chrom = a.chrom AND f.step = a.step JOIN numbered b ON b.chrom = a.chrom AND b.step = f.next
    """,
}
