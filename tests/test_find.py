import random

import brute
import pytest

from kmerloom.api import KmerFinder
from kmerloom.functions.kmers import hash_text
from kmerloom.operators import unitigs
from kmerloom.operators.frequency import frequency_index
from kmerloom.operators.occurrences import find, walk
from kmerloom.sources.literals import from_lists

# The graphs T and U, and the first three of GRAPHS with their row counts, have known results.
T = (["ACTGACTGACTG", "G", "T", "AT", "ACT", "CTA", "CTGCTTTTTTTT"], [[1, 2], [3], [3], [4, 5], [6], [6], []], [0, 1, 3, 4, 6])
U = (["ACTGACTGACTG", "G", "", "AT", "AACTG", "CTA", "CTGCTTTTTTTT"], *T[1:])


def collected(df):
    return sorted(tuple(r) for r in df.collect())


GRAPHS = [
    (["ACTG", "ACTA"], [[1], []], [0, 1], 3, 4),
    (["ACT", "", "A", "GCA"], [[1, 2], [3], [3], []], [0, 1], 3, 4),
    (
        ["AC", "G", "", "", "", "A", "G", "T", "", "", "A", "C", "GT"],
        [[1, 2], [3], [3], [4, 5], [6], [6], [7, 8], [9], [9], [10, 11], [12], [12], []],
        [0, 1, 3, 4, 6, 7, 9, 10, 12],
        3,
        10,
    ),
    (["ACGT", "A", "C"], [[1, 2], [2, 0], []], [0, 2], 5, 1),  # a skip edge and a cycle
    (["ACGT", "GG"], [[1], []], None, 1, 0),
]


@pytest.mark.parametrize("seqs,edges,ref,k,most", GRAPHS)
def test_find_matches_brute_force(spark, seqs, edges, ref, k, most):
    finder = KmerFinder(from_lists(spark, seqs, edges, ref=ref), k)
    for spanning in (False, True):
        assert collected(finder.find(spanning, most)) == brute.rows(seqs, edges, ref, k, most, spanning)


def layered(rnd, layers, sizes, skip=0.2):
    """A graph drawn layer by layer: one to three nodes each, edges to some of the next layer and over it, some nodes empty."""
    seqs, edges, before = [], [], []
    for _ in range(layers):
        own = list(range(len(seqs), len(seqs) + rnd.randint(1, 3)))
        for v in own:
            seqs.append("".join(rnd.choice("ACGTn") for _ in range(rnd.choice(sizes))))
            edges.append([])
        for v in before:
            edges[v] += rnd.sample(own, rnd.randint(1, len(own)))
            if v >= 2 and rnd.random() < skip:
                edges[v - 2] += [x for x in own[:1] if x not in edges[v - 2]]
        before = own
    ref = [v for v in range(len(seqs)) if rnd.random() < 0.7]
    return seqs, edges, ref


@pytest.mark.parametrize("seed,layers,sizes,k,most", [(1, 7, [0, 1, 2, 3], 6, 3), (2, 4, [0, 2, 70, 130], 5, 2), (3, 9, [0, 0, 1, 4], 4, 255), (4, 5, [31, 32, 33, 64], 31, 1)])
def test_drawn_graphs(spark, seed, layers, sizes, k, most):
    seqs, edges, ref = layered(random.Random(seed), layers, sizes)
    finder = KmerFinder(from_lists(spark, seqs, edges, ref=ref), k)
    for spanning in (False, True):
        assert collected(finder.find(spanning, most)) == brute.rows(seqs, edges, ref, k, most, spanning)


def chained(rnd, chains):
    """Chains of up to 40 nodes, many of them empty, that lead to the next one or two; a variant node now and then."""
    seqs, edges, heads, ref = [], [], [], []
    for _ in range(chains):
        heads.append(len(seqs))
        size = rnd.choice([1, 2, 10, 40])
        for i in range(size):
            seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 0, 1, 2]))))
            edges.append([len(seqs)] if i + 1 < size else [])
            if size > 1 or rnd.random() < 0.5:
                ref.append(len(seqs) - 1)
    ends = [h - 1 for h in heads[1:]] + [len(seqs) - 1]
    for i, end in enumerate(ends):
        edges[end] = heads[i + 1 : i + 3]
    return seqs, edges, ref


@pytest.mark.parametrize("seed,k,most", [(1, 7, 2), (2, 2, 1), (3, 12, 255), (4, 1, 0)])
def test_unitigs_give_the_same_rows(spark, monkeypatch, seed, k, most):
    monkeypatch.setattr(unitigs, "PIECE", 8)  # unitigs of many pieces
    seqs, edges, ref = chained(random.Random(seed), 12)
    graph = from_lists(spark, seqs, edges, ref=ref)
    units = unitigs.unitigs(graph, k)
    for spanning in (False, True):
        assert collected(find(graph, k, spanning, most, units=units)) == brute.rows(seqs, edges, ref, k, most, spanning)
    one = len(seqs) // 2
    assert collected(find(graph, k, True, most, node_id=one, units=units)) == [r for r in brute.rows(seqs, edges, ref, k, most, True) if r[1] == one]


def test_unitigs_need_fewer_rounds(spark):
    seqs, edges = ["A", *["CG"[i % 2] for i in range(60)], "T", "G", "TT"], [[i + 1] for i in range(63)] + [[]]
    edges[60] = [61, 62]
    edges[61] = [63]
    graph = from_lists(spark, seqs, edges)
    units = unitigs.unitigs(graph, 31)
    assert len(walk(graph, 31, units=units).grown) == 1 < len(walk(graph, 31).grown)
    assert collected(find(graph, 31, units=units)) == brute.rows(seqs, edges, None, 31, 255, False)


def test_rows_of_one_node(spark):
    seqs, edges, ref, k, most = GRAPHS[1]
    finder = KmerFinder(from_lists(spark, seqs, edges, ref=ref), k)
    for spanning in (False, True):
        for node in range(len(seqs)):
            assert collected(finder.find(spanning, most, node)) == [r for r in brute.rows(seqs, edges, ref, k, most, spanning) if r[1] == node]


def test_counts_of_small_golden_graphs(spark):
    sizes = [KmerFinder(from_lists(spark, s, e, ref=r), k).find(True, m).count() for s, e, r, k, m in GRAPHS[:3]]
    assert sizes == [8, 15, 113]


def test_random_bubble_chains(spark):
    rnd = random.Random(5)
    for _ in range(3):
        seqs, edges, ref, ends = [], [], [], []
        for site in range(5):
            own = []
            for allele in range(1 + site % 2 * rnd.randint(0, 2)):
                own.append(len(seqs))
                seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 1, 2, 6]))))
                edges.append([])
                if not allele:
                    ref.append(own[-1])
            for e in ends:
                edges[e] += own
            if site and rnd.random() < 0.3:
                edges[0].append(own[0]) if own[0] not in edges[0] else None
            ends = own
        k, most = rnd.randint(2, 6), rnd.randint(0, 3)
        assert collected(KmerFinder(from_lists(spark, seqs, edges, ref=ref), k).find(True, most)) == brute.rows(seqs, edges, ref, k, most, True)


def test_reverse_kmers(spark):
    seqs, edges, ref, k, most = GRAPHS[1]
    want = sorted(hash_text(kmer[::-1]) for _, _, kmer in brute.occurrences(seqs, edges, ref, k, most))
    assert sorted(r.kmer for r in KmerFinder(from_lists(spark, seqs, edges, ref=ref), k, reverse_kmers=True).find(False, most).collect()) == want


def test_frequency_index_of_the_small_graph(spark):
    graph = from_lists(spark, T[0], T[1], ref=T[2])
    spanning = {r.kmer: r.frequency for r in frequency_index(graph, 4, 31, True).collect()}
    initial = {r.kmer: r.frequency for r in frequency_index(graph, 4, 31).collect()}
    for kmer, a, b in (("ACTG", 5, 4), ("CTGG", 2, 1), ("ATAC", 2, 1), ("AAAA", 0, 0), ("CTGC", 1, 1)):
        assert (spanning.get(hash_text(kmer), 0), initial.get(hash_text(kmer), 0)) == (a, b)


def test_spanning_node_and_variant_kmers(spark):
    graph = from_lists(spark, T[0], T[1], ref=T[2])
    finder = KmerFinder(graph, 5)
    for pair, want in (((1, 2), "TGTAT GATAC GATCT ACTGT TGGAT"), ((4, 5), "ACTCT CTACT GATAC TATCT TCTAC GTATA")):
        pairs = spark.createDataFrame([(0, *pair)], "pair_id long, ref_node long, var_node long")
        own = [r.kmer for r in finder.find_kmers_for_variants(pairs).collect()]
        for kmer in want.split():
            assert own.count(hash_text(kmer)) == 1, kmer
        each = [r.kmer for n in pair for r in finder.find_kmers_spanning_node(n).collect()]
        assert sorted(each) == sorted(own)
        brute_rows = [hash_text(x) for path, _, x in brute.occurrences(*T, 5, 255) for n in pair if n in path]
        assert sorted(own) == sorted(brute_rows)


def test_cycle_of_empty_nodes_is_an_error(spark, monkeypatch):
    """It is found before the walk, in few rounds; a run of many empty nodes is no cycle and takes one step."""
    from kmerloom.operators import occurrences as O

    written = []
    monkeypatch.setattr(O, "cut", lambda df, what="step", own=O.cut: written.append(what) or own(df, what))
    graph = from_lists(spark, ["AC", *[""] * 40, "G"], [[1], *[[i + 2, *([41] if i == 20 else [])] for i in range(39)], [1], []])
    with pytest.raises(RuntimeError, match="cycle of empty nodes"):
        O.occurrences(graph, 4)
    assert "paths" not in written and len(written) < 20
    seqs, edges = ["ACG", *[""] * 40, "GTT"], [[1], *[[i + 2, *([41] if i == 20 else [])] for i in range(39)], [41], []]
    run = from_lists(spark, seqs, edges)
    assert len(walk(run, 6).grown) == 1
    assert collected(find(run, 6, True)) == brute.rows(seqs, edges, None, 6, 255, True)
    # variant nodes end by the limit, in a cycle too
    seqs, edges = ["AC", "", "", "GG"], [[1], [2], [1, 3], []]
    assert collected(find(from_lists(spark, seqs, edges, ref=[0, 3]), 3, True, 5)) == brute.rows(seqs, edges, [0, 3], 3, 5, True)


def test_bad_arguments(spark):
    graph = from_lists(spark, ["ACGT"], [[]])
    for k in (0, 32, "3", True):
        with pytest.raises(ValueError):
            KmerFinder(graph, k)
    with pytest.raises(ValueError):
        KmerFinder(graph, 3).find(max_variant_nodes=256)
    with pytest.raises(ValueError):
        from_lists(spark, ["AXGT"], [[]])
    with pytest.raises(ValueError):
        from_lists(spark, ["ACGT"], [[1]])
    with pytest.raises(ValueError):
        KmerFinder(graph, 3).find_variant_signatures([0], [])
