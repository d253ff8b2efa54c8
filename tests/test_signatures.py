import math
from collections import Counter
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F
from test_find import T, U

from kmerloom.api import KmerFinder, get_variant_signatures
from kmerloom.functions.kmers import hash_text
from kmerloom.operators.occurrences import kmers_over, paths_over, walk
from kmerloom.operators.signatures import _back_paths, aligned_signatures, kmer_windows, unaligned_signatures, window_pairs
from kmerloom.operators.superkmers import few_counts
from kmerloom.plans.lineage import shared_dir
from kmerloom.sources.literals import from_lists

# Frequencies and the signatures that follow from them.
SEVENS = "GATAC TATAC GATCT TATCT ATACT ATCTA TACTC TCTAC ACTCT CTACT CTCTG TACTG TCTGC ACTGC".split()
FIRST = {"GGATA": 2, "GTATA": 4, "GGATC": 2, "GTATC": 3} | dict.fromkeys(SEVENS, 7)
SECOND = FIRST | {"GTATA": 5, "ACTCT": 4, "CTACT": 3}


def hashed(words):
    return [hash_text(w) for w in words]


def signature(spark, graph, given, pair=(4, 5), **flags):
    finder = KmerFinder(graph, 5)
    finder.set_frequency_index({hash_text(a): n for a, n in given.items()})
    return finder.find_variant_signatures([pair[0]], [pair[1]], **flags).first()


def test_golden_signatures(spark):
    graph = from_lists(spark, T[0], T[1], ref=T[2])
    got = signature(spark, graph, FIRST)
    assert (got.reference_kmers, got.variant_kmers, got.max_frequency) == (hashed(["GGATA", "GTATA"]), hashed(["GGATC", "GTATC"]), 7)
    got = signature(spark, graph, SECOND)
    assert (got.reference_kmers, got.variant_kmers, got.max_frequency) == (hashed(["ACTCT"]), hashed(["CTACT"]), 7)
    assert math.isclose(got.hypotenuse_frequency, 5)


def test_golden_order_within_a_window(spark):
    graph = from_lists(spark, U[0], U[1], ref=U[2])
    sevens = {hash_text(x): 7 for _, _, x in brute.occurrences(*U, 5, 255)}
    given = sevens | {hash_text(a): n for a, n in {"GGATA": 2, "TGATA": 4, "GGATC": 2, "TGATC": 3}.items()}
    finder = KmerFinder(graph, 5)
    finder.set_frequency_index(given)
    got = finder.find_variant_signatures([4], [5]).first()
    assert (got.reference_kmers, got.variant_kmers, got.max_frequency) == (hashed(["GGATA", "TGATA"]), hashed(["GGATC", "TGATC"]), 7)


def _windows(spark):
    graph = from_lists(spark, T[0], T[1], ref=T[2])
    pairs = spark.createDataFrame([(0, 4, 5), (1, 1, 2)], "pair_id long, ref_node long, var_node long")
    freq = spark.createDataFrame([(hash_text(a), n) for a, n in FIRST.items()], "kmer long, frequency long")
    return graph, pairs, freq, kmer_windows(graph, 5, pairs, freq)


def _aligned(windows, lengths):
    """Window pairs of one pair by brute force: (ref window, var window)."""
    ref, var = ([w for w in windows if w.side == s] for s in ("ref", "var"))
    out = []
    for r in sorted(ref, key=lambda w: w.window):
        for v in sorted(var, key=lambda w: w.window):
            left = r.kmer_position - r.start_position == v.kmer_position - v.start_position
            right = r.start_position - lengths[0] - r.kmer_position == v.start_position - lengths[1] - v.kmer_position
            if left or right:
                out.append((r, v))
    return out


def test_windows_hold_the_occurrences(spark):
    _, _, _, windows = _windows(spark)
    for node in (4, 5, 1, 2):
        want = Counter((hash_text(x), p if i == 0 else 0) for path, p, x in brute.occurrences(*T, 5, 255) for i, n in enumerate(path) if n == node)
        got = Counter((h, r.start_position) for r in windows.where(f"node_id = {node}").collect() for h in r.kmers)
        assert got == want


def test_aligned_signatures_against_brute_force(spark):
    graph, pairs, freq, windows = _windows(spark)
    rows = windows.collect()
    finder = KmerFinder(graph, 5)
    finder.set_frequency_index(freq)
    assert {r.pair_id for r in window_pairs(graph, 5, windows).collect()} == {0, 1}
    for minimize in (False, True):
        got = {r.pair_id: r for r in finder.find_variant_signatures(pairs, minimize_overlaps=minimize, align_windows=True).collect()}
        for pair, a, b in ((0, 4, 5), (1, 1, 2)):
            own = _aligned([r for r in rows if r.pair_id == pair], (len(T[0][a]), len(T[0][b])))

            def overlap(i, own=own):
                r, v = own[i]
                return sum((x == y) for j, (r2, v2) in enumerate(own) if j != i for one, two in ((r, v2), (v, r2)) for x in one.kmers for y in two.kmers)

            best = min(range(len(own)), key=lambda i: (overlap(i) if minimize else 0, math.hypot(own[i][0].max_frequency, own[i][1].max_frequency), i))
            assert (got[pair].reference_kmers, got[pair].variant_kmers) == (own[best][0].kmers, own[best][1].kmers)


def test_pair_without_windows_keeps_its_row(spark):
    graph = from_lists(spark, ["AC", "G", "T"], [[1], [2], []])
    got = KmerFinder(graph, 9).find_variant_signatures([0], [1]).first()
    assert (got.reference_kmers, got.variant_kmers, got.max_frequency) == ([], [], None)


def test_each_limit_has_its_own_frequencies(spark):
    seqs, edges, ref = ["ACG", "A", "C", "G", "T", "GAT"], [[1, 2], [3, 4], [3, 4], [5], [5], []], [0, 1, 3, 5]
    graph = from_lists(spark, seqs, edges, ref=ref)
    finder = KmerFinder(graph, 3)
    for most in (1, 2, 1):
        got = finder.find_variant_signatures([1], [2], max_variant_nodes=most).first()
        assert got == KmerFinder(graph, 3).find_variant_signatures([1], [2], max_variant_nodes=most).first()
        want = Counter(hash_text(x) for _, _, x in brute.occurrences(seqs, edges, ref, 3, most))
        assert {r.kmer: r.frequency for r in finder.create_frequency_index(most, set_index=False).collect()} == want
    turned = KmerFinder(graph, 3, reverse_kmers=True).create_frequency_index(2)
    assert {r.kmer: r.frequency for r in turned.collect()} == Counter(hash_text(x[::-1]) for _, _, x in brute.occurrences(seqs, edges, ref, 3, 2))


def test_wrapper_reverses_keys_and_results(spark):
    graph = from_lists(spark, ["ACTG", "A", "G", "CCCC"], [[1, 2], [3], [3], []], ref=[0, 1, 3])
    pairs = spark.createDataFrame([(0, 1, 2)], "pair_id long, ref_node long, var_node long")
    given = {hash_text(x[::-1]): 1 + i for i, x in enumerate(sorted({x for _, _, x in brute.occurrences(["ACTG", "A", "G", "CCCC"], [[1, 2], [3], [3], []], [0, 1, 3], 3, 4)}))}
    got = get_variant_signatures(graph, pairs, given, 3).first()
    ref = {x[::-1] for path, _, x in brute.occurrences(["ACTG", "A", "G", "CCCC"], [[1, 2], [3], [3], []], [0, 1, 3], 3, 4) if 1 in path}
    assert set(got.reference_kmers) <= {hash_text(x) for x in ref} and got.reference_kmers
    assert got.max_frequency == max(given[x] for x in got.reference_kmers) + max(given[x] for x in got.variant_kmers)


def test_kmers_are_listed_for_paths(spark):
    """k-mers over long and short nodes, in both orders of their bases, against brute force; back keys as arrays and as numbers."""
    seqs, edges, ref = ["ACGTTGCA" * 9 + "G", "TTA", "", "CCGATAGT" * 5], [[1, 2], [3], [3], []], [0, 1, 3]
    graph = from_lists(spark, seqs, edges, ref=ref)
    centres = spark.createDataFrame([(0,), (2,), (3,)], "centre long")
    for k in (4, 31):
        paths = paths_over(walk(graph, k, 4), centres)
        assert all(len(r.seq) >= k for r in paths.collect())
        for reverse in (False, True):
            got = Counter((r.centre, r.start_position, r.kmer_position, r.p, r.kmer) for r in kmers_over(paths, k, reverse=reverse).collect())
            want = Counter()
            for path, p, x in brute.occurrences(seqs, edges, ref, k, 4):
                off = 0
                for i, n in enumerate(path):
                    if n in (0, 2, 3):
                        want[(n, p if i == 0 else 0, 0 if i == 0 else off - p, p, hash_text(x[::-1] if reverse else x))] += 1
                    off += len(seqs[n])
            assert got == want


def test_back_keys_as_numbers_and_as_arrays(spark):
    graph = from_lists(spark, T[0], T[1], ref=T[2])
    centres = graph.nodes.select(F.col("node_id").alias("centre"))
    starts = paths_over(walk(graph, 5, 4), centres).select("centre", "start_node").distinct()
    packed, whole = (_back_paths(graph, 5, starts, True, 100, p).orderBy("centre", "back_key").select("centre", "start_node").collect() for p in (True, False))
    assert packed == whole and len(whole) > 10


def test_short_kmers_are_added_up_in_tasks(spark):
    rows = spark.createDataFrame([("ACGTNACG", 2), ("ACXACGT", 3), ("AC", 5), (None, 1), ("ACGT" * 9000, 1)], "seq string, w long").coalesce(1)
    want = Counter()
    for r in rows.collect():
        s = (r.seq or "").replace("N", "A")
        for x in (s[i : i + 3] for i in range(len(s) - 2)):
            if "X" not in x:
                want[hash_text(x)] += r.w
    counted = few_counts(rows, 3, weight="w")
    assert dict(map(tuple, counted.collect())) == want
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]  # bases aren't moved


@pytest.mark.parametrize("align", [True, False])
def test_signatures_leave_their_result_only(spark, align):
    """A pair's windows are dealt once, and what is written on the way goes with the search."""
    graph, pairs, _, windows = _windows(spark)
    scored = aligned_signatures(window_pairs(graph, 5, windows), True) if align else unaligned_signatures(windows, True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning(pair_id" in x]
    assert len(wide) <= (3 if align else 1)  # aligned: the nodes of a pair and their lengths are narrow tables
    shared = Path(shared_dir(spark).removeprefix("file:"))
    tables = set(shared.iterdir())
    out = KmerFinder(graph, 5).find_variant_signatures(pairs, minimize_overlaps=True, align_windows=align)
    assert {x.name.split("-")[0] for x in set(shared.iterdir()) - tables} == {"best"} and out.count() == 2
