"""Stored indexes, counts of asked k-mers, and signatures at all settings of (k, M)."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from kmerloom.api import KmerFinder
from kmerloom.functions.kmers import hash_text
from kmerloom.operators import frequency, occurrences, superkmers
from kmerloom.plans.lineage import new_path
from kmerloom.sources import store
from kmerloom.sources.literals import from_lists


def bubbles(rnd, sites, sizes=(1, 3, 8, 20)):
    """Reference nodes in a row, every other one with a variant, some of them empty, beside it; their pairs."""
    seqs, edges, ref, pairs, before = [], [], [], [], []
    for site in range(sites):
        own = [len(seqs)]
        ref.append(len(seqs))
        seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.choice(sizes))))
        edges.append([])
        if site % 2:
            own.append(len(seqs))
            pairs.append((site, own[0], own[1]))
            seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 1, 2, 5]))))
            edges.append([])
        for v in before:
            edges[v] = list(own)
        before = own
    return seqs, edges, ref, pairs


@pytest.fixture(scope="module")
def graph(spark):
    own = bubbles(random.Random(21), 24)
    return from_lists(spark, own[0], own[1], ref=own[2]), own


def brute_signatures(own, k, most):
    """Unaligned signatures with least overlap, with the graph's own counts, from all paths; lists as multisets."""
    seqs, edges, ref, pairs = own
    found = brute.occurrences(seqs, edges, ref, k, most)
    count = Counter(x for _, _, x in found)
    out = {}
    for pair, a, b in pairs:
        sides = []
        for node in (a, b):
            windows = {}
            for path, p, x in found:
                offset = 0
                for i, v in enumerate(path):
                    if v == node:
                        windows.setdefault((p, 0) if i == 0 else (0, offset - p), []).append(x)
                    offset += len(seqs[v])
            sides.append(windows)
        best = []
        for mine, other in (sides, sides[::-1]):
            totals = Counter(x for w in other.values() for x in w)
            best.append(min(((sum(totals[x] for x in w), max(count[x] for x in w)) for w in mine.values()), default=None))
        out[pair] = (sides, best)
    return out


@pytest.mark.parametrize("k,most", [(4, 4), (8, 8), (12, 12), (16, 16), (31, 31)])
def test_signatures_at_many_settings(spark, graph, k, most):
    """Each side's k-mers are a window of least (overlap, frequency); their frequencies add up."""
    made, own = graph
    pairs = spark.createDataFrame(own[3], "pair_id long, ref_node long, var_node long")
    got = {r.pair_id: r for r in KmerFinder(made, k).find_variant_signatures(pairs, max_variant_nodes=most, minimize_overlaps=True).collect()}
    want = brute_signatures(own, k, most)
    count = Counter(x for _, _, x in brute.occurrences(*own[:3], k, most))
    assert set(got) == set(want)
    for pair, (sides, best) in want.items():
        row = got[pair]
        for kmers, windows, other, top in zip((row.reference_kmers, row.variant_kmers), sides, sides[::-1], best, strict=True):
            if top is None:
                assert kmers == []
                continue
            fits = [w for w in windows.values() if sorted(map(hash_text, w)) == sorted(kmers)]
            totals = Counter(x for w in other.values() for x in w)
            assert any((sum(totals[x] for x in w), max(count[x] for x in w)) == top for w in fits)
        if None not in best:
            assert row.max_frequency == best[0][1] + best[1][1]


def test_asked_kmers_only(spark, graph, monkeypatch):
    """Few asked k-mers: their counts are right, and far fewer bases go into the count."""
    made, own = graph
    walked = occurrences.walk(made, 15, 3, paths=False)
    rows = occurrences.find(made, 15, True, 3, node_id=own[3][2][2])
    whole = dict(map(tuple, frequency.walk_counts(walked).collect()))
    some = dict(map(tuple, frequency.asked_counts(walked, rows).collect()))
    asked = {r.kmer for r in rows.collect()}
    assert asked and asked <= set(some)
    assert all(whole[h] == n for h, n in some.items())
    assert len(some) < len(whole) / 3

    sent = []
    binned = superkmers.binned_stretches
    monkeypatch.setattr(superkmers, "binned_stretches", lambda *a: sent.append(binned(*a)) or sent[-1])
    for one in (frequency.walk_counts(walked), frequency.asked_counts(walked, rows)):
        one.count()
    size = [df.agg(F.sum(F.octet_length("bases"))).first()[0] for df in sent]
    assert size[1] < size[0] / 2

    monkeypatch.setattr(superkmers, "LEAST_BITS", 64)  # a full filter lets all through, and nothing is wrong
    monkeypatch.setattr(superkmers, "MOST_BITS", 64)
    full = dict(map(tuple, frequency.asked_counts(walked, rows).collect()))
    assert asked <= set(full) and all(whole[h] == n for h, n in full.items())
    none = frequency.asked_counts(walked, rows.where("kmer < 0"))
    assert none.collect() == []


def test_stored_index(spark, graph):
    made, own = graph
    pairs = spark.createDataFrame(own[3], "pair_id long, ref_node long, var_node long")
    path = new_path(spark, "index")
    finder = KmerFinder(made, 13)
    counts = finder.create_frequency_index(3, set_index=False)
    want = sorted(map(tuple, counts.collect()))
    store.write_index(counts, path, 13, buckets=6)
    assert sorted(map(tuple, store.read_index(spark, path, 13).collect())) == want
    store.forget_index(spark, path)  # as in a session that has not written it
    own_index = store.read_index(spark, path, 13)
    assert sorted(map(tuple, own_index.collect())) == want
    with pytest.raises(ValueError):
        store.read_index(spark, path, 14)
    finder.use_stored_index(path)
    got = sorted(map(str, finder.find_variant_signatures(pairs, max_variant_nodes=3).collect()))
    assert got == sorted(map(str, KmerFinder(made, 13).find_variant_signatures(pairs, max_variant_nodes=3).collect()))
    store.write_index(counts.limit(5), path, 13)  # written again
    assert store.read_index(spark, path, 13).count() == 5


def test_stored_index_is_joined_where_it_lies(spark, graph):
    """No exchange of the index, also where Spark would not broadcast it."""
    made, _ = graph
    path = new_path(spark, "index")
    store.write_index(frequency.frequency_index(made, 13, 2), path, 13)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = frequency.with_frequency(occurrences.find(made, 13, max_variant_nodes=2), store.read_index(spark, path, 13))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    right = plan[plan.index("SortMergeJoin") :]
    index_side = right[right.rindex("FileScan", 0, right.index("Bucketed: true")) - 400 : right.index("Bucketed: true")]
    assert plan.count("Exchange hashpartitioning(kmer") == 1, index_side
