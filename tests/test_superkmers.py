import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.functions.kmers import hash_text
from kmerloom.operators import frequency, occurrences, superkmers
from kmerloom.sources.literals import from_lists


def brute(texts, k, weights=None, reverse=False, encoding="ACGT"):
    out = Counter()
    for i, t in enumerate(texts):
        for p in range(len(t or "") - k + 1):
            own = t[p : p + k].upper()
            if not set(own) - set("ACGTN"):
                out[hash_text(own[::-1] if reverse else own, encoding=encoding)] += weights[i] if weights else 1
    return dict(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    out += ["A" * 900, "A" * 901, "ACGT" * 100, "acgtnNGATTACA" * 20, "ACGTRYACGATTTTAGACCCATTAGACAT" * 5, None, "", "ACGT"] + [out[3]] * 30
    out.append("".join(rnd.choice("ACGT") for _ in range(80_000)))  # more than two pieces
    return out


def counted(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({k for k, _ in rows})
    return dict(rows)


@pytest.mark.parametrize("k,budget", [(31, 1 << 23), (31, 700), (12, 3000), (17, 1 << 12)])
def test_counts_equal_brute_force(spark, texts, k, budget):
    """Small budgets split heavy minimizers, such as that of a run of one base, over several bins."""
    df = spark.createDataFrame([(t, "x") for t in texts], "seq string, n string")
    assert counted(superkmers.superkmer_counts(df, k, budget=budget)) == brute(texts, k)


@pytest.mark.parametrize("budget", [1 << 23, 500])
def test_weights_order_and_encoding(spark, texts, budget):
    weights = [1 + i % 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, weights, strict=True)), "seq string, w int")
    assert counted(superkmers.superkmer_counts(df, 15, "CGAT", True, "w", budget)) == brute(texts, 15, weights, True, "CGAT")
    assert counted(frequency.sequence_counts(df, 6, "CGAT", True, "w")) == brute(texts, 6, weights, True, "CGAT")


def test_small_holds_and_empty_tables(spark, texts, monkeypatch):
    monkeypatch.setattr(superkmers, "HELD_BYTES", 2000)
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    assert counted(superkmers.superkmer_counts(df, 21, budget=5000)) == brute(texts, 21)
    assert superkmers.superkmer_counts(df.where("seq = ''"), 21).collect() == []
    with pytest.raises(ValueError):
        superkmers.superkmer_counts(df, 11)


def test_a_minimizer_meets_all_its_kmers(texts):
    """Equal k-mers have one minimizer wherever they stand, and stretches take fewer bytes than their k-mers."""
    own = [t.encode() for t in texts if t]
    table = superkmers.code_table("ACGT")
    codes, first, n, minimizer, text = superkmers.stretches(own, 31, table)
    kmers = occurrences.rolled(codes, 31)
    seen = {}
    for a, many, m in zip(first.tolist(), n.tolist(), minimizer.tolist(), strict=True):
        for h in kmers[a : a + many].tolist():
            assert seen.setdefault(h, m) == m
    assert sum(n) == sum(brute(texts, 31).values())
    data, sizes = superkmers._packed_runs(codes, first, n, 31)
    assert len(data) + 2 * len(n) < 8 * int(n.sum()) / 4
    assert int(np.bincount(text, minlength=len(own))[-1]) > 1000


def test_graph_counts_without_listing(spark):
    """Counts from the bases along paths equal those of the listed occurrences, at every node of a path too."""
    rnd = random.Random(2)
    seqs, edges = [], []
    for site in range(30):
        for _ in range(1 + site % 2):
            seqs.append("".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 1, 4, 20]))))
            edges.append([])
    starts = [0]
    for site in range(30):
        starts.append(starts[-1] + 1 + site % 2)
    for site in range(29):
        for v in range(starts[site], starts[site + 1]):
            edges[v] = list(range(starts[site + 1], starts[site + 2]))
    ref = [starts[site] for site in range(30)]
    graph = from_lists(spark, seqs, edges, ref=ref)
    for k, most in ((4, 2), (13, 3), (31, 4)):
        for spanning in (False, True):
            want = counted(frequency.kmer_counts(occurrences.find(graph, k, spanning, most)))
            assert counted(frequency.frequency_index(graph, k, most, spanning)) == want


def test_short_pieces_are_hashed_together():
    """Thousands of short sequences, such as the paths of a graph, are a few passes over arrays; a long one is cut off."""
    texts = [b"ACGTTGCA" * 5] * 9000 + [b"ACGT" * 8000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["piece", "weight"])
    own = list(superkmers._batches([batch.slice(0, 0), batch.slice(3)]))
    assert len(own) < 8 and max(len(data) for data, _, _ in own) < 2 * superkmers.BATCH
    assert b"".join(data.tobytes() for data, _, _ in own) == b"".join(texts[3:])
    assert np.concatenate([sizes for _, sizes, _ in own]).tolist() == [len(t) for t in texts[3:]]
    assert np.concatenate([weights for _, _, weights in own]).tolist() == list(range(3, len(texts)))


def test_a_bin_of_single_kmers_takes_little_memory():
    """A bin whose stretches are single k-mers is unpacked in parts: a hash of each of its bases would take 256 bytes a k-mer."""
    many, rnd = 1 << 17, np.random.default_rng(3)
    data = rnd.integers(0, 256, 8 * many, np.uint8)
    rows = pa.table({"n": [np.ones(many, np.uint16).tobytes()], "weights": pa.array([b""], pa.binary()), "bases": [data.tobytes()], "split": [False]})
    tracemalloc.start()
    kmers, n = superkmers.counts_of(rows, 31, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 * many
    codes = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], axis=1).reshape(-1, 32)[:, :31].astype(np.int64)
    want = Counter((codes * 4 ** np.arange(30, -1, -1)).sum(axis=1).tolist())
    assert dict(zip(kmers.tolist(), n.tolist(), strict=True)) == want


def test_bins_are_not_drawn_into_one_task(spark, texts):
    """Packed bins are few bytes and much work; Spark would read all of them in one task."""
    df = spark.createDataFrame([(t,) for t in texts[:40]], "seq string")
    own = superkmers.superkmer_counts(df, 21)
    assert own.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
