import re
from collections import Counter

import pytest
from conftest_llm import frame

from kmerloom.llm import simhash as S
from kmerloom.llm.components import connected_components
from kmerloom.llm.line_dedup import line_dedup
from kmerloom.llm.substring_dedup import COVERS, substring_dedup
from kmerloom.llm.suffix_dedup import suffix_dedup


def later_units(rows, split, length):
    """(units, marks) of each row, in order of (id, text)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        units = split(text)
        marks = [False] * len(units)
        for p in range(len(units) - length + 1):
            key = tuple(units[p : p + length])
            if key in seen:
                marks[p : p + length] = [True] * length
            seen.add(key)
        out.append((i, text, units, marks))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_covers_cover_every_difference():
    for period, own in COVERS.items():
        assert {(a - b) % period for a in own for b in own} == set(range(period))


@pytest.mark.parametrize("window", [5, 20])
def test_substring_dedup(spark, corpus, window):
    rows = [*corpus, (None, corpus[0][1]), (3, corpus[1][1]), corpus[2]]
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup(frame(spark, rows), window).collect())
    want = Counter((i, " ".join(w for w, m in zip(own, marks, strict=True) if not m), len(own), sum(marks)) for i, _, own, marks in later_units(rows, words, window))
    assert got == want
    assert sum(n for _, _, _, n in got) > 0


def test_substring_dedup_keeps_other_columns(spark, corpus):
    out = substring_dedup(frame(spark, corpus))
    assert out.columns == ["doc_id", "text", "lang", "_other", "n_words", "n_removed"]
    assert {r._other for r in out.collect()} == {f"v{k}" for k in range(len(corpus))}
    assert substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(frame(spark, corpus), 3)


def test_line_dedup(spark, corpus):
    rows = [*corpus, (None, "a\nb\nc\nd"), (None, "a\nb\nc"), corpus[4]]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(frame(spark, rows)).collect())
    want = Counter()
    for i, text, own, marks in later_units(rows, lambda t: [] if t is None else t.split("\n"), 3):
        want[(i, None if text is None else "\n".join(w for w, m in zip(own, marks, strict=True) if not m), len(own), sum(marks))] += 1
    assert got == want
    assert line_dedup(frame(spark, [])).count() == 0


def test_small_blocks_chunks_and_clashing_names(spark, corpus, monkeypatch):
    from kmerloom.llm import _common, _repeats

    monkeypatch.setattr(_repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(_repeats, "BUCKET_BYTES", 5000)
    rows = [*corpus, *[(None, f"{t} tail") for _, t in corpus[:9]], *[(4, t) for _, t in corpus[9:20]]]
    docs = frame(spark, rows).selectExpr("*", "'own' AS _blk", "1 AS _BLK_")
    old = _common.CHUNK_BYTES
    try:
        for limit in (old, 700):
            _common.CHUNK_BYTES = limit
            out = substring_dedup(docs, 5).collect()
            want = Counter((i, " ".join(w for w, m in zip(own, marks, strict=True) if not m), len(own), sum(marks)) for i, _, own, marks in later_units(rows, words, 5))
            assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out) == want and {(r._blk, r._BLK_) for r in out} == {("own", 1)}
            lines = Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup(docs).collect())
            assert lines == Counter((i, len(own), sum(marks)) for i, _, own, marks in later_units(rows, lambda t: [] if t is None else t.split("\n"), 3))
            short = [r for r in rows if r[0] != 126]
            got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame(spark, short).selectExpr("*", "1 AS _blk"), 30).collect())
            assert got == repeated_bytes(short, 30)
    finally:
        _common.CHUNK_BYTES = old


def test_line_dedup_windows_overlap(spark):
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "c\nd")])).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "c\nd"}


def repeated_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and (not p or not gone[p - 1]))
        out[(i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("length", [4, 30, 200])
def test_suffix_dedup(spark, corpus, length):
    rows = [*(r for r in corpus if r[0] != 126), (None, "é" * 40), (7, corpus[0][1]), corpus[1]]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame(spark, rows), length).collect())
    assert got == repeated_bytes(rows, length)


def test_suffix_dedup_of_small_alphabet_and_empty_table(spark):
    rows = [(i, "".join("ab"[(i * k * k // 3) % 2] for k in range(i))) for i in range(60)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame(spark, rows, False), 8).collect())
    assert got == repeated_bytes(rows, 8)
    assert suffix_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(frame(spark, rows), 7)


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300), (-5, 40), (400, 401), (401, 400)] + [(1000, 1000 + i) for i in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components([p for p in pairs if p[0] != p[1]], {n for p in pairs for n in p} - {300})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    for text in ("", None, " \n", "A bc", "a b c d e a b c", "É x y Z"):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert S.fingerprint(text) == sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] & (1 << 64) - 1 == S._hash("a b é".encode())


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("worth", [0.02, 1.0])
def test_links_connect_exactly_the_near_ones(spark, monkeypatch, distance, worth):
    import random

    rnd = random.Random(distance)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centres for _ in range(25)} | {0, 1, 3, 7, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(S, "WORTH", worth)  # 0.02: every meeting of three is split
    got = {r.node: r.root for r in connected_components(S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    want = components(near, signed)
    linked = {n for p in near for n in p}
    assert {n: got.get(n, n) for n in signed} == want and set(got) <= linked


def test_thresholds_by_dynamic_programming():
    costs = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 7, 1: 9}, {-1: 0, 0: 100, 1: 900}]
    assert S.allocate(costs, 0) == (14, [0, 1, -1])


def test_simhash_components(spark, corpus):
    rows = [*corpus, (None, corpus[0][1]), corpus[1], (1, corpus[3][1])]
    out = S.simhash_components(frame(spark, rows)).collect()
    fps = [S.fingerprint(t) for _, t in rows]
    want_fp = Counter((i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.fingerprint) for r in out) == want_fp
    near = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2]
    roots = components(near, set(fps))
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((i, least.get(roots[f])) for (i, _), f in zip(rows, fps, strict=True))
    assert S.simhash_components(frame(spark, [])).count() == 0


def test_drop_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(None, "same text here"), (5, "same text here"), (5, "same text here"), (5, "other words stand there"), (None, "third one"), (None, "third one")]
    docs = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _kept int, _text_hash int, _TEXT_HASH_ int")
    for similar in (None, (4, 5)):
        out = S.drop_near_duplicates(docs, similar=similar)
        assert out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted({(5, "same text here"), (5, "other words stand there"), (None, "third one")}, key=repr)


def test_drop_near_duplicates(spark, corpus):
    docs = frame(spark, corpus)
    kept = S.drop_near_duplicates(docs)
    ids = {r.doc_id for r in S.simhash_components(docs).collect() if r.doc_id == r.component_id}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    assert len(ids & set(range(100, 105))) + (3 in ids) == 1


def test_slices_take_only_the_buckets_that_occur():
    import time

    import numpy as np

    from kmerloom.llm._repeats import slices

    rnd = np.random.default_rng(5)
    for n, buckets in ((0, 3), (1, 1), (1, 7), (50, 1), (200, 13), (300, 100000)):
        h = np.sort(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        want = {}
        for i, x in enumerate(h.tolist()):
            want.setdefault((x >> 32) * buckets >> 32, []).append(i)
        assert slices(h, buckets) == [(b, own[0], own[-1] + 1) for b, own in want.items()]
    h = np.sort(rnd.integers(0, 1 << 64, 1000, dtype=np.uint64))
    took = {}
    for buckets in (1 << 12, 1 << 30):
        begun = time.perf_counter()
        slices(h, buckets)
        took[buckets] = time.perf_counter() - begun
    assert took[1 << 30] < 0.1


def test_first_round_of_a_dense_cluster_is_a_pigeonhole(spark):
    """Fingerprints all within four bits of one: still two partitions or more, with thresholds that sum as they must."""
    base = 0x0123456789ABCDEF
    pairs = [base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]
    fps = spark.createDataFrame([(S._signed(x),) for x in pairs], "fp long")
    rows = fps.selectExpr("0L AS done", "fp AS w", "fp")
    chosen = S.plan(rows, [0], S.bit_counts(fps), S.DISTANCE)[0]
    assert all(mask != S._ALL for mask, _ in chosen)
    assert sum(t + 1 for _, t in chosen) == S.DISTANCE + 1
