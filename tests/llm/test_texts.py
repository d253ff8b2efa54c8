import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from conftest_llm import frame

from kmerloom.llm import decontaminate as B
from kmerloom.llm import media as M
from kmerloom.llm import quality as Q
from kmerloom.llm.chat import rotate_perspectives


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(rows, items, window=13):
    out = []
    for i, text in rows:
        own, hit, named = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[k : k + n]:
                        hit |= set(range(p, p + n))
                        named.add("null" if item is None else str(item))
        out.append((i, len(own), len(hit), tuple(sorted(named)), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


@pytest.fixture
def items(corpus):
    passage = dict(corpus)[125].split()
    return [(10, " ".join(passage[:30])), (9, "-".join(passage[20:50])), (2, " ".join(passage[3:7])), (3, None), (4, " !"), (None, dict(corpus)[0]), (5, "one"), (5, "zz"), (6, "absent words " * 9)]


def test_contamination(spark, corpus, items, monkeypatch):
    rows = [*(r for r in corpus if r[0] != 126), (None, corpus[0][1]), corpus[1]]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    for size, block in ((B.SEGMENT_BYTES, B.BLOCK_WORDS), (2000, 40)):
        monkeypatch.setattr(B, "SEGMENT_BYTES", size)
        monkeypatch.setattr(B, "BLOCK_WORDS", block)
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in B.contamination(frame(spark, rows), bench).collect()]
        assert sorted(got, key=repr) == contamination(rows, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_contamination_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    out = B.contamination(frame(spark, corpus), none).collect()
    assert len(out) == len(corpus) and not any(r.n_hit or r.contaminated for r in out)
    assert B.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_phrases_do_not_cross_documents_or_lose_proximity(spark):
    docs = frame(spark, [(1, "a b c"), (2, "d e f"), (3, "a x b c d"), (4, "d c b a")])
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in B.contamination(docs, bench, 4).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    near = {r.doc_id: r.n_hit for r in B.contamination(docs, bench, 4, slop=1).collect()}
    assert near[3] > 0 and near[1] == near[2] == near[4] == 0
    with pytest.raises(ValueError):
        B.contamination(docs, bench, 4, slop=B.GAP)


def test_decontaminate_with_null_ids_and_clashing_names(spark):
    passage = " ".join(f"b{i}" for i in range(40))
    rows = [(None, passage, 1, 2), (None, "clean", 3, 4), (1, passage, 5, 6), (1, "clean two", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _text_hash int")
    out = B.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(tuple(r)[1:] for r in out.collect()) == [("clean", 3, 4), ("clean two", 7, 8)]


def test_decontaminate(spark, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, corpus)
    out = B.decontaminate(docs, bench)
    bad = {r.doc_id for r in B.contamination(docs, bench).collect() if r.contaminated}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, _ in corpus} - bad and bad


def brute_resize(image, height, width):
    h, w = image.shape
    big = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    return big.reshape(height, h, width, w).mean(axis=(1, 3))


def test_area_resize(monkeypatch):
    rnd = np.random.default_rng(0)
    for _ in range(40):
        image = rnd.integers(0, 256, rnd.integers(1, 60, 2), dtype=np.uint8)
        monkeypatch.setattr(M, "BAND", int(rnd.integers(1, 20)))
        assert np.allclose(M.area_resize(image, 8, 9), brute_resize(image, 8, 9))


def test_image_forms():
    rnd = np.random.default_rng(1)
    grey, rgb = rnd.integers(0, 256, (5, 7), dtype=np.uint8), rnd.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    assert (M.decode_image(M.encode_pgm(grey)) == grey).all() and (M.decode_image(M.encode_bmp(grey)) == grey).all()
    assert (M.decode_image(M.encode_pgm(rgb)) == rgb).all()
    assert M.decode_image(b"P2\n# c\n2 2\n15\n0 5 10 15\n").tolist() == [[0, 85], [170, 255]]
    assert M.decode_image(b"P1 2 2\n1 0\n01").tolist() == [[0, 255], [255, 0]]
    assert M.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert M.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode_image(b"P5 1 1 65535\n\x80\x00").tolist() == [[128]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    bmp24 = head + (1).to_bytes(4, "little") + (-1).to_bytes(4, "little", signed=True) + b"\1\0\x18\0" + bytes(24) + b"\3\2\1\0"
    assert M.decode_image(bmp24).tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5", b"P5 9 9 255\n1", b"BMx", b"GIF89a", b"P7 1 1"):
        with pytest.raises(ValueError):
            M.decode_image(bad)


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_of_texts(spark, corpus, form):
    rows = [*corpus, (None, "x"), corpus[0]]
    texts = {i: (t or "").encode() for i, t in rows}
    out = M.media_features(M.store_texts(frame(spark, rows), form)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r.doc_id]
        payload = t + bytes(-len(t) % 64 or (64 if not t else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), sha256(r.media).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        tile = np.rint(brute_resize(image, 8, 9)) if len(t) < 3000 else None
        if tile is not None:
            assert np.abs(np.load(__import__("io").BytesIO(r.tile)).astype(int) - tile).max() <= 1
        assert len(r.dhash) == 16
    assert M.store_texts(frame(spark, [])).count() == 0


def test_tiles_are_stored(spark, corpus):
    found = M.media_features(M.store_texts(frame(spark, corpus)))
    stored = {r.doc_id: r for r in M.write_tiles(found).collect()}
    assert "media" not in M.write_tiles(found).columns and len(stored) == len(corpus)
    for r in found.collect():
        tile = np.load(__import__("io").BytesIO(stored[r.doc_id].tile))
        assert (tile == M.tile_of(M.decode_image(r.media))).all()
        bits = [int(b > a) for row in tile.tolist() for a, b in zip(row[:-1], row[1:], strict=True)]
        assert stored[r.doc_id].dhash == f"{int(''.join(map(str, bits)), 2):016x}" == r.dhash


def test_broken_media_become_nulls(spark):
    rows = spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\1\2"), "z"), (2, bytearray(b"nothing"), "y"), (3, None, None)], "i int, media binary, dhash string")
    out = {r.i: r for r in M.media_features(rows).collect()}
    assert out[1].payload_bytes == 2 and out[1].dhash != "z"
    assert (out[2].payload_bytes, out[2].media_bytes, out[2].dhash) == (None, 7, None) and out[3].media_bytes is None


def labelled(n=240):
    good, bad = "the quick brown fox jumps over a lazy dog near the river bank", "BUY NOW!! ### $$$ WIN $$$ CLICK!! %%%"
    rows = [(i, (bad if i % 3 == 0 else good) + " " + " ".join("abcdefgh"[(i * k) % 8] * 3 for k in range(i % 7))) for i in range(n)]
    return rows, [(i, int(i % 3 != 0)) for i, _ in rows]


def test_quality_learns_without_held_out_rows(spark):
    rows, labels = labelled()
    docs, given = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, quality int")
    one, two = (Q.score_quality(docs, Q.fit_quality(docs, x)) for x in (given, flipped))
    scores = {r.doc_id: r.score for r in one.collect()}
    assert scores == {r.doc_id: r.score for r in two.collect()}
    assert one.columns == [*docs.columns, "score", "predicted"]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i, _ in rows if i in scores and (i in {r.doc_id for r in docs.where(Q.held_out()).collect()})] == held
    truth = dict(labels)
    assert np.mean([(scores[i] >= 0.5) == (truth[i] == 1) for i in held]) > 0.95


def test_quality_edge_cases(spark, corpus):
    docs = frame(spark, [*corpus, (None, "null"), corpus[0]])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(docs, Q.fit_quality(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i, _ in corpus] + [(None, 0), (5, None)], "doc_id long, quality int")
    out = Q.score_quality(docs, Q.fit_quality(docs, ones)).collect()
    assert len(out) == len(corpus) + 2 and all(0.9 < r.score <= 1 and r.predicted == 1 for r in out)
    empty = frame(spark, [])
    assert Q.score_quality(empty, Q.fit_quality(empty, ones)).count() == 0
    rows, labels = labelled()
    model = Q.fit_quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), fit_rows=50)
    own = frame(spark, rows).selectExpr("*", "123.0 AS score", "7 AS predicted", "9 AS _Score")
    kept = Q.drop_rejected(own, model)
    assert kept.columns == own.columns and 0 < kept.count() < len(rows)
    assert {(r.score, r.predicted, r._Score) for r in kept.collect()} == {(123, 7, 9)}


def test_context_sums_by_definition():
    import pyarrow as pa

    words, shapes, first = Q.tokens(pa.array(["the cat, 12 Cats", None, "the THE", "x"]))
    place, sign = Q._index_vectors()
    want = np.zeros((Q.WORDS + Q.SHAPES, Q.DIMS))
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - Q.CONTEXT), min(b, i + Q.CONTEXT + 1)):
                if i != j:
                    for target in (words[i], shapes[i] + Q.WORDS):
                        for source in (words[j], shapes[j] + Q.WORDS):
                            for d, v in zip(place[source], sign[source], strict=True):
                                want[target, d] += v
    assert np.allclose(Q.context_sums(words, shapes, first), want) and want.any()


def test_pooling_is_the_mean_of_vectors(corpus):
    import pyarrow as pa

    texts = [t for _, t in corpus]
    vectors = np.random.default_rng(0).normal(size=(Q.WORDS + Q.SHAPES, Q.DIMS)).astype(np.float32)
    got = Q.pooled(pa.array(texts), vectors)
    for i in (0, 5, 20, [k for k, (d, _) in enumerate(corpus) if d == 126][0], [k for k, (d, _) in enumerate(corpus) if d == 120][0]):
        w, s, first = Q.tokens(pa.array([texts[i]], pa.string()))
        exact = vectors.astype(float)
        want = np.concatenate([exact[w].mean(0) if len(w) else np.zeros(Q.DIMS), exact[Q.WORDS + s].mean(0) if len(s) else np.zeros(Q.DIMS), [np.log1p(len(w))]])
        assert np.allclose(got[i], want, atol=1e-3) and first[-1] == len(w)  # float32 sums over up to 30,000 words


def test_calibration_softens_overconfidence():
    rnd = np.random.default_rng(0)
    z = rnd.normal(size=4000) * 2
    y = (rnd.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2 < Q.calibrate(z * 3, y) < 4.5 and Q.calibrate(z, np.ones(4000)) == 1


def test_perspectives(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "eve", ""), (1, 2, "eve", ""), (1, None, None, None), (2, 70, "user", "late"), (2, 1, "user", "x"), (2, -1, "user", "before"), (None, 0, "user", "lost"), (3, 0, "bob", None)]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    out = {(r.conv_id, r.perspective, r.block): r for r in rotate_perspectives(turns).collect()}
    assert set(out) == {(1, p, b) for p in ("user", "assistant", "eve", "unknown") for b in (0, None)} | {(2, "user", 0), (2, "user", 1), (2, "user", -1), (3, "bob", 0)}
    eve = out[(1, "eve", 0)]
    assert eve.dialogue == "<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>user name=assistant\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [eve.dialogue[s.start : s.end] for s in eve.spans] == ["<|im_end|>\n"] and eve.n_turns == 3
    user = out[(1, "user", 0)]
    assert [user.dialogue[s.start : s.end] for s in user.spans] == ["hi<|im_end|>\n"]
    assert out[(1, "user", None)].spans == [] and out[(3, "bob", 0)].n_turns == 1
    assert rotate_perspectives(turns.limit(0)).count() == 0
    talk = spark.createDataFrame([(7, t, "ab"[t % 2], f"m{t} " * (20_000 if t == 5 else 1)) for t in range(200)], "conv_id long, turn long, role string, text string")
    rows = sorted((r for r in rotate_perspectives(talk).collect() if r.perspective == "a"), key=lambda r: r.block)
    assert [r.n_turns for r in rows] == [64, 64, 64, 8]
    whole = "".join(f"<|im_start|>{'assistant' if t % 2 == 0 else 'user name=b'}\n{f'm{t} ' * (20_000 if t == 5 else 1)}<|im_end|>\n" for t in range(200))
    assert "".join(r.dialogue for r in rows) == whole


def test_fit_rows_bounds_rows(spark, monkeypatch):
    """Rows that share a labelled id are one row of the fit."""
    from kmerloom.llm import quality as Q

    seen = []
    train = Q.train
    monkeypatch.setattr(Q, "train", lambda x, y: seen.append(len(x)) or train(x, y))
    docs = spark.createDataFrame([(2, f"text number {i}") for i in range(300)] + [(3, "other"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    Q.fit_quality(docs, labels, fit_rows=10)
    assert seen == [sum(1 for i in (2, 3, 5) if __import__("zlib").crc32(str(i).encode()) % 3 != 1)]
