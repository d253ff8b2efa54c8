import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import frame
from tokenizers import Tokenizer

from kmerloom.llm import _tokens
from kmerloom.llm import packing as P
from kmerloom.llm import token_records as R

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    own = _tokens.Encoder(_tokens.default_path())
    rnd = random.Random(2)
    alphabet = "aAéÉßµªºÿÀ.,.,!_'s \n\t\xa0\x85²1½<|Σσςéİ日"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["It's a TEST.. <|ENDOFTEXT|> <|endoftext|> ok. no", "a!!, b., c_. d", "don't. WE'LL, 12,000.50. 3.", "", "x" * 3000]
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == [ids_of(t) for t in texts]


def test_other_tokenizers_read_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = _tokens.Encoder(path), Tokenizer.from_file(path)
    for text in ("Hello World. a b", " two  blanks\nÉ", "", "x" * 3000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(_tokens, "CACHE_WORDS", 2)
    own = _tokens.Encoder(_tokens.default_path())
    assert np.frombuffer(own.encode("one two three four two"), "<u4").tolist() == ids_of("one two three four two") and len(own) <= 2


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = P.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [7, 2048])
def test_packing_places_every_id_once(spark, corpus, length):
    rows = [*corpus, (None, "null id")]
    pieces = P.pack_documents(frame(spark, rows), length).collect()
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        want = [*ids_of(texts[doc]), 1]
        assert np.frombuffer(b"".join(bytes(r.tokens) for r in own), "<u4").tolist() == want
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(want)}
    short = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size <= length
        if size < length:
            short.append((own[0].sequence_id >> 32, size))
    assert all(size & (size - 1) == 0 for _, size in short) and len(set(short)) == len(short)  # a partition's rest, each power once
    assert P.pack_documents(frame(spark, [])).count() == 0


def test_packing_follows_the_curve(spark, corpus):
    """Documents of a partition lie in the order of their Hilbert keys, computed anew from the library's ids."""
    texts = dict(corpus)
    pieces = sorted(P.pack_documents(frame(spark, corpus)).collect(), key=lambda r: (r.sequence_id, r.offset))
    vectors = np.stack([np.bincount(P._BUCKET[np.array([*ids_of(texts[i]), 1])], minlength=P.BUCKETS) for i in texts]).astype(float)
    v = np.log1p(vectors) - np.log1p(vectors).mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cells = np.minimum((np.tanh(v @ P._AXES) + 1) / 2 * 65536, 65535).astype(np.int64)
    assert (cells == P.curve_cells(vectors)).all()
    keys = dict(zip(texts, P.hilbert_key(cells).tolist(), strict=True))
    first = [(r.sequence_id >> 32, keys[r.doc_id]) for r in pieces if r.start == 0]
    assert first == sorted(first)


def test_packing_repeated_rows(spark):
    pieces = P.pack_documents(frame(spark, [(1, "a b")] * 3 + [(1, None)], False), 2).collect()
    assert sum(r.length for r in pieces) == 3 * 3 + 1


def test_frames_round_trip_and_break(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(R.frame(b"abc") + R.frame(b""))
    with open(path, "rb") as handle:
        assert (R.unframe(handle, 0), R.unframe(handle, 19)) == (b"abc", b"")
    for at in (0, 8, 12, 15, 20):
        data = bytearray(path.read_bytes())
        data[at] ^= 1
        broken = tmp_path / "b"
        broken.write_bytes(data)
        with open(broken, "rb") as handle, pytest.raises(ValueError):
            R.unframe(handle, 0 if at < 19 else 19)


@pytest.mark.parametrize("compress", [True, False])
def test_records_round_trip(spark, corpus, tmp_path, compress):
    rows = [*corpus, (None, "null id"), corpus[0], (corpus[1][0], "another")]
    root = f"file://{tmp_path}/r"
    manifest = R.write_records(frame(spark, rows), root, compress=compress)
    want = sorted((R.C.NULL_ID if i is None else i, [*ids_of(t), 2]) for i, t in rows)
    got = sorted(R.read_records(spark, root, manifest).collect(), key=lambda r: r.start)
    assert sorted((R.C.NULL_ID if r.doc_id is None else r.doc_id, np.frombuffer(r.tokens, "<u4").tolist()) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [R.C.NULL_ID if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    mixed = R.read_records(spark, root, manifest, seed=3).collect()
    assert sorted(r.start for r in mixed) == [r.start for r in got] and [r.start for r in mixed] != [r.start for r in got]
    assert {r.start: zlib.crc32(r.tokens) for r in mixed} == {r.start: zlib.crc32(r.tokens) for r in got}


def test_records_of_an_empty_table(spark, tmp_path):
    manifest = R.write_records(frame(spark, []), f"{tmp_path}/e")
    assert manifest.count() == 0 and R.read_records(spark, f"{tmp_path}/e", manifest).count() == 0
