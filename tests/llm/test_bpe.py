import hashlib
import random

import numpy as np
import pytest
from conftest_llm import frame
from tokenizers import Tokenizer

from kmerloom.llm import bpe

PATH = bpe.default_path()
ALPHABET = " " * 6 + "\n\t\r\x0b\x0c\x1c\x85\xa0　'stmdrevl'''abcdeABC0129½²!?.,-éßñ漢字ひ한글ाि😀‍́\x00<|>"


def library(plain=False):
    own = Tokenizer.from_file(PATH)
    own.no_padding()
    own.no_truncation()
    own.encode_special_tokens = plain
    return own


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0x24F), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(500)]
    out += ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 400))) for _ in range(200)]  # words on both sides of LONG_WORD
    out += ["a<|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x" * 5000, "ab" * 3000, "aaaaaaa", " " * 300, "\n\n\n  a", "I'll've can't 'SHE'S' ''s 's's 'rx 'lll"]
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(texts, plain):
    own, ref = bpe.ByteBPE(PATH, plain), library(plain)
    got = [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts)]
    assert got == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]


def test_verified_proposals_and_failures_both_occur():
    """Greedy proposals are kept where they verify; where they do not, merging gives something else."""
    own = bpe.ByteBPE(PATH)
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("theraiondlyus") for _ in range(rnd.randint(2, 9))).encode() for _ in range(3000)})
    merged = dict(zip(words, own.merged_all(words), strict=True))
    seen = []
    own.merged_all = lambda some: seen.extend(some) or [merged[w] for w in some]
    own.add(words)
    assert 0.02 * len(words) < len(seen) < len(words)
    assert all(own[w] == merged[w] for w in words)
    assert all(np.array(own.merged(w), np.int32).tobytes() == merged[w] for w in words)  # the heap of long words


def test_neighbours_agree_with_merging():
    """compatible(a, b) is whether merging the bytes of a and b gives a, b."""
    own = bpe.ByteBPE(PATH)
    rnd = random.Random(5)
    good = [t for t in own.ends.tolist() if t >= 0]
    pairs = [(rnd.choice(good), rnd.choice(good)) for _ in range(4000)]
    want = [own.merged(own.token_bytes[a] + own.token_bytes[b]) == [a, b] for a, b in pairs]
    a, b = np.array(pairs).T
    assert own.compatible(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


def test_cache_is_bounded(monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    own = bpe.ByteBPE(PATH)
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts[:300])] == [e.ids for e in library().encode_batch(texts[:300], add_special_tokens=False)]
    assert len(own) < 2000


def test_round_trip(spark, corpus):
    rows = [*corpus, (None, "null id"), (None, "null id"), (7, "again"), (200, "z <|endoftext|> é" * 20_000)]
    out = bpe.decode_bpe(bpe.encode_bpe(frame(spark, rows))).collect()
    ref = library()
    want = sorted((str(i), ref.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == want
    assert bpe.encode_bpe(frame(spark, rows[:0] or [(1, "x")]).where("doc_id = 0")).count() == 0


def test_decode_odd_ids(spark):
    ref = library()
    rows = [(1, [50256, 31373, 995]), (2, []), (3, None), (4, [447, 247, 447]), (5, [-1, 15496, 99999, None, 50256])]
    own = spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "7 AS Decoded")
    out = {r.doc_id: r.decoded for r in bpe.decode_bpe(own).collect()}
    assert out == {i: ref.decode([x for x in ids or [] if x is not None and 0 <= x <= 50256], skip_special_tokens=False) for i, ids in rows}


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark):
    from kmerloom.llm.queries import op12_bpe_round_trip

    folder = "/root/testdata/sf0.001"
    ref = library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = ref.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_bpe_round_trip(spark, folder).collect()} == want
