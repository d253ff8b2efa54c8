import hashlib
from collections import Counter

import pytest
import sentencepiece
from conftest_llm import frame
from tokenizers import Tokenizer

from kmerloom.llm import alignment, bpe

A_PATH, B_PATH = alignment.default_paths()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, bpe.tokenizer(A_PATH, True).token_bytes, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def groups_of(libraries, text):
    """The groups [(a ids, b ids)] of one text by walking over both token lists."""
    tokenizer, table, model = libraries
    if not text:
        return []
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    parts = [[table[i] for i in a], [piece(i) for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] if len(p) < 500 else _sums(p) for p in parts]
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for stop in both:
        x, y = i, j
        while i < len(a) and ends[0][i] <= stop:
            i += 1
        while j < len(b) and ends[1][j] <= stop:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


def _sums(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def brute(libraries, rows):
    found = [(i, groups_of(libraries, t)) for i, t in rows]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for _, groups in found]
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, groups), own in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (str(i), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), text)
        )
    return sorted(out), count, most


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def collected(df):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS[1:])) for r in df.collect())


ODD = [
    (None, "null id"),
    (None, "null id"),
    (7, "a second text of one id  with   spaces "),
    (300, "<|endoftext|> and <s> </s><unk> as text"),
    (301, "▁mark"),
    (302, "tab\tline\nbreak\r\n\n  \x00 é漢字😀 ½"),
    (303, "================== ----- ........ aaaaaaaaaaaaaaaaaaaaaaa 1234567890123456"),
    (304, "漢字かな交じり文と한국어 텍스트"),
    (305, "   leading"),
    (306, " "),
]


@pytest.mark.parametrize("chunk,block,buckets,asked", [(1 << 18, 1 << 23, 1 << 18, 1 << 20), (500, 3000, 40, 60)])
def test_measures_equal_brute_force(spark, corpus, libraries, monkeypatch, chunk, block, buckets, asked):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("BUCKET_PAIRS", buckets), ("ASKED_PAIRS", asked), ("WIDE", 6)):
        monkeypatch.setattr(alignment, name, value)
    rows = [*corpus, *ODD]
    got = collected(alignment.link_measures(frame(spark, rows).repartition(3), groups="text"))
    assert got == brute(libraries, rows)[0]


def test_counts_and_arrays(spark, corpus, libraries):
    rows = [r for r in corpus if r[0] != 126] + ODD
    _, count, most = brute(libraries, rows)
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.link_counts(frame(spark, rows)).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in count.items()}
    arrays = sorted((str(r.doc_id), r.a_ids, r.b_ids, r.a_sizes, r.b_sizes) for r in alignment.align(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        own = groups_of(libraries, t)
        want.append((str(i), [a for x, _ in own for a in x], [b for _, y in own for b in y], [len(x) for x, _ in own], [len(y) for _, y in own]))
    assert arrays == sorted(want)


def test_empty_table_and_bad_arguments(spark):
    none = frame(spark, [(1, "x")]).where("doc_id = 0")
    assert alignment.link_measures(none).collect() == []
    assert alignment.link_counts(none).collect() == []
    with pytest.raises(ValueError):
        alignment.link_measures(none, groups="json")
    with pytest.raises(ValueError):
        alignment.align(none.selectExpr("struct(doc_id) AS doc_id", "text"))


def test_only_texts_without_tokens(spark):
    got = collected(alignment.link_measures(frame(spark, [(1, None), (2, ""), (3, "▁")])))
    assert got == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_query(spark, libraries):
    from kmerloom.llm.queries import op13_token_alignment

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(libraries, rows)[0]]
    assert collected(op13_token_alignment(spark, folder).withColumnRenamed("groups_sha256", "groups")) == want
