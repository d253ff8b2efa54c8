"""Line indexes and the source that reads by them, against plain reading of the same files."""

import io
import os
import random
from contextlib import redirect_stdout

import pytest

from kmerloom.sources import fasta, gfa, indexed, vcf
from kmerloom.sources.lines import read_lines


def in_files(folder, text, cuts):
    """text in files, cut after so many lines."""
    folder.mkdir()
    own, at = text.splitlines(keepends=True), 0
    for i, n in enumerate([*cuts, len(own)]):
        (folder / f"part-{i}.txt").write_text("".join(own[at:n]))
        at = n
    return str(folder)


def some_fasta(rnd):
    """Contigs of several lines each: equal numbers in a row, names without number, an empty one, lines before the first."""
    lines = ["before the first", ""]
    for name in ("1 a", "chr1 b", "2", "X", "Y", "2 again", "10"):
        lines.append(">" + name)
        lines += ["".join(rnd.choice("ACGTNacgtR") for _ in range(rnd.choice([0, 1, 7, 60, 300]))) for _ in range(rnd.randint(0, 9))]
    return "\n".join(lines)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("chunk", [3, 1 << 22])
def test_ranges_hold_each_line_once(tmp_path, size, chunk, monkeypatch):
    monkeypatch.setattr(indexed, "CHUNK", chunk)
    texts = ["", "\n", "a", "a\n", "\n\n\n", "ab\r\ncd\n\ne", "long" * 30 + "\nx\n" + "y" * 70, some_fasta(random.Random(3))]
    for i, text in enumerate(texts):
        path = tmp_path / f"{i}"
        path.write_text(text, newline="")
        data = path.read_bytes()
        got = [b"".join(indexed.whole_lines(str(path), a, min(a + size, len(data)))) for a in range(0, len(data), size)]
        assert b"".join(got) == data
        for kind in indexed.KINDS:
            rows = [r for a in range(0, len(data), size) for r in indexed.stretches(kind, str(path), a, min(a + size, len(data)))]
            assert [r[1] for r in rows[1:]] == [r[2] for r in rows[:-1]] and (not data or (rows[0][1], rows[-1][2]) == (0, len(data)))
            assert sum(r[3] for r in rows) == len(text.replace("\r\n", "\n").removesuffix("\n").split("\n")) if data else not rows


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_lines_and_contigs_equal_plain_reading(spark, tmp_path, size):
    path = in_files(tmp_path / "fa", some_fasta(random.Random(size)), [3, 4, 17])
    index = indexed.write_line_index(spark, path, "fasta", str(tmp_path / "index"), size)
    plain = sorted((r.line_no, r.value) for r in read_lines(spark, path).collect())
    got = indexed.indexed_lines(spark, index, size=size).collect()
    assert sorted((r.line_no, r.value) for r in got) == plain
    assert {r.line_no for r in got if r.key is None} == {0, 1}
    for chromosome in (vcf.ALL, 0, 1, 2, 10, 5):
        want, own = fasta.read_fasta(spark, path, chromosome), fasta.read_fasta(spark, path, chromosome, index)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))


def test_other_contigs_are_not_opened(spark, tmp_path):
    text = "".join(f">{c}\n" + "ACGT\n" * 50 for c in (1, 2, 3))
    path = in_files(tmp_path / "fa", text, [51, 102])
    index = indexed.write_line_index(spark, path, "fasta", str(tmp_path / "index"), 64)
    for name in ("part-0.txt", "part-2.txt"):
        os.remove(f"{path}/{name}")
    own = fasta.read_fasta(spark, path, 2, index)
    assert [(r.chrom, r.contig, r.text) for r in own.collect()] == [(2, 51, "ACGT" * 50)]
    size = lambda keys: sum(r[3] - r[2] for p in indexed.LineReader(index, 64, keys).partitions() for r in p.rows)
    assert (size(None), size({2}), size({7})) == (len(text), len(text) // 3, 0)
    plan = io.StringIO()
    with redirect_stdout(plan):
        indexed.indexed_lines(spark, index, 2).explain("formatted")
    assert "PushedFilters: [EqualTo(key,2)]" in plan.getvalue()


def test_filters_on_keys_and_others(spark, tmp_path):
    """Queries on the same DataFrame don't change each other, whichever filters each has."""
    path = in_files(tmp_path / "fa", some_fasta(random.Random(1)), [5])
    index = indexed.write_line_index(spark, path, "fasta", str(tmp_path / "index"), 50)
    every, some = indexed.indexed_lines(spark, index, size=50), indexed.indexed_lines(spark, index, 1, 10)
    rows = [tuple(r) for r in every.collect()]
    own = [r for r in rows if r[0] in (1, 10)]
    assert own and sorted(map(tuple, some.collect())) == sorted(own)
    for asked, holds in (
        ("key = 1", lambda r: r[0] == 1),
        ("key = 2 AND value LIKE '>%'", lambda r: r[0] == 2 and r[1].startswith(">")),
        ("key = 1 OR line_no = 0", lambda r: r[0] == 1 or r[2] == 0),
        ("key IS NULL", lambda r: r[0] is None),
    ):
        assert sorted(map(str, map(tuple, every.where(asked).collect()))) == sorted(map(str, filter(holds, rows))), asked
        assert sorted(map(tuple, some.where(asked).collect())) == sorted(filter(holds, own)), asked
    both = some.where("key = 1").unionByName(some).unionByName(every.where("key = 2"))
    assert sorted(map(tuple, both.collect())) == sorted([r for r in own if r[0] == 1] + own + [r for r in rows if r[0] == 2])


def test_vcf_and_gfa(spark, tmp_path):
    rnd = random.Random(5)
    rows = [f"{rnd.choice(['', 'chr', 'Chr'])}{c}\t{i}\t.\tA\t{rnd.choice(['G', 'AT', '<DEL>', 'AC,T'])}" for i, c in enumerate(sorted(rnd.choice([1, 2, 3, 20]) for _ in range(90)))]
    path = in_files(tmp_path / "vcf", "\n".join(["##x", "#CHROM\tPOS", *rows, "", "short", "1\t99\t.\tC\tG"]), [40])
    index = indexed.write_line_index(spark, path, "vcf", str(tmp_path / "vi"), 128)
    for chromosome in (vcf.ALL, 0, 1, 20, 4):
        own, want = vcf.read_vcf(spark, path, chromosome, index), vcf.read_vcf(spark, path, chromosome)
        assert sorted(map(str, own.collect())) == sorted(map(str, want.collect()))
    n = 60
    text = "H\tVN\n" + "".join(f"S\t{i}\t{'ACGT' * (i % 3)}\n" for i in range(n)) + "".join(f"L\t{i}\t+\t{i + 1}\t+\t0M\n" for i in range(n - 1)) + "\nP\tp\t" + ",".join(f"{i}+" for i in range(0, n, 2)) + "\t*"
    path = in_files(tmp_path / "gfa", text, [70])
    index = indexed.write_line_index(spark, path, "gfa", str(tmp_path / "gi"), 128)
    for compress in (False, True):
        own, want = gfa.from_gfa(spark, path, compress=compress, index=index), gfa.from_gfa(spark, path, compress=compress)
        for a, b in ((own.nodes, want.nodes), (own.edges, want.edges)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_refusals_and_empty_files(spark, tmp_path):
    (tmp_path / "x.fa.gz").write_bytes(b"\x1f\x8b")
    with pytest.raises(ValueError, match="compressed"):
        indexed.line_index(spark, str(tmp_path / "x.fa.gz"), "fasta")
    with pytest.raises(ValueError, match="kind"):
        indexed.line_index(spark, str(tmp_path), "sam")
    (tmp_path / "empty.fa").write_text("")
    index = indexed.write_line_index(spark, str(tmp_path / "empty.fa"), "fasta", str(tmp_path / "none"))
    assert indexed.indexed_lines(spark, index).isEmpty() and fasta.read_fasta(spark, "", 1, index).isEmpty()
