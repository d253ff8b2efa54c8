import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.occurrences import linear_kmers

WORDS = ["AC", "ggTAc", "ACGTACGTacgtAAGTCCAAGTACGTACGTA"]


@pytest.mark.parametrize("encoding", ["ACGT", "cGaT", "gATc", "TGCA"])
def test_hash_and_decode(spark, encoding):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for w in WORDS:
        own = df.where(F.col("w") == w).select(K.hash_kmer(F.col("w"), encoding).alias("h"))
        row = own.select("h", K.decode_kmer(F.col("h"), len(w), encoding).alias("d"), K.decode_kmer(K.reverse_hash(F.col("h"), len(w)), len(w), encoding).alias("r")).first()
        assert (row.h, row.d, row.r) == (K.hash_text(w, encoding=encoding), w.upper(), w.upper()[::-1])


def test_decode_goldens(spark):
    rows = spark.createDataFrame([(0b00011011, 0b1100, 0b1111111100000000)], "a long, b long, c long")
    got = rows.select(K.decode_kmer(F.col("a"), 4), K.decode_kmer(F.col("b"), 2), K.decode_kmer(F.col("c"), 8), K.decode_kmer(F.col("a"), 4, "cGaT"), K.decode_kmer(F.col("a"), 4, "gATc"), K.decode_kmer(F.col("b"), 2, "cGaT"), K.decode_kmer(F.col("b"), 2, "gATc")).first()
    assert list(got) == ["ACGT", "TA", "TTTTAAAA", "CGAT", "GATC", "TC", "CG"]


def test_packing_goldens(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [1, 1, 1, 1, 3, 3, 3, 3])], "a array<int>, b array<int>")
    got = df.select(K.pack_codes(F.col("a"), 4), K.pack_codes(F.col("b"), 8), K.pack_codes_left(F.col("a"), 4), K.pack_codes_left(F.col("a"), 3, 1)).first()
    assert list(got) == [0b00011011, 0b0101010111111111, 0b00011011 << 56, 0b011011 << 58]


def test_bad_kmers_hash_to_null(spark):
    df = spark.createDataFrame([(w,) for w in ("", None, "ACX", "A" * 32, "ACN")], "w string")
    assert [r[0] for r in df.select(K.hash_kmer(F.col("w"))).collect()] == [None, None, None, None, 4]
    for bad in ("ACG", "ACGG", "ACGTT", None):
        with pytest.raises(ValueError):
            K.check_encoding(bad)
    with pytest.raises(ValueError):
        K.hash_text("AC", 3)


def test_linear_kmers_over_pieces(spark):
    text = "ACGTTGCANNACCGTAGG" * 40
    df = spark.createDataFrame([(1, text), (2, "AC"), (3, None), (4, "")], "i int, seq string")
    rows = linear_kmers(df, 5).orderBy("position").collect()
    assert [(r.position, r.kmer) for r in rows] == [(p, K.hash_text(text[p : p + 5])) for p in range(len(text) - 4)]
    assert [r.kmer for r in linear_kmers(df.where("i = 1"), 1).orderBy("position").limit(3).collect()] == [0, 1, 2]
