"""k-mer expressions: bases as base-4 digits, hashes as BIGINT, all inside the JVM.

A hash of k bases is the number their codes spell in base 4 (first base most significant). Up to 31 bases it fits a
positive BIGINT; at 32 bases, and left-aligned, it is the same 64 bits read as a signed number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ENCODING = "ACGT"
MAX_K = 31


def check_encoding(encoding: str) -> str:
    """The encoding in upper case: the four bases in the order of their codes; ValueError for anything else."""
    if not isinstance(encoding, str) or sorted(encoding.upper()) != list("ACGT"):
        raise ValueError(f"an encoding is an order of A, C, G and T, not {encoding!r}")
    return encoding.upper()


def is_encoding(name: Column) -> Column:
    """Whether a text is an encoding: four characters, A, C, G and T in some order and either case; false for null."""
    return F.coalesce((F.length(name) == 4) & F.forall(F.array(*(F.lit(b) for b in "ACGT")), lambda b: F.contains(F.upper(name), b)), F.lit(False))


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_K:
        raise ValueError(f"k is an integer from 1 to {MAX_K}, not {k!r}")
    return k


def check_budget(most: int) -> int:
    if isinstance(most, bool) or not isinstance(most, int) or not 0 <= most <= 255:
        raise ValueError(f"the number of variant nodes is from 0 to 255, not {most!r}")
    return most


def is_bases(seq: Column) -> Column:
    """Whether a sequence holds nothing but A, C, G, T and N, in either case; an empty one does."""
    return seq.rlike("^[ACGTNacgtn]*$")


def digits(seq: Column, encoding: str = DEFAULT_ENCODING) -> Column:
    """Codes of bases as a string of digits 0 to 3; N counts as code 0."""
    return F.translate(F.upper(seq), check_encoding(encoding) + "N", "01230")


def hash_kmer(kmer: Column, encoding: str = DEFAULT_ENCODING) -> Column:
    """The hash of a whole k-mer of 1 to 31 bases; null for null, for other lengths and for other characters."""
    valid = is_bases(kmer) & F.length(kmer).between(1, MAX_K)
    return F.when(valid, hash_digits(digits(kmer, encoding)))


def hash_digits(codes: Column) -> Column:
    """The hash of 1 to 31 digits."""
    return F.conv(codes, 4, 10).cast("bigint")


def hash_first(seq: Column, k: int, encoding: str = DEFAULT_ENCODING) -> Column:
    """The hash of the first k bases; null if there are fewer."""
    return F.when(F.length(seq) >= check_k(k), hash_kmer(F.substring(seq, 1, k), encoding))


def left_align(hashed: Column, k: int) -> Column:
    """The hash moved to the high bits of 64; negative where the first code is 2 or 3."""
    return F.shiftleft(hashed, 64 - 2 * k)


def decode_kmer(hashed: Column, k: int, encoding: str = DEFAULT_ENCODING) -> Column:
    """The upper-case k-mer of a right-aligned hash, up to 32 bases."""
    return F.translate(F.lpad(F.conv(hashed.cast("string"), 10, 4) if k < 32 else F.conv(F.hex(hashed), 16, 4), k, "0"), "0123", check_encoding(encoding))


def reverse_hash(hashed: Column, k: int) -> Column:
    """The hash of the same bases in reverse order (no complement)."""
    return hash_digits(F.reverse(F.lpad(F.conv(hashed.cast("string"), 10, 4), k, "0")))


def pack_codes(codes: Column, k: int, offset: int = 0) -> Column:
    """k codes of an array from an offset on as one right-aligned number."""
    return F.aggregate(F.slice(codes, offset + 1, k), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 2).bitwiseOR(x.cast("bigint")))


def pack_codes_left(codes: Column, k: int, offset: int = 0) -> Column:
    """The same, moved to the high bits of 64."""
    return left_align(pack_codes(codes, k, offset), k)


def base_code(seq: Column, i: int | Column, encoding: str = DEFAULT_ENCODING) -> Column:
    """The code of base i, counted from 0; null outside the sequence."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.when((at >= 0) & (at < F.length(seq)), F.substr(digits(seq, encoding), at + 1, F.lit(1)).cast("int"))


def hash_text(kmer: str, k: int | None = None, encoding: str = DEFAULT_ENCODING) -> int:
    """The hash of the first k bases of one Python string (all without k), up to 32 bases."""
    order = check_encoding(encoding)
    own = kmer.upper()[: len(kmer) if k is None else k]
    if not own or len(own) > 32 or (k is not None and len(own) < k) or set(own) - set("ACGTN"):
        raise ValueError(f"not a k-mer: {kmer!r}")
    value = 0
    for base in own:
        value = value * 4 + max(0, order.find(base))
    return value
