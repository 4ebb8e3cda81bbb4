"""Column functions on k-mers and presence words, and the small formulas around them.

A k-mer (k <= 31) is a long: two bits a base, A=0 C=1 G=2 T=3, last base lowest, so
the order of the numbers is the order of the strings.  Its canonical form is the
lesser of it and its reverse complement.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_K, MOST_K = 10, 31


def check_k(k: int) -> int:
    if not LEAST_K <= k <= MOST_K:
        raise ValueError(f"k must be from {LEAST_K} to {MOST_K}, not {k}")
    return k


def check_positive(**values: float) -> None:
    """An error for an argument that isn't above zero; None stands for an argument that wasn't given."""
    for name, value in values.items():
        if value is not None and not value > 0:
            raise ValueError(f"{name} must be above zero, not {value}")


def fold_to_dna(text: Column) -> Column:
    """Letters a-z in turn to A, C, G, T; everything else goes."""
    return F.regexp_replace(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def strand_flag(kmer: Column) -> Column:
    """1 if a spelling is canonical, 2 if not; a palindrome counts as 2."""
    return F.when(kmer < reverse_complement(kmer), 1).otherwise(2)


def pack_kmer(kmer: Column) -> Column:
    """String to long, canonical. Letters other than A, C, G, T raise an error."""
    packed = F.conv(F.translate(canonical(kmer), "ACGT", "0123"), 4, 10).cast("long")
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), packed).otherwise(F.when(kmer.isNotNull(), F.raise_error(F.concat(F.lit("not a k-mer: "), kmer)).cast("long")))


def unpack_kmer(kmer: Column, k: int) -> Column:
    """Long to string of k bases."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_bits(word: Column) -> Column:
    """The 64 bits of a word as text, lowest first."""
    return F.reverse(F.lpad(F.bin(word), 64, "0"))


def bit_at(words: Column, position: Column | int) -> Column:
    """0 or 1: the sample at `position` of an array of 64-bit presence words."""
    position = position if isinstance(position, Column) else F.lit(position)
    return F.call_function("getbit", F.element_at(words, (position / 64).cast("int") + 1), (position % 64).cast("int")).cast("int")


def popcount(words: Column, mask: list[int] | None = None) -> Column:
    """How many samples hold the k-mer, of those in `mask` if there is one."""
    if mask is not None:
        words = F.zip_with(words, F.array(*[F.lit(m).cast("long") for m in mask]), lambda w, m: w.bitwiseAND(m))
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def bit_text(words: Column, n: int) -> Column:
    """Presence of n samples as text, sample 0 leftmost."""
    return F.substring(F.array_join(F.transform(words, reverse_bits), ""), 1, n)


def signed(word: int) -> int:
    """An unsigned 64-bit word as the long that has the same bits."""
    return word - (1 << 64) if word >= 1 << 63 else word


def sample_mask(positions: list[int], n: int) -> list[int]:
    words = [0] * -(-n // 64)
    for p in positions:
        words[p // 64] |= 1 << (p % 64)
    return [signed(w) for w in words]


def minimum_count(n: int, maf: float, mac: int = 0) -> int:
    """Least number of samples on either side: the greater of mac and n * maf, rounded up, in double arithmetic."""
    return max(mac, math.ceil(float(n) * maf))


def effective_maf(n: int, maf: float, mac: int) -> float:
    return max(maf, mac / n)


def minus_log10(p: Column) -> Column:
    """-log10 of a p-value; p = 0 gives infinity and so passes any threshold."""
    return F.when(p > 0, -F.log10(F.when(p > 0, p))).when(p == 0, F.lit(float("inf")))


def variant_name(kmer: Column, rank: Column) -> Column:
    return F.concat_ws("_", kmer, rank.cast("string"))
