"""Presence of k-mers in samples: long rows and packed words, filters, lookups, patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import bit_at, bit_text, canonical, pack_kmer
from tessera.operators.cohort import passing


MOST_SENT = 1_000_000  # k-mers of a list that is sent to the workers, 8 MB


def numbered(df: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """df with `place`, 0 and up in order of a key without repeats, a null first.

    Rows are dealt to ranges whose bounds are the keys of least hash, numbered
    within each range, and moved by the sizes of the ranges before; only bounds
    and sizes, `ranges` of each, reach the driver.
    """
    kind = df.schema[key].dataType
    bounds = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(ranges - 1).collect())
    at = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = df.withColumn("__range", at)
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before = [sum(n for k, n in sizes.items() if k < r) for r in range(len(bounds) + 1)]
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("place", inner + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__range") + 1)).drop("__range")


def sample_index(accessions: DataFrame) -> DataFrame:
    """(accession, col_idx): samples numbered from 0 in order of their names, a null first."""
    return numbered(accessions.select("accession").distinct(), "accession").select("accession", F.col("place").cast("int").alias("col_idx"))


def sample_names(index: DataFrame) -> pa.Array:
    """The samples' names in order of their numbers, as many as samples, on the driver."""
    rows = index.select("accession", "col_idx").toArrow().sort_by("col_idx")
    return rows.column("accession").combine_chunks()


def presence_rows(cohort: DataFrame, samples: DataFrame) -> DataFrame:
    """(kmer, accession): the cohort's k-mers in the samples that hold them; k-mers of no sample keep one row with a null accession."""
    return cohort.select("kmer").join(samples.select("kmer", "accession").distinct(), "kmer", "left")


def _bit():
    return F.expr("shiftleft(1L, cast(col_idx % 64 as int))")


def _word():
    return F.expr("col_idx div 64").cast("int").alias("word")


def presence_words(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(kmer, word, bits): the non-zero 64-bit words of each k-mer; sample i is bit i % 64 of word i // 64."""
    return rows.join(index, "accession").groupBy("kmer", _word()).agg(F.bit_or(_bit()).alias("bits"))


def _array(n: int, m: str = "m"):
    """The words of n samples from a map of those that aren't zero."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(-(-n // 64), 1) - 1)), lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("long")))


def pack_presence(rows: DataFrame, index: DataFrame, n: int, least: int = 0) -> DataFrame:
    """(kmer, pa, n1): presence words of every k-mer of `rows` as an array, and the number of samples; with `least` of those
    that so many samples or more have on either side. K-mers whose samples are none of the index's have words of zeros."""
    placed = rows.join(index, "accession", "left").groupBy("kmer", _word()).agg(F.bit_or(_bit()).alias("bits"))
    words = F.map_from_entries(F.filter(F.collect_list(F.struct("word", "bits")), lambda x: x["word"].isNotNull())).alias("m")
    held = placed.groupBy("kmer").agg(words, F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n1"))
    return both_sides(held, n, least).select("kmer", _array(n).alias("pa"), "n1")


def cohort_table(flags: DataFrame, index: DataFrame, n: int, mac: int, min_strand_percent: float) -> DataFrame:
    """(kmer, pa, n1) of the k-mers of the cohort list, from flags (accession, kmer, flag).

    A sample is a bit for either strand, so packed presence and the counts that the
    list's filters ask come from one aggregate, and rows of one sample and k-mer
    needn't be summed before: their strands are united by it.
    """
    strand = lambda f: F.bit_or(F.when(F.col("flag").bitwiseAND(f) != 0, _bit()).otherwise(F.lit(0).cast("long")))
    words = flags.join(index, "accession").groupBy("kmer", _word()).agg(strand(1).alias("one"), strand(2).alias("two"))
    one, two = F.col("one"), F.col("two")
    counts = {"canonical": one.bitwiseAND(F.bitwise_not(two)), "non_canonical": two.bitwiseAND(F.bitwise_not(one)), "both": one.bitwiseAND(two), "count_all": one.bitwiseOR(two)}
    words = words.select("kmer", "word", one.bitwiseOR(two).alias("bits"), *(F.bit_count(c).cast("long").alias(k) for k, c in counts.items()))
    rows = words.groupBy("kmer").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), *(F.sum(k).alias(k) for k in counts))
    return passing(rows, mac, min_strand_percent).select("kmer", _array(n).alias("pa"), F.col("count_all").alias("n1"))


def unpack_presence(packed: DataFrame, index: DataFrame) -> DataFrame:
    """(kmer, accession) rows of a packed table."""
    cells = F.explode(F.filter(F.sequence(F.lit(0), F.size("pa") * 64 - 1), lambda i: bit_at(F.col("pa"), i) == 1)).alias("col_idx")
    return packed.select("kmer", cells).join(index, "col_idx").select("kmer", "accession")


def bits_of(column, n: int) -> np.ndarray:
    """Rows x n of 0 and 1 of an Arrow array of presence words."""
    words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint8)
    return np.unpackbits(words.reshape(len(column), -1), axis=1, bitorder="little")[:, :n] if len(column) else np.empty((0, n), np.uint8)


def words_of(bits: np.ndarray) -> pa.ListArray:
    """The same back to words, a list of longs for each row."""
    packed = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little")).view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.ravel()))


def select_samples(packed: DataFrame, positions: list[int], n: int) -> DataFrame:
    """The packed table for some of its n samples, in the order given, with n1 counted on these."""
    at = np.array(positions, np.int64)
    step = max(1, (1 << 24) // max(n, 1))  # rows whose bits are spread out at once

    def run(batches):
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            bits = bits_of(batch.column("pa"), n)[:, at]
            n1 = bits.sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kmer"), words_of(bits), pa.array(n1)], names=["kmer", "pa", "n1"])

    return packed.select("kmer", "pa").mapInArrow(run, f"kmer {packed.schema['kmer'].dataType.simpleString()}, pa array<long>, n1 long")


def both_sides(df: DataFrame, n: int, least: int, n1: str = "n1") -> DataFrame:
    """Rows with `least` samples or more on either side."""
    return df.where(F.col(n1).between(least, n - least))


def allele_counts(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """(kmer, n1) over the selected samples."""
    return rows.join(selected.select("accession").distinct(), "accession", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("n1"))


def kmer_list(text_kmers: DataFrame, column: str = "kmer") -> DataFrame:
    """(kmer, length) of a list of k-mers as text, canonical; letters other than A, C, G, T and unequal lengths are errors."""
    packed = text_kmers.where(F.col(column).isNotNull()).select(pack_kmer(F.col(column)).alias("kmer"), F.length(column).alias("length")).distinct()
    width = packed.agg(F.min("length").alias("lo"), F.max("length").alias("hi")).first()
    if width["lo"] != width["hi"]:
        raise ValueError("k-mers of different lengths")
    return packed


def lookup(table: DataFrame, kmers: DataFrame) -> DataFrame:
    """Rows of a table with the k-mers of a list; repeats in the list count once."""
    wanted = kmers.select("kmer").distinct()
    short = wanted.limit(MOST_SENT + 1).count() <= MOST_SENT  # then the table isn't exchanged by k-mer
    return table.join(F.broadcast(wanted) if short else wanted, "kmer", "left_semi")


def presence_matrix(packed: DataFrame, names: list[str]) -> DataFrame:
    """kmer and a 0/1 column for each sample, named after it."""
    return packed.select("kmer", *(bit_at(F.col("pa"), i).alias(name) for i, name in enumerate(names)))


def presence_text(packed: DataFrame, n: int) -> DataFrame:
    """kmer and its row of 0 and 1 as text, sample 0 leftmost."""
    return packed.select("kmer", bit_text(F.col("pa"), n).alias("presence"))


def pattern_count(packed: DataFrame) -> DataFrame:
    """(patterns): exact number of different presence patterns."""
    return packed.select("pa").distinct().agg(F.count(F.lit(1)).alias("patterns"))


def pattern_rows(packed: DataFrame) -> DataFrame:
    """One row per pattern, that of its least k-mer, with the number of k-mers that share it."""
    return packed.groupBy("pa").agg(F.min("kmer").alias("kmer"), F.count(F.lit(1)).alias("n_kmers"), F.first("n1").alias("n1")).select("kmer", "pa", "n1", "n_kmers")


def bed_bytes(packed: DataFrame, n: int) -> DataFrame:
    """(kmer, byte_idx, byte): four samples a byte, from the low bits, 3 where present and 0 where absent."""
    code = lambda b, j: F.when(b * 4 + j < n, bit_at(F.col("pa"), F.least(b * 4 + j, F.lit(n - 1))) * (3 << (2 * j))).otherwise(0)
    cells = F.transform(F.sequence(F.lit(0), F.lit(-(-n // 4) - 1)), lambda b: code(b, 0) + code(b, 1) + code(b, 2) + code(b, 3))
    return packed.select("kmer", F.posexplode(cells).alias("byte_idx", "byte"))


def canonical_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, canonical(F.col(column)))
