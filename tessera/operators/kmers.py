"""Counting k-mers, strand flags, and histograms of counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequences import check_k

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def spelled(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers and strand flags at all places of a sequence; places with other letters are left out."""
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int8)
    wide = codes.astype(np.int64) & 3
    forward = back = np.zeros(n, np.int64)
    for j in range(k):
        forward = (forward << 2) | wide[j : j + n]
        back = back | ((3 - wide[j : j + n]) << (2 * j))
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    ok = bad[k:] == bad[:-k]
    forward, back = forward[ok], back[ok]
    return np.minimum(forward, back), np.where(forward < back, 1, 2).astype(np.int8)


PIECE = 4_000_000  # bases of a sequence that are counted at once
ROWS = 500_000  # counts that one batch holds, of one sequence at least


def sequence_counts(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 2 * k-mer + (spelled the other way), and how often each occurs; a long sequence is counted piece by piece."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, max(len(seq), 1), PIECE):
        kmers, flags = spelled(seq[at : at + PIECE + k - 1], k)
        key, n = np.unique((kmers << 1) | (flags == 2), return_counts=True)
        if at:
            key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        keys, counts = key, n
    return keys, counts


def joined(rows):
    """Sequences (who, seq) that follow each other under one accession as one, a letter that is no base between them:
    the many short reads of a sample are counted together."""
    now, held, size = None, [], 0
    for who, s in rows:
        s = (s or "").encode()
        if held and (who != now or size + len(s) > PIECE):
            yield now, b"N".join(held)
            held, size = [], 0
        now, size = who, size + len(s)
        held.append(s)
    if held:
        yield now, b"N".join(held)


def stranded_counts(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted k-mers of a sequence, the union of the strands of each, and how often it occurs, either spelling."""
    key, n = sequence_counts(seq, k)
    kmers, first = np.unique(key >> 1, return_index=True)
    flag = np.bitwise_or.reduceat(1 + (key & 1), first).astype(np.int32) if len(first) else np.empty(0, np.int32)
    return kmers, flag, np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)


def _counted(df: DataFrame, accession: str, seq: str, schema: str, rows_of) -> DataFrame:
    """Rows (accession, ...) that rows_of gives for each sequence's counts, in batches of bounded size."""
    kind = df.schema[accession].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind]
    names = ["accession", *(c.split()[0] for c in schema.split(", "))]

    def out(ids, parts):
        lens = [len(p[0]) for p in parts]
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow).take(pa.array(np.repeat(np.arange(len(ids)), lens))), *columns], names=names)

    def run(batches):
        ids, parts, size = [], [], 0
        for who, s in joined((who, s.as_py()) for batch in batches for who, s in zip(batch.column(0).to_pylist(), batch.column(1))):
            ids.append(who)
            parts.append(rows_of(s))
            size += len(parts[-1][0])
            if size > ROWS:
                yield out(ids, parts)
                ids, parts, size = [], [], 0
        if ids:
            yield out(ids, parts)

    return df.select(accession, seq).mapInArrow(run, f"accession {kind}, {schema}")


def count_spellings(df: DataFrame, accession: str, seq: str, k: int, rows_are_samples: bool = False) -> DataFrame:
    """(accession, kmer, flag, n): how often each canonical k-mer is spelled canonically (flag 1)
    or not (flag 2) in each sample.

    Counts are summed per sequence where it is read, then per sample; with
    rows_are_samples the second sum and its shuffle are left out: for accessions
    without repeats, and where a later aggregate adds up the rows of one k-mer
    anyway.  Null sequences and those shorter than k give nothing.
    """
    check_k(k)

    def rows(s):
        key, n = sequence_counts(s, k)
        return key >> 1, (1 + (key & 1)).astype(np.int32), n

    out = _counted(df, accession, seq, "kmer long, flag int, n long", rows)
    return out if rows_are_samples else out.groupBy("accession", "kmer", "flag").agg(F.sum("n").alias("n"))


def count_stranded(df: DataFrame, accession: str, seq: str, k: int, rows_are_samples: bool = False) -> DataFrame:
    """(accession, kmer, flag, n): how often each canonical k-mer occurs in each sample, either spelling, and
    the union of the strands seen (1, 2 or 3): both counting passes in one. Else as count_spellings."""
    check_k(k)

    out = _counted(df, accession, seq, "kmer long, flag int, n long", lambda s: stranded_counts(s, k))
    return out if rows_are_samples else out.groupBy("accession", "kmer").agg(F.bit_or("flag").alias("flag"), F.sum("n").alias("n"))


def two_pass(reads: DataFrame, accession: str, seq: str, k: int, threshold: int) -> DataFrame:
    """(accession, kmer, flag): the k-mers seen `threshold` times or more in a sample, either spelling, with the strands seen
    in all its reads: what a canonical count with a threshold and a strand-aware count without one give together."""
    return count_stranded(reads, accession, seq, k).where(F.col("n") >= threshold).select("accession", "kmer", "flag")


def count_kmers(spellings: DataFrame, least: int = 1) -> DataFrame:
    """(accession, kmer, count) of k-mers seen `least` times in a sample, either spelling."""
    return spellings.groupBy("accession", "kmer").agg(F.sum("n").alias("count")).where(F.col("count") >= least)


def corpus_counts(spellings: DataFrame) -> DataFrame:
    """(kmer, count) over all samples."""
    return spellings.groupBy("kmer").agg(F.sum("n").alias("count"))


def count_histogram(counts: DataFrame, column: str = "count") -> DataFrame:
    """(appearance, n): how many rows have each count, dense from 0 to the largest."""
    seen = counts.groupBy(F.col(column).alias("appearance")).agg(F.count(F.lit(1)).alias("n"))
    dense = seen.agg(F.max("appearance").alias("top")).where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("appearance"))
    return dense.join(seen, "appearance", "left").select("appearance", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def strand_flags(counted: DataFrame, stranded: DataFrame, strict: bool = True) -> DataFrame:
    """(accession, kmer, flag): for each counted k-mer the union of the strands seen: 1, 2 or 3.

    With strict, a counted k-mer that no strand-aware row holds is an error;
    else its flag is 0.
    """
    seen = stranded.groupBy("accession", "kmer").agg(F.bit_or("flag").alias("flag"))
    flag = F.coalesce("flag", F.lit(0))
    if strict:
        flag = F.when(F.col("flag").isNull(), F.raise_error("k-mer without a strand").cast("int")).otherwise(F.col("flag"))
    return counted.select("accession", "kmer").join(seen, ["accession", "kmer"], "left").select("accession", "kmer", flag.alias("flag"))


def flag_distribution(flags: DataFrame) -> DataFrame:
    """(flag, n) for flags 0 to 3."""
    dense = flags.sparkSession.range(4).select(F.col("id").cast("int").alias("flag"))
    return dense.join(F.broadcast(flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))), "flag", "left").select("flag", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def strand_totals(stranded: DataFrame, least: int) -> DataFrame:
    """(total, matched): strand-aware k-mers of all samples (accession, kmer, flag, n), and how many of them were seen `least` times."""
    return stranded.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") >= least).alias("matched"))


def strand_match(counted: DataFrame, stranded: DataFrame) -> DataFrame:
    """(total, matched): strand-aware k-mers of all samples, and how many were also counted."""
    seen = stranded.select("accession", "kmer").distinct()
    hit = counted.select("accession", "kmer", F.lit(1).alias("hit"))
    return seen.join(hit, ["accession", "kmer"], "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"))
