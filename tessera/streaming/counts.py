"""Incremental counting: new samples arrive as a stream, counts of samples per k-mer add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sample_counts(flags: DataFrame) -> DataFrame:
    """(kmer, count_all, canonical, non_canonical, both) of a stream of (accession, kmer, flag), as a
    running aggregate; a sample must arrive once.  Write it in complete or update mode."""
    of = lambda f: F.sum(F.when(F.col("flag") == f, 1).otherwise(0))
    return flags.groupBy("kmer").agg(F.count(F.lit(1)).alias("count_all"), of(1).alias("canonical"), of(2).alias("non_canonical"), of(3).alias("both"))
