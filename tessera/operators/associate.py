"""Association scores of k-mers and genotypes, and the best of each phenotype."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import minus_log10
from tessera.operators.presence import bits_of


def kmer_score(n, n1, y1, s, least):
    """(n Y1 - N1 S)^2 / (n N1 - N1^2); 0 if either side has fewer than `least` samples, or none."""
    d = n * n1 - n1 * n1
    enough = (n1 >= least) & (n - n1 >= least) & (d > 0)
    return F.when(enough, F.pow(n * y1 - n1 * s, 2) / F.when(d > 0, d)).otherwise(F.lit(0.0))


def kmer_scores(rows: DataFrame, pheno: DataFrame, columns: list[str], least: int) -> DataFrame:
    """(kmer, n1, phenotype, y1, score) of the k-mers with `least` samples or more on either side.

    rows: (kmer, accession).  pheno: (accession, one column per phenotype).  One
    shuffle by k-mer serves all phenotypes: their sums are columns of one aggregate.
    """
    totals = pheno.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in columns)).first()
    n = totals["n"]
    sums = rows.join(pheno.select("accession", *columns), "accession").groupBy("kmer")
    agg = sums.agg(F.count(F.lit(1)).alias("n1"), *(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).where(F.col("n1").between(least, n - least))
    long = agg.unpivot(["kmer", "n1"], columns, "phenotype", "y1")
    s = F.coalesce(*[F.when(F.col("phenotype") == c, F.lit(float(totals[f"s_{c}"] or 0))) for c in columns])
    return long.withColumn("score", kmer_score(F.lit(float(n)), F.col("n1").cast("double"), F.col("y1"), s, least))


class Best:
    """The best rows of one phenotype that a task has seen: greatest score, then least k-mer."""

    def __init__(self, most: int):
        self.most, self.parts, self.held, self.least = most, [], 0, -np.inf

    def add(self, kmers: np.ndarray, n1: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.least
        self.parts.append((kmers[ok], n1[ok], score[ok]))
        self.held += int(ok.sum())
        if self.held > 2 * self.most + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        kmers, n1, score = (np.concatenate(c) for c in zip(*self.parts))
        at = np.lexsort((kmers, -score))[: self.most]
        self.parts, self.held = [(kmers[at], n1[at], score[at])], len(at)
        if len(at) == self.most:
            self.least = score[at[-1]]
        return self.parts[0]


def packed_scores(packed: DataFrame, y: np.ndarray, names: list[str], least: int, best: int) -> DataFrame:
    """(phenotype, kmer, n1, score): the same for many phenotypes at once, on packed presence.

    packed: (kmer, pa).  y: samples x phenotypes.  Each task multiplies unpacked
    presence with y and passes on the `best` rows of each phenotype of all that it reads.
    """
    n, total = y.shape[0], y.sum(axis=0)
    step = max(1, (1 << 22) // max(n, 1))  # rows whose bits are spread out at once

    def run(batches):
        held = [Best(best) for _ in names]
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            x = bits_of(batch.column("pa"), n).astype(np.float64)
            kmers, n1 = batch.column("kmer").to_numpy(), x.sum(axis=1)
            ok = (n1 >= least) & (n - n1 >= least) & (n1 > 0) & (n1 < n)
            kmers, n1, x = kmers[ok], n1[ok], x[ok]
            score = (n * (x @ y) - n1[:, None] * total) ** 2 / (n * n1 - n1**2)[:, None]
            for p, of in enumerate(held):
                of.add(kmers, n1.astype(np.int64), score[:, p])
        for name, of in zip(names, held):
            if of.held:
                kmers, n1, score = of.cut()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kmers), pa.string()), pa.array(kmers), pa.array(n1), pa.array(score)], names=["phenotype", "kmer", "n1", "score"])

    return packed.select("kmer", "pa").mapInArrow(run, "phenotype string, kmer long, n1 long, score double")


def top(scores: DataFrame, best: int, first: str | None = None, first_best: int | None = None, key: str = "kmer") -> DataFrame:
    """The best rows of each phenotype with their rank, 1 the best; ties go to the lesser key.

    first_best is the number for the phenotype named `first`.  The limit is
    taken in each partition before the shuffle.
    """
    most = max(best, first_best or 0)
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("phenotype").orderBy(F.desc("score"), key))).where(F.col("rank") <= most)
    if first is None:
        return ranked.where(F.col("rank") <= best)
    return ranked.where(F.col("rank") <= F.when(F.col("phenotype") == first, first_best or best).otherwise(best))


def tested(rows: DataFrame, selected: DataFrame, n: int, least: int) -> DataFrame:
    """(tested): k-mers with enough samples on either side."""
    counts = rows.join(selected.select("accession").distinct(), "accession", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("n1"))
    return counts.where(F.col("n1").between(least, n - least)).agg(F.count(F.lit(1)).alias("tested"))


def dosage(code):
    """Two-bit genotype code to dosage: 0 -> 0, 2 -> one half, 3 -> 1, 1 missing."""
    return F.when(code == 0, 0.0).when(code == 2, 0.5).when(code == 3, 1.0)


def snp_stats(genotypes: DataFrame) -> DataFrame:
    """(snp_idx, n, g, g2): non-missing samples, sum of dosage and of its square. genotypes: (snp_idx, accession, dosage)."""
    g = F.col("dosage")
    return genotypes.groupBy("snp_idx").agg(F.count("dosage").alias("n"), F.coalesce(F.sum(g), F.lit(0.0)).alias("g"), F.coalesce(F.sum(g * g), F.lit(0.0)).alias("g2"))


def snp_quality(genotypes: DataFrame, n: int, maf: float = 0.0, most_missing: float = 0.5) -> DataFrame:
    """Rows of the SNPs whose rarer allele has a frequency of `maf` or more among the calls, and
    whose share of missing calls is `most_missing` or less. genotypes: (snp_idx, accession, dosage) of n samples."""
    calls, frequency = F.count("dosage"), F.avg("dosage")
    kept = genotypes.groupBy("snp_idx").agg(calls.alias("calls"), frequency.alias("af"))
    kept = kept.where((F.least(F.col("af"), 1 - F.col("af")) >= maf) & (n - F.col("calls") <= most_missing * n) & (F.col("calls") > 0))
    return genotypes.join(kept.select("snp_idx"), "snp_idx", "left_semi")


def snp_scores(genotypes: DataFrame, pheno: DataFrame, columns: list[str], mac: float) -> DataFrame:
    """(snp_idx, n, g, phenotype, score); 0 where dosage is less than mac on either side or doesn't vary."""
    g = F.col("dosage")
    joined = genotypes.where("dosage IS NOT NULL").join(pheno.select("accession", *columns), "accession")
    sums = [f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("y", F.sum), ("gy", lambda v: F.sum(g * v)))]
    agg = joined.groupBy("snp_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("g"), F.sum(g * g).alias("g2"), *sums)
    parts = F.array(*[F.struct(F.lit(c).alias("phenotype"), F.col(f"y_{c}").alias("y"), F.col(f"gy_{c}").alias("gy")) for c in columns])
    long = agg.select("snp_idx", F.col("n").cast("double").alias("n"), "g", "g2", F.explode(parts).alias("p")).select("snp_idx", "n", "g", "g2", "p.*")
    d = F.col("n") * (F.col("n") * F.col("g2") - F.col("g") * F.col("g"))
    ok = (F.col("g") >= mac) & (F.col("n") - F.col("g") >= mac) & (d > 0)
    score = F.when(ok, F.pow(F.col("n") * F.col("gy") - F.col("g") * F.col("y"), 2) / F.when(d > 0, d)).otherwise(F.lit(0.0))
    return long.select("snp_idx", F.col("n").cast("long").alias("n"), "g", "phenotype", score.alias("score"))


def best_pvals(tests: DataFrame) -> DataFrame:
    """(phenotype, best): -log10 of each phenotype's least p-value, 1 at the most. tests: (phenotype, variant, p)."""
    least = F.least(F.min("p"), F.lit(1.0))
    return tests.groupBy("phenotype").agg(F.when(least > 0, F.abs(F.log10(least))).otherwise(F.lit(float("inf"))).alias("best"))


def permutation_threshold(best: DataFrame, level: float, n: int) -> DataFrame:
    """(level, threshold): of the n permutations' best values the int(n * level)-th largest.

    best: (phenotype, best) of the permutations alone.  Fewer than one is an
    error; no permutations give no row.
    """
    k = int(n * level)
    if not n:
        return best.where("false").select(F.lit(level).alias("level"), F.col("best").alias("threshold"))
    if k < 1:
        raise ValueError(f"{n} permutations are too few for a level of {level}")
    ranked = best.orderBy(F.desc("best"), "phenotype").limit(k)
    return ranked.agg(F.lit(level).alias("level"), F.min("best").alias("threshold"))


def pass_threshold(tests: DataFrame, threshold: DataFrame) -> DataFrame:
    """Tests whose -log10 p is above the threshold (one row at most, read at once); p = 0 passes.
    Without a threshold nothing passes."""
    row = threshold.select("threshold").first()
    if row is None:
        return tests.where("false")
    return tests.where((F.col("p") == 0) | (minus_log10(F.col("p")) > row["threshold"]))
