"""Phenotype tables: averages over replicates, alignment, defaults, centring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING = -9.0


def average(df: DataFrame, accession: str = "accession_id", value: str = "phenotype_value") -> DataFrame:
    """(accession_id, phenotype_value): mean per sample."""
    return df.groupBy(F.col(accession).alias("accession_id")).agg(F.avg(value).alias("phenotype_value"))


def replicated(df: DataFrame, accession: str = "accession_id") -> DataFrame:
    """(accession_id, n) of samples with several rows."""
    return df.groupBy(F.col(accession).alias("accession_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def align(pheno: DataFrame, *orders: DataFrame) -> DataFrame:
    """Rows of `pheno` (accession, pos, ...) whose accession is in every one of `orders`; of repeats the first stays.

    `pos` gives the order of the rows and is kept.
    """
    first = Window.partitionBy("accession").orderBy("pos")
    out = pheno.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    for o in orders:
        out = out.join(o.select("accession").distinct(), "accession", "left_semi")
    return out


def require_all(pheno: DataFrame, names: DataFrame) -> DataFrame:
    """`pheno` as it is; an error for an accession that repeats or isn't among `names`."""
    known = names.select("accession", F.lit(True).alias("__known")).distinct()
    times = F.count(F.lit(1)).over(Window.partitionBy("accession"))
    checked = pheno.withColumn("__times", times).join(known, "accession", "left")
    ok = F.when(F.col("__times") > 1, F.raise_error(F.concat(F.lit("accession repeats: "), "accession")).cast("boolean")).when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown accession: "), "accession")).cast("boolean")).otherwise(True)
    return checked.where(ok).drop("__times", "__known")


def full_fam(names: DataFrame, pheno: DataFrame, value: str = "phenotype_value") -> DataFrame:
    """(fid, iid, father, mother, sex, phenotype) for all names; missing values become -9."""
    joined = names.select("accession").join(pheno.select("accession", F.col(value).alias("v")), "accession", "left")
    zero = F.lit(0)
    return joined.select(F.col("accession").alias("fid"), F.col("accession").alias("iid"), zero.alias("father"), zero.alias("mother"), zero.alias("sex"), F.coalesce("v", F.lit(MISSING)).alias("phenotype"))


def to_long(wide: DataFrame, accession: str = "accession_id") -> DataFrame:
    """(accession, phenotype, value) of a wide table."""
    values = [c for c in wide.columns if c != accession]
    return wide.withColumnRenamed(accession, "accession").unpivot("accession", values, "phenotype", "value").withColumn("value", F.col("value").cast("double"))


def centre(df: DataFrame, value: str = "value", by: str = "phenotype") -> DataFrame:
    """Values less their phenotype's mean. The means are aggregated and joined, so no phenotype is held by one task."""
    means = df.groupBy(by).agg(F.avg(value).alias("__mean"))
    return df.join(means, by).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")
