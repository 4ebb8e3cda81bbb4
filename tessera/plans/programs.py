"""The study's programs, one call each, over files: the same steps and defaults as the functions they are made of.

Paths may be local or on a file system that pyarrow knows.  `base` names a
k-mers table without its ending (.table, .names, .kinship).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequences import check_k, check_positive, minimum_count, popcount, unpack_kmer
from tessera.operators import associate, cohort, kinship, kmers, mixedmodel, phenotypes, presence
from tessera.plans import gwas
from tessera.sources import binary, text

Files = list[tuple[str, str]]  # (path, accession), in the order of the samples' bits


def strand_file(reads: DataFrame, out: str, k: int, threshold: int = 2) -> None:
    """Sorted k-mers with their strands of one sample's reads (accession, seq): those seen `threshold` times or more."""
    binary.write_sorted_kmers(kmers.two_pass(reads, "accession", "seq", k, threshold), out)


def cohort_files(spark: SparkSession, files: Files, out: str, k: int, mac: int = 5, min_strand_percent: float = 0.2) -> dict[str, int]:
    """The cohort list of samples' sorted k-mers, out; what fails the strand filter alone, out.no_pass_kmers; and
    statistics: out.shareness and out.stats.{only_canonical,only_non_canonical,both}. Returns the overall numbers."""
    check_k(k)
    counts = cohort.sample_counts(binary.read_samples(spark, files)).persist()
    binary.write_sorted_kmers(cohort.passing(counts, mac, min_strand_percent).select("kmer"), out)
    text.write_no_pass(cohort.not_passing(counts, mac, min_strand_percent), out + ".no_pass_kmers", k)
    _write(cohort.shareness(cohort.passing(counts, mac, min_strand_percent), len(files)).orderBy("count_all"), out + ".shareness")
    for strand, name in (("canonical", "only_canonical"), ("non_canonical", "only_non_canonical"), ("both", "both")):
        _write(cohort.strand_histogram(counts, strand).orderBy("count_all", "count_strand"), f"{out}.stats.{name}")
    totals = cohort.totals(counts, mac, min_strand_percent).first().asDict()
    counts.unpersist()
    return totals


def table_files(spark: SparkSession, files: Files, all_kmers: str, out: str, k: int) -> None:
    """The presence table of a cohort list over samples' sorted k-mers: out.table and out.names. K-mers of no sample have empty rows."""
    check_k(k)
    binary.register(spark)
    wanted = spark.read.format("sorted_kmers").option("path", all_kmers).load().select("kmer")
    index = spark.createDataFrame([(a, i) for i, (_, a) in enumerate(files)], "accession string, col_idx int")
    rows = presence.presence_rows(wanted, binary.read_samples(spark, files))
    binary.write_kmers_table(presence.pack_presence(rows, index, len(files)), out, [a for _, a in files], k)


def _table(spark: SparkSession, base: str, k: int, names: list[str], selected: list[str] | None = None, least: int = 0) -> DataFrame:
    """(kmer, pa, n1) of a table, for the selected samples in their order, with `least` of them or more on either side."""
    binary.register(spark)
    reader = spark.read.format("kmers_table").option("path", base + ".table").option("n", len(names)).option("k", k)
    if selected is not None:
        at = {a: i for i, a in enumerate(names)}
        reader = reader.option("columns", json.dumps([at[a] for a in selected])).option("min_count", least)
    return reader.load().withColumn("n1", popcount(F.col("pa")).cast("long"))


def kmer_kinship_file(spark: SparkSession, base: str, k: int, maf: float = 0.05) -> None:
    """base.kinship: the matrix of the table's samples."""
    names = text.read_names(base + ".names")
    text.write_cells(kinship.kmer_kinship(_table(spark, base, k, names), len(names), maf), len(names), base + ".kinship")


def snp_kinship_file(spark: SparkSession, base: str, out: str | None = None, method: str = "additive") -> None:
    """The kinship matrix of a bed/bim/fam set."""
    binary.register(spark)
    n = len(binary.fam_names(base + ".fam"))
    text.write_cells(kinship.snp_kinship(dosages(spark, base).withColumnRenamed("sample", "i"), n, method), n, out or base + ".kinship")


def dosages(spark: SparkSession, base: str) -> DataFrame:
    """(snp_idx, sample, dosage) of a bed/bim/fam set; a missing call is null."""
    binary.register(spark)
    cells = spark.read.format("plink_bed").option("path", base).load().select("snp_idx", F.posexplode("codes").alias("sample", "code"))
    return cells.select("snp_idx", F.col("sample").cast("long").alias("sample"), associate.dosage(F.col("code")).alias("dosage"))


def presence_file(spark: SparkSession, base: str, kmers_file: str, out: str) -> None:
    """Presence of a list of k-mers in all samples of a table, tab-separated with a header."""
    wanted = text.read_kmer_list(spark, kmers_file).persist()
    width = wanted.agg(F.max("length").alias("k")).first()["k"]
    if width is None:
        raise ValueError(f"{kmers_file} holds no k-mers")
    names = text.read_names(base + ".names")
    found = presence.lookup(_table(spark, base, width, names), wanted).orderBy("kmer")
    text.write_presence_matrix(presence.presence_matrix(found, names).withColumn("kmer", unpack_kmer(F.col("kmer"), width)), out)
    wanted.unpersist()


def _phenotype(spark: SparkSession, path: str, names: list[str]) -> tuple[list[str], dict[str, dict[str, float]]]:
    """Samples in order of the table and the values of each phenotype, of a file whose samples have to be in the table once each."""
    df = text.read_phenotypes(spark, path)
    known = spark.createDataFrame([(a,) for a in names], "accession string")
    rows = phenotypes.require_all(df.withColumnRenamed(df.columns[0], "accession"), known).toPandas()  # as many rows as samples
    order = [a for a in names if a in set(rows["accession"])]
    return order, {c: dict(zip(rows["accession"], rows[c])) for c in rows.columns if c != "accession"}


def bed_files(spark: SparkSession, base: str, phenotype_file: str, out: str, k: int, maf: float = 0.05, mac: int = 5, batch_size: int = 10_000_000, unique_patterns: bool = False) -> list[str]:
    """The table's k-mers for the samples of a phenotype file as sets out.0, out.1 and so on; the fam holds its first phenotype."""
    check_positive(batch_size=batch_size)
    names = text.read_names(base + ".names")
    order, values = _phenotype(spark, phenotype_file, names)
    rows = _table(spark, base, k, names, order, minimum_count(len(order), maf, mac))
    return binary.write_bed_batches(rows, out, order, k, batch_size, next(iter(values.values())), unique_patterns)


def best_kmers_files(
    spark: SparkSession, base: str, phenotype_file: str, out: str, k: int, best: int = 1_000_000, first_phenotype_best: int | None = None,
    maf: float = 0.05, mac: int = 5, kmers_scores: bool = False, pattern_counter: bool = False,
) -> list[str]:
    """The best k-mers of each phenotype of a wide file as sets out.<number>.<phenotype>, named <kmer>_<rank>, with
    out.tested_kmers and, on request, out.<number>.best_kmers.scores and out.pattern_counter."""
    check_positive(best=best, first_phenotype_best=first_phenotype_best)
    names = text.read_names(base + ".names")
    order, values = _phenotype(spark, phenotype_file, names)
    least = minimum_count(len(order), maf, mac)
    rows = _table(spark, base, k, names, order, least).persist()
    y = np.column_stack([[values[p][a] for a in order] for p in values])
    scores = associate.packed_scores(rows, y, list(values), least, max(best, first_phenotype_best or 0))
    top = associate.top(scores, best, next(iter(values)), first_phenotype_best).persist()
    numbered = {f"{i}.{p}": values[p] for i, p in enumerate(values)}
    label = F.element_at(F.create_map(*(F.lit(x) for i, p in enumerate(values) for x in (p, f"{i}.{p}"))), F.col("phenotype"))
    paths = binary.write_bed_top(rows, top.withColumn("phenotype", label), out, order, k, numbered)
    binary.write_lines(out + ".tested_kmers", [str(rows.count())])
    if kmers_scores:
        for i, p in enumerate(values):
            binary.write_scores(top.where(F.col("phenotype") == p), f"{out}.{i}.best_kmers.scores")
    if pattern_counter:
        binary.write_lines(out + ".pattern_counter", [str(presence.pattern_count(rows).first()["patterns"])])
    top.unpersist()
    rows.unpersist()
    return paths


def best_snps_files(spark: SparkSession, phenotype_file: str, base: str, out: str, best: int = 10_001, maf: float = 0.05, mac: int = 5) -> list[str]:
    """The best SNPs of each phenotype of a wide file as sets out.<phenotype>, cut out of the genotypes in one pass."""
    order, values = _phenotype(spark, phenotype_file, binary.fam_names(base + ".fam"))
    names = {a: i for i, a in enumerate(binary.fam_names(base + ".fam"))}
    pheno = spark.createDataFrame([(names[a], *(float(values[p][a]) for p in values)) for a in order], "accession long, " + ", ".join(f"`{p}` double" for p in values))
    scores = associate.snp_scores(dosages(spark, base).withColumnRenamed("sample", "accession"), pheno, list(values), float(minimum_count(len(order), maf, mac)))
    top = associate.top(scores, best, key="snp_idx").select(F.col("phenotype").alias("list"), "snp_idx").persist()
    paths = binary.write_snp_subsets(spark, base, top, out)
    top.unpersist()
    return paths


def histogram_file(reads: DataFrame, k: int, out: str) -> None:
    """How many k-mers of the reads (accession, seq) occur how often, dense from 0, tab-separated."""
    counts = kmers.corpus_counts(kmers.count_spellings(reads, "accession", "seq", k, rows_are_samples=True))
    _write(kmers.count_histogram(counts).orderBy("appearance"), out)


def aligned_files(spark: SparkSession, phenotype_file: str, names: list[str], kinship_file: str, out_phenotype: str, out_kinship: str, dbs: list[str]) -> list[str]:
    """Phenotypes and kinship of the samples that all of the phenotype file, the kinship's names and the tables' names hold, in
    the kinship's order; of repeated samples the first stays. Returns the samples."""
    df = text.read_phenotypes(spark, phenotype_file)
    value = df.columns[1]
    rows = df.withColumnRenamed(df.columns[0], "accession").withColumn("pos", F.monotonically_increasing_id())
    some = lambda who: spark.createDataFrame([(a,) for a in who], "accession string")
    held = {r["accession"]: r[value] for r in phenotypes.align(rows, some(names), some(dbs)).collect()}  # as many as samples
    order = [a for a in names if a in held]
    index = spark.createDataFrame([(names.index(a), i) for i, a in enumerate(order)], "old long, new long")
    cells = kinship.submatrix(text.read_cells(spark, kinship_file).where("i > j"), index)
    text.write_cells(cells, len(order), out_kinship)
    binary.write_lines(out_phenotype, [f"accession_id\t{value}", *(f"{a}\t{held[a]:g}" for a in order)])
    return order


def permuted_files(spark: SparkSession, phenotype_file: str, kinship_file: str, permutations: int, out_permuted: str, out_transformed: str, log: str, seed: int = 0) -> mixedmodel.Fit:
    """A phenotype with its permutations, and both whitened, as wide files; the variance components as log."""
    rows = text.read_phenotypes(spark, phenotype_file)
    local = [(r[0], r[1]) for r in rows.withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()]  # as many as samples
    moved = mixedmodel.transform_and_permute(np.array([v for _, v in local], float), mixedmodel.mended(text.read_matrix(kinship_file)), permutations, seed)
    for name, path in (("permuted", out_permuted), ("transformed", out_transformed)):
        lines = ["\t".join([a, *(f"{x:.12g}" for x in row)]) for (a, _), row in zip(local, moved[name])]
        binary.write_lines(path, ["\t".join(["accession_id", *moved["names"]]), *lines])
    fit = moved["fit"]
    binary.write_lines(log, [f"vg\t{fit.vg:.9g}", f"ve\t{fit.ve:.9g}", f"herit\t{fit.heritability:.9g}"])
    return fit


def kmer_study(
    spark: SparkSession, base: str, phenotype_file: str, outdir: str, k: int, kmers_number: int = 10_001, first_number: int | None = None, permutations: int = 100,
    maf: float = 0.05, mac: int = 5, min_data_points: int = 30, pattern_counter: bool = False, seed: int = 0, compression: str = "gzip",
) -> gwas.Study | None:
    """The whole study of one phenotype on a table, its results in the folder outdir, which must not exist.

    Written are log_file, components.log, best_kmers, tests, best_pvals, and for each level
    threshold_<percent>per and pass_threshold_<percent>per.  With fewer samples
    than min_data_points the folder has NOT_ENOUGH_DATA and the log alone, and
    nothing is returned.  base.kinship is used where it is, else computed.
    """
    check_positive(kmers_number=kmers_number, first_number=first_number, min_data_points=min_data_points)
    check_k(k)
    if binary.exists(outdir):
        raise ValueError(f"{outdir} exists already")
    names = text.read_names(base + ".names")
    settings = {"table": base, "phenotypes": phenotype_file, "k": k, "kmers_number": kmers_number, "permutations": permutations, "maf": maf, "mac": mac, "min_data_points": min_data_points, "seed": seed}
    log = [json.dumps(settings)]
    pheno = text.read_phenotypes(spark, phenotype_file)
    replicated = phenotypes.replicated(pheno, pheno.columns[0]).count()
    log.append(f"{replicated} samples have several values, which are averaged" if replicated else "every sample has one value")
    value = phenotypes.average(pheno, pheno.columns[0], pheno.columns[1]).withColumnRenamed("accession_id", "accession")
    index = spark.createDataFrame(list(enumerate(names)), "col_idx int, accession string").select("accession", "col_idx")
    given = None
    if binary.exists(base + ".kinship"):
        cells = text.read_cells(spark, base + ".kinship").where("i > j")
        i, j = index.select(F.col("accession").alias("accession_i"), F.col("col_idx").alias("i")), index.select(F.col("accession").alias("accession_j"), F.col("col_idx").alias("j"))
        given = cells.join(i, "i").join(j, "j").select("accession_i", "accession_j", "k")
        given = given.union(spark.createDataFrame([(a, a, 1.0) for a in names], "accession_i string, accession_j string, k double"))
    rows = presence.unpack_presence(_table(spark, base, k, names), index)
    try:
        study = gwas.kmer_study(rows, value, given, kmers_number, first_number, permutations, maf, mac, min_data_points, pattern_counter, seed)
    except gwas.NotEnoughData as error:
        binary.write_lines(f"{outdir}/NOT_ENOUGH_DATA", [])
        binary.write_lines(f"{outdir}/log_file", [*log, str(error)])
        return None
    word = unpack_kmer(F.col("kmer"), k).alias("kmer")
    _write(study.scores.select("phenotype", word, "n1", "score", "rank").orderBy("phenotype", "rank"), f"{outdir}/best_kmers", compression)
    _write(study.tests.select("phenotype", word, "p").orderBy("phenotype", "p", "kmer"), f"{outdir}/tests", compression)
    _write(study.best.orderBy("phenotype"), f"{outdir}/best_pvals")
    for r in study.thresholds.collect() if study.thresholds is not None else []:
        percent = round(r["level"] * 100)
        binary.write_lines(f"{outdir}/threshold_{percent}per", [f"{r['threshold']:f}"])
        _write(study.passing[r["level"]].select("phenotype", word, "p").orderBy("p", "kmer"), f"{outdir}/pass_threshold_{percent}per")
    fit = study.fit
    binary.write_lines(f"{outdir}/components.log", [f"vg\t{fit.vg:.9g}", f"ve\t{fit.ve:.9g}", f"herit\t{fit.heritability:.9g}"])
    log.append(f"effective maf {study.effective_maf:g}; {study.tested.first()['tested']} k-mers tested")
    if study.patterns is not None:
        log.append(f"{study.patterns.first()['patterns']} patterns")
    binary.write_lines(f"{outdir}/log_file", log)
    return study


def snp_study(
    spark: SparkSession, base: str, phenotype_file: str, outdir: str, two_steps: bool = True, snps_number: int = 10_001, permutations: int = 100,
    maf: float = 0.05, mac: int = 5, most_missing: float = 0.5, seed: int = 0, compression: str = "gzip",
) -> DataFrame:
    """The study of one phenotype on a bed/bim/fam set: p-values of each phenotype under outdir/<phenotype>, best_pvals and
    thresholds. In one step every SNP is tested for every permutation, in two only their best. base.kinship is used where
    it is, else computed. Returns the tests (phenotype, snp_idx, p)."""
    check_positive(snps_number=snps_number)
    names = binary.fam_names(base + ".fam")
    df = text.read_phenotypes(spark, phenotype_file)
    value = phenotypes.average(df, df.columns[0], df.columns[1]).withColumnRenamed("accession_id", "accession")
    held = {r["accession"]: r["phenotype_value"] for r in value.collect()}  # as many as samples
    order = [i for i, a in enumerate(names) if a in held]
    if not binary.exists(base + ".kinship"):
        snp_kinship_file(spark, base)
    matrix = mixedmodel.mended(text.read_matrix(base + ".kinship")[np.ix_(order, order)])
    pheno = spark.createDataFrame([(i, float(held[names[i]])) for i in order], "accession long, phenotype_value double")
    calls = dosages(spark, base).withColumnRenamed("sample", "accession")
    tests = gwas.snp_study(calls, pheno, matrix, order, snps_number if two_steps else None, permutations, minimum_count(len(order), maf, mac), seed, maf, most_missing).persist()
    for p in ["phenotype_value", *(f"P{i + 1}" for i in range(permutations))]:
        _write(tests.where(F.col("phenotype") == p).select("snp_idx", "p").orderBy("snp_idx"), f"{outdir}/{p}", compression)
    best = associate.best_pvals(tests).persist()
    _write(best.orderBy("phenotype"), f"{outdir}/best_pvals")
    permuted, real = best.where("phenotype <> 'phenotype_value'"), tests.where("phenotype = 'phenotype_value'")
    for level in (0.05, 0.10):
        if int(permutations * level) >= 1:
            threshold = associate.permutation_threshold(permuted, level, permutations)
            percent = round(level * 100)
            binary.write_lines(f"{outdir}/threshold_{percent}per", [f"{threshold.first()['threshold']:f}"])
            _write(associate.pass_threshold(real, threshold).select("snp_idx", "p").orderBy("p", "snp_idx"), f"{outdir}/pass_threshold_{percent}per")
    best.unpersist()
    return tests


def _write(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).csv(path, sep="\t", header=True)
