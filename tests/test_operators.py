"""Operators against hand-made cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequences as S
from tessera.operators import associate, cohort, kinship, kmers, mixedmodel, phenotypes, presence
from tessera.plans import gwas

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


@pytest.mark.parametrize("k", [10, 15, 31])
def test_kmer_codes(spark, k):
    words = ["A" * k, "T" * k, ("AAAAATTTTT" * 4)[:k], "".join(random.Random(k).choice("ACGT") for _ in range(k))]
    df = spark.createDataFrame([(w,) for w in words], "kmer string")
    for r in df.select("kmer", S.pack_kmer(F.col("kmer")).alias("p"), S.strand_flag(F.col("kmer")).alias("f"), S.reverse_complement(S.reverse_complement(F.col("kmer"))).alias("same")).withColumn("back", S.unpack_kmer(F.col("p"), k)).collect():
        c = min(r["kmer"], rc(r["kmer"]))
        assert r["back"] == c and r["same"] == r["kmer"] and r["f"] == (1 if r["kmer"] < rc(r["kmer"]) else 2)
        assert r["p"] == int(c.translate(str.maketrans("ACGT", "0123")), 4)
    with pytest.raises(Exception, match="not a k-mer"):
        spark.createDataFrame([("ACNT",)], "kmer string").select(S.pack_kmer(F.col("kmer"))).collect()
    with pytest.raises(ValueError):
        S.check_k(32)


def brute(seqs, k):
    out = {}
    for who, s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                key = (who, min(w, rc(w)), 1 if w < rc(w) else 2)
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("k", [10, 31])
def test_counts_and_flags(spark, k):
    rng = random.Random(1)
    seqs = [(i % 6, "".join(rng.choice("ACGTN" if i == 2 else "AC") for _ in range(rng.randint(0, 90)))) for i in range(12)] + [(9, None), (9, "AAAAATTTTT")]
    sp = kmers.count_spellings(spark.createDataFrame(seqs, "who long, seq string"), "who", "seq", k)
    got = {(r["accession"], r["s"], r["flag"]): r["n"] for r in sp.withColumn("s", S.unpack_kmer(F.col("kmer"), k)).collect()}
    assert got == brute(seqs, k)
    stranded = kmers.count_stranded(spark.createDataFrame(seqs, "who long, seq string"), "who", "seq", k)
    both = {}
    for (who, word, flag), n in brute(seqs, k).items():
        f, m = both.get((who, word), (0, 0))
        both[who, word] = (f | flag, m + n)
    assert {(r["accession"], r["s"]): (r["flag"], r["n"]) for r in stranded.withColumn("s", S.unpack_kmer(F.col("kmer"), k)).collect()} == both
    assert tuple(kmers.strand_totals(stranded, 2).first()) == (len(both), sum(m >= 2 for _, m in both.values()))
    counted = kmers.count_kmers(sp, 2)
    flags = {(r[0], r[1]): r[2] for r in kmers.strand_flags(counted, sp).collect()}
    assert set(flags.values()) <= {1, 2, 3} and len(flags) == counted.count()
    hist = [tuple(r) for r in kmers.count_histogram(kmers.corpus_counts(sp)).orderBy("appearance").collect()]
    assert [h[0] for h in hist] == list(range(len(hist))) and hist[0][1] == 0
    assert sum(r["n"] for r in kmers.flag_distribution(kmers.strand_flags(counted, sp)).collect()) == len(flags)
    with pytest.raises(Exception, match="without a strand"):
        kmers.strand_flags(sp, sp.where("false")).collect()


def test_long_sequences(monkeypatch):
    """Pieces of a sequence give the counts of the whole."""
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGTN") if i % 50 == 0 else rng.choice("AC") for i in range(5000)).encode()
    whole = kmers.sequence_counts(seq, 11)
    monkeypatch.setattr(kmers, "PIECE", 37)
    for a, b in zip(whole, kmers.sequence_counts(seq, 11)):
        assert (a == b).all()


def test_sample_index(spark):
    for ids in ([f"n{i:03}" for i in range(300)], [None, "b", "a", "b"], []):
        df = spark.createDataFrame([(i,) for i in ids], "accession string").repartition(5)
        want = sorted(set(ids), key=lambda x: (x is not None, x or ""))
        assert {r["accession"]: r["col_idx"] for r in presence.sample_index(df).collect()} == {x: i for i, x in enumerate(want)}


def test_cohort(spark):
    # k-mer 1: five samples, flags 1 1 1 1 3; 2: below the count; 3: balanced exactly
    rows = [(1, a, f) for a, f in enumerate([1, 1, 1, 1, 3])] + [(2, 0, 1)] + [(3, a, f) for a, f in enumerate([1, 2, 2, 2, 2])]
    counts = cohort.sample_counts(spark.createDataFrame(rows, "kmer long, accession int, flag int"))
    assert [r["kmer"] for r in cohort.passing(counts, 5, 0.2).orderBy("kmer").collect()] == [1, 3]
    assert [r["kmer"] for r in cohort.not_passing(counts, 5, 0.4).orderBy("kmer").collect()] == [1, 3]
    assert tuple(cohort.totals(counts, 5, 0.2).first()) == (2, 0, 1)
    assert cohort.shareness(counts, 6).where("n_kmers > 0").count() == 2
    dense = cohort.dense_matrix(cohort.strand_histogram(counts, "both"), 5).collect()
    assert len(dense) == 6 and sum(dense[5][1:]) == 2


@pytest.mark.parametrize("n", [3, 64, 65, 128, 129])
def test_presence(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    x = rng.random((30, n)) < 0.4
    x[:, 0] = True
    rows = spark.createDataFrame([(k, int(a)) for k in range(30) for a in np.flatnonzero(x[k])], "kmer long, accession int")
    index = presence.sample_index(spark.range(n).selectExpr("cast(id as int) AS accession"))
    packed = presence.pack_presence(rows, index, n)
    assert {r["kmer"]: r["n1"] for r in packed.collect()} == dict(enumerate(x.sum(axis=1)))
    assert {r["kmer"]: r["presence"] for r in presence.presence_text(packed, n).collect()} == {k: "".join(map(str, x[k].astype(int))) for k in range(30)}
    chosen = [i for i in range(n) if i % 2 == 0]
    squeezed = presence.select_samples(packed, chosen, n)
    assert {r["kmer"]: r["presence"] for r in presence.presence_text(squeezed, len(chosen)).collect()} == {k: "".join(map(str, x[k, chosen].astype(int))) for k in range(30)}
    assert {r["kmer"]: r["n1"] for r in squeezed.collect()} == dict(enumerate(x[:, chosen].sum(axis=1)))
    assert presence.pattern_count(packed).first()[0] == len({tuple(r) for r in x}) == presence.pattern_rows(packed).count()
    m = presence.presence_matrix(packed, [f"s{i}" for i in range(n)]).orderBy("kmer").collect()
    assert (np.array([list(r)[1:] for r in m]) == x).all()
    bed = {(r["kmer"], r["byte_idx"]): r["byte"] for r in presence.bed_bytes(packed, n).collect()}
    assert all(((bed[k, i // 4] >> (2 * (i % 4))) & 3 == 3) == x[k, i] for k in range(30) for i in range(n))
    full = np.eye(n)
    sub = packed.where(F.col("n1").between(S.minimum_count(n, 0.2), n - S.minimum_count(n, 0.2)))
    kept = x[[r["kmer"] for r in sub.collect()]]
    full = kinship.full_matrix(kinship.kmer_kinship(packed, n, 0.2), n)
    assert np.allclose(full, [[(kept[:, i] == kept[:, j]).mean() for j in range(n)] for i in range(n)])
    whole = sorted(map(tuple, kinship.co_occurrence(sub, n).collect()))
    assert whole == sorted((i, j, int((kept[:, i] & kept[:, j]).sum()), int(kept[:, i].sum()), int(kept[:, j].sum()), len(kept)) for i in range(n) for j in range(i))
    near = sorted(map(tuple, kinship.relatedness(packed, n).collect()))
    p = x[(x.sum(axis=1) < n)].mean(axis=1, keepdims=True)
    g = (x[x.sum(axis=1) < n] - p) / np.sqrt(n * p * (1 - p))
    assert np.allclose([r for *_, r in near], [(g[:, i] * g[:, j]).mean() for i, j, _ in near]) and len(near) == n * (n + 1) // 2
    assert math.isclose(kinship.gamma(packed, np.ones((n, n)) + np.eye(n)), np.einsum("vi,ij,vj->", g, np.ones((n, n)) + np.eye(n), g) / len(g), rel_tol=1e-9, abs_tol=1e-9)
    assert kinship.gamma(packed, np.eye(n), max_variants=0) == 0.0
    monkeypatch.setattr(kinship, "MOST_DENSE", 0)
    monkeypatch.setattr(kinship, "BLOCK", 64)
    assert sorted(map(tuple, kinship.co_occurrence(sub, n).collect())) == whole
    again = sorted(map(tuple, kinship.relatedness(packed, n).collect()))
    assert [r[:2] for r in again] == [r[:2] for r in near] and np.allclose([r[2] for r in again], [r[2] for r in near])


def score(x, y, least):
    n, n1 = len(x), int(x.sum())
    if n1 < max(least, 1) or n - n1 < max(least, 1):
        return 0.0
    return (n * y[x == 1].sum() - n1 * y.sum()) ** 2 / (n * n1 - n1**2)


def test_scores(spark):
    rng = np.random.default_rng(5)
    n, m = 40, 60
    x, y = (rng.random((m, n)) < rng.random((m, 1))).astype(int), rng.normal(size=(n, 3))
    x[1] = 1 - x[0]
    rows = spark.createDataFrame([(k, int(a)) for k in range(m) for a in np.flatnonzero(x[k])], "kmer long, accession int")
    pheno = spark.createDataFrame([(i, *map(float, y[i])) for i in range(n)], "accession int, a double, b double, c double")
    got = {(r["phenotype"], r["kmer"]): r["score"] for r in associate.kmer_scores(rows, pheno, ["a", "b", "c"], 5).collect()}
    want = {("abc"[p], k): score(x[k], y[:, p], 5) for p in range(3) for k in range(m) if 5 <= x[k].sum() <= n - 5}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    index = presence.sample_index(pheno)
    packed = presence.pack_presence(rows, index, n)
    best = associate.top(associate.packed_scores(packed, y, ["a", "b", "c"], 5, 7), 7, "a", 3).collect()
    for p, limit in (("a", 3), ("b", 7), ("c", 7)):
        ranked = sorted((k for q, k in want if q == p), key=lambda k: (-want[p, k], k))[:limit]
        assert [r["kmer"] for r in sorted((r for r in best if r["phenotype"] == p), key=lambda r: r["rank"])] == ranked
    assert associate.tested(rows, pheno, n, 5).first()[0] == len(want) // 3


def dense_of(cells, n):
    out = np.eye(n)
    for r in cells.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["k"]
    return out


def test_snps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 30
    g = rng.choice([0, 0.5, 1, np.nan], size=(8, n))
    g[0], g[1], g[2] = np.nan, 0.5, (rng.random(n) < 0.5)
    y = rng.normal(size=n)
    cells = [(s, i, None if np.isnan(g[s, i]) else float(g[s, i])) for s in range(8) for i in range(n)]
    geno = spark.createDataFrame(cells, "snp_idx int, accession int, dosage double")
    pheno = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "accession int, y double")
    got = {r["snp_idx"]: r["score"] for r in associate.snp_scores(geno, pheno, ["y"], 5.0).collect()}
    for s in range(1, 8):
        ok = ~np.isnan(g[s])
        x, v, m = g[s, ok], y[ok], ok.sum()
        d = m * (m * (x**2).sum() - x.sum() ** 2)
        want = (m * (x @ v) - x.sum() * v.sum()) ** 2 / d if d > 0 and x.sum() >= 5 and m - x.sum() >= 5 else 0.0
        assert math.isclose(got[s], want, rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(score(g[2].astype(int), y, 5), n * got[2], rel_tol=1e-9)  # the two scales
    k = kinship.full_matrix(kinship.snp_kinship(geno.withColumnRenamed("accession", "i"), n), n)
    monkeypatch.setattr(kinship, "MOST_DENSE", 0)
    monkeypatch.setattr(kinship, "BLOCK", 8)
    assert np.allclose(dense_of(kinship.snp_kinship(geno.withColumnRenamed("accession", "i"), n), n), k)
    for method in ("dominant", "recessive"):
        for use in ("all", "complete.obs"):
            total, m = np.zeros((n, n)), 0
            for s in range(1, 8):
                mean = np.nanmean(g[s])
                x = np.where(g[s] == 0.5, float(mean > 0.5 if method == "dominant" else mean < 0.5), g[s])
                if use == "all" or not np.isnan(x).any():
                    x = np.where(np.isnan(x), np.nanmean(x), x)
                    total, m = total + np.outer(x, x) + np.outer(1 - x, 1 - x), m + 1
            np.fill_diagonal(total, m)
            assert 0 < m <= 7 and np.allclose(dense_of(kinship.snp_kinship(geno.withColumnRenamed("accession", "i"), n, method, use), n), total / m)
    with pytest.raises(ValueError):
        kinship.snp_kinship(geno.withColumnRenamed("accession", "i"), n, "other")
    kept = {r["snp_idx"] for r in associate.snp_quality(geno, n, 0.2, 0.25).collect()}
    assert kept == {s for s in range(1, 8) if np.isnan(g[s]).mean() <= 0.25 and min(np.nanmean(g[s]), 1 - np.nanmean(g[s])) >= 0.2}
    total = np.zeros((n, n))
    for s in range(1, 8):
        for het in (0.0, 1.0):
            x = np.where(g[s] == 0.5, het, g[s])
            x = np.where(np.isnan(x), np.nanmean(x), x)
            total += np.outer(x, x) + np.outer(1 - x, 1 - x)
    np.fill_diagonal(total, 14)
    assert np.allclose(k, total / 14)


def test_phenotypes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0)], "accession_id string, phenotype_value double")
    assert {tuple(r) for r in phenotypes.average(df).collect()} == {("a", 1.5), ("b", 3.0)}
    assert [tuple(r) for r in phenotypes.replicated(df).collect()] == [("a", 2)]
    p = spark.createDataFrame([("b", 0, 1.0), ("a", 1, 2.0), ("b", 2, 9.0), ("x", 3, 4.0)], "accession string, pos int, v double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    assert [tuple(r) for r in phenotypes.align(p, names, names.where("accession <> 'c'")).orderBy("pos").collect()] == [("b", 0, 1.0), ("a", 1, 2.0)]
    assert {r["fid"]: r["phenotype"] for r in phenotypes.full_fam(names, p.where("pos < 2"), "v").collect()} == {"a": 2.0, "b": 1.0, "c": -9.0}
    with pytest.raises(Exception, match="repeats"):
        phenotypes.require_all(p, names).collect()
    with pytest.raises(Exception, match="unknown"):
        phenotypes.require_all(p.where("pos = 3"), names).collect()


@pytest.mark.parametrize("n, at5, at10", [(100, 95, 90), (20, 19, 18)])
def test_thresholds(spark, n, at5, at10):
    best = spark.createDataFrame([(f"P{i}", float(i)) for i in range(n)], "phenotype string, best double")
    assert associate.permutation_threshold(best, 0.05, n).first()["threshold"] == at5
    assert associate.permutation_threshold(best, 0.10, n).first()["threshold"] == at10
    with pytest.raises(ValueError):
        associate.permutation_threshold(best, 0.05, 10)
    assert associate.permutation_threshold(best.where("false"), 0.05, 0).count() == 0
    tests = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.01), ("a", 3, 0.5)], "phenotype string, variant int, p double")
    assert {r["variant"] for r in associate.pass_threshold(tests, spark.createDataFrame([(1.0,)], "threshold double")).collect()} == {1, 2}
    assert associate.best_pvals(tests.where("p > 0")).first()["best"] == pytest.approx(2)


def test_mixed_model():
    rng = np.random.default_rng(2)
    n = 80
    a = rng.normal(size=(n, 200))
    k = a @ a.T / 200
    y = 2 + np.linalg.cholesky(0.8 * k + 0.2 * np.eye(n)) @ rng.normal(size=n)
    fit = mixedmodel.reml(y, k)
    # the likelihood at the optimum is no less than on a fine grid
    lam, u = mixedmodel.residual_spectrum(k, np.ones((n, 1)))
    assert fit.likelihood >= max(mixedmodel._reml(t, lam, (u.T @ y) ** 2)[0] for t in np.linspace(-10, 10, 2001)) - 1e-9
    flat = mixedmodel.ml_no_x(y, k)
    own, basis = np.linalg.eigh(k)
    assert flat.likelihood >= max(mixedmodel._ml(t, own, (basis.T @ y) ** 2, own)[0] for t in np.linspace(-10, 10, 2001)) - 1e-9
    cov = flat.vg * k + flat.ve * np.eye(n)  # it is the normal density at these components
    assert math.isclose(flat.likelihood, -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y)), rel_tol=1e-9)
    moved = mixedmodel.transform_and_permute(y, k, 30, seed=1)
    again = mixedmodel.transform_and_permute(y, k, 30, seed=1)
    assert (moved["permuted"] == again["permuted"]).all() and moved["permuted"].shape == (n, 31)
    assert abs(moved["permuted"][:, 0].mean()) < 1e-9
    x = (rng.random(n) < 0.5).astype(float)
    assert mixedmodel.lrt(y, k, np.ones(n)) == 1.0
    assert mixedmodel.lrt(y + 5 * x, k, x) < 1e-6
    x[3] = np.nan
    assert 0 < mixedmodel.lrt(y, k, x) <= 1
    assert mixedmodel.chi2_tail(3.841458820694124) == pytest.approx(0.05)
    assert mixedmodel.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert mixedmodel.reml_t(y + 5 * np.nan_to_num(x), k, np.nan_to_num(x)) < 1e-6
    with pytest.raises(ValueError):
        mixedmodel.check_semidefinite(-np.eye(3))


def test_study(spark):
    rng = np.random.default_rng(4)
    n, m = 50, 120
    x = rng.random((m, n)) < 0.4
    y = x[7] * 3 + rng.normal(size=n)
    rows = spark.createDataFrame([(k, f"s{a:02}") for k in range(m) for a in np.flatnonzero(x[k])], "kmer long, accession string")
    pheno = spark.createDataFrame([(f"s{i:02}", float(v)) for i, v in enumerate(y)] + [("absent", 1.0)], "accession string, phenotype_value double")
    study = gwas.kmer_study(rows, pheno, kmers_number=5, permutations=20, maf=0.1, pattern_counter=True)
    top = study.scores.where("phenotype = 'phenotype_value' AND rank = 1").first()
    assert top["kmer"] == 7 and study.passing[0.05].where("kmer = 7").count() == 1
    assert study.thresholds.count() == 2 and study.patterns.first()[0] <= study.tested.first()[0]
    with pytest.raises(gwas.NotEnoughData):
        gwas.kmer_study(rows, pheno, min_data_points=60)
    geno = spark.createDataFrame([(s, f"s{a:02}", float(x[s, a])) for s in range(6, 10) for a in range(n)], "snp_idx int, accession string, dosage double")
    k = np.eye(n)
    two = gwas.snp_study(geno, pheno, k, [f"s{i:02}" for i in range(n)], best=2, permutations=3)
    assert two.groupBy("phenotype").count().orderBy("phenotype").collect()[0]["count"] == 2
    assert min(two.where("phenotype = 'phenotype_value'").collect(), key=lambda r: r["p"])["snp_idx"] == 7
