"""The programs over files, from reads to passing k-mers, each step against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.operators import mixedmodel
from tessera.plans import programs
from tessera.sources import binary, text

K, N = 11, 40
SWAP = str.maketrans("ACGT", "TGCA")


def canonical(w):
    return min(w, w[::-1].translate(SWAP))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Samples' reads, their sorted k-mers on disk, the cohort list and the table."""
    rng, base = random.Random(9), str(tmp_path_factory.mktemp("study"))
    parts = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(14)]
    held = [[p for p in range(14) if rng.random() < 0.3 + 0.03 * p] for _ in range(N)]
    held[0] = list(range(14))
    reads, seen = {}, []
    for s in range(N):
        reads[s] = [x for p in held[s] for x in [parts[p], parts[p] if p == 3 or s % 3 else parts[p][::-1].translate(SWAP)]] + ["".join(rng.choice("ACGT") for _ in range(15))]
        at = {}
        for r in reads[s]:
            for i in range(len(r) - K + 1):
                n, flag = at.get(canonical(r[i : i + K]), (0, 0))
                at[canonical(r[i : i + K])] = (n + 1, flag | (1 if r[i : i + K] == canonical(r[i : i + K]) else 2))
        seen.append({w: f for w, (n, f) in at.items() if n >= 2})
    files = []
    for s in range(N):
        df = spark.createDataFrame([(f"s{s:02}", r) for r in reads[s]], "accession string, seq string")
        programs.strand_file(df, f"{base}/k{s}", K)
        files.append((f"{base}/k{s}", f"s{s:02}"))
    totals = programs.cohort_files(spark, files, f"{base}/all", K, 5, 0.2)
    programs.table_files(spark, files, f"{base}/all", f"{base}/t", K)
    programs.kmer_kinship_file(spark, f"{base}/t", K, 0.05)
    return base, seen, totals, held


def cohort_of(seen):
    flags = {}
    for at in seen:
        for w, f in at.items():
            flags.setdefault(w, []).append(f)
    ok, low, bad = set(), 0, {}
    for w, fs in flags.items():
        least = math.ceil(0.2 * len(fs))
        if len(fs) < 5:
            low += 1
        elif sum(f & 1 > 0 for f in fs) >= least and sum(f & 2 > 0 for f in fs) >= least:
            ok.add(w)
        else:
            bad[w] = (len(fs), fs.count(1), fs.count(2), fs.count(3))
    return ok, bad, low


def word(v):
    return "".join("ACGT"[v >> 2 * i & 3] for i in reversed(range(K)))


def test_lists_and_table(spark, made):
    base, seen, totals, _ = made
    ok, bad, low = cohort_of(seen)
    assert ok and bad and totals == {"pass": len(ok), "no_pass": len(bad), "low_count": low}
    got = [word(r["kmer"]) for r in spark.read.format("sorted_kmers").option("path", f"{base}/all").load().collect()]
    assert got == sorted(ok)
    assert {r["kmer"]: tuple(r)[1:] for r in text.read_no_pass(spark, f"{base}/all.no_pass_kmers").collect()} == bad
    shareness = spark.read.csv(f"{base}/all.shareness", sep="\t", header=True, inferSchema=True).collect()
    assert len(shareness) == N + 1 and sum(r["n_kmers"] for r in shareness) == len(ok)
    rows = spark.read.format("kmers_table").option("path", f"{base}/t.table").load().collect()
    assert {word(r["kmer"]): {i for i in range(N) if r["pa"][i // 64] >> i % 64 & 1} for r in rows} == {w: {i for i, at in enumerate(seen) if w in at} for w in ok}


def test_kinship_files(spark, made, tmp_path):
    base, seen, _, _ = made
    ok = cohort_of(seen)[0]
    x = np.array([[w in at for at in seen] for w in ok if 2 <= sum(w in at for at in seen) <= N - 2])
    want = [[(x[:, i] == x[:, j]).mean() for j in range(N)] for i in range(N)]
    assert np.allclose(text.read_matrix(f"{base}/t.kinship"), want, atol=1e-5)
    for split in (64 << 20, 100):
        cells = {(r["i"], r["j"]): r["k"] for r in text.read_cells(spark, f"{base}/t.kinship", split).collect()}
        assert np.allclose([[cells[i, j] for j in range(N)] for i in range(N)], want, atol=1e-5)
    names = text.read_names(f"{base}/t.names")
    p = tmp_path / "p.tsv"
    p.write_text("accession_id\ty\nabsent\t1\ns07\t2.5\ns03\t1\ns07\t9\n")
    order = programs.aligned_files(spark, str(p), names, f"{base}/t.kinship", str(tmp_path / "o.tsv"), str(tmp_path / "o.kinship"), names[:20])
    assert order == ["s03", "s07"] and (tmp_path / "o.tsv").read_text() == "accession_id\ty\ns03\t1\ns07\t2.5\n"
    assert np.allclose(text.read_matrix(str(tmp_path / "o.kinship")), [[1, want[3][7]], [want[3][7], 1]], atol=1e-5)


def test_filter_kmers(spark, made, tmp_path):
    base, seen, _, _ = made
    ok = sorted(cohort_of(seen)[0])
    (tmp_path / "k").write_text(f"{ok[0][::-1].translate(SWAP)} {ok[3]}\n{'A' * K}\n")
    programs.presence_file(spark, f"{base}/t", str(tmp_path / "k"), str(tmp_path / "out"))
    rows = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()
    assert {r["kmer"]: [int(v) for v in list(r)[1:]] for r in rows} == {w: [int(w in at) for at in seen] for w in (ok[0], ok[3])}
    (tmp_path / "k").write_text("\n")
    with pytest.raises(ValueError):
        programs.presence_file(spark, f"{base}/t", str(tmp_path / "k"), str(tmp_path / "out2"))


def phenotype(tmp_path, held, n=N):
    rng = np.random.default_rng(3)
    p = tmp_path / "pheno.tsv"
    values = [2.0 * (6 in held[s]) + rng.normal() * 0.3 for s in range(n)]
    p.write_text("accession_id\tphenotype_value\tother\n" + "".join(f"s{s:02}\t{values[s]:.6f}\t{rng.normal():.6f}\n" for s in range(n)))
    return str(p), values


def test_exports_and_associations(spark, made, tmp_path):
    base, seen, _, held = made
    path, values = phenotype(tmp_path, held, 30)
    ok = [w for w in sorted(cohort_of(seen)[0]) if 5 <= sum(w in at for at in seen[:30]) <= 25]
    paths = programs.bed_files(spark, f"{base}/t", path, str(tmp_path / "b"), K, batch_size=40)
    beds = [spark.read.format("plink_bed").option("path", p).load().collect() for p in paths]
    assert [r["name"] for b in beds for r in sorted(b, key=lambda r: r["snp_idx"])] == ok and len(beds) == -(-len(ok) // 40)
    assert all(r["codes"] == [3 * (r["name"] in at) for at in seen[:30]] for b in beds for r in b)
    assert float((tmp_path / "b.0.fam").read_text().split()[5]) == pytest.approx(values[0], abs=1e-5)
    paths = programs.best_kmers_files(spark, f"{base}/t", path, str(tmp_path / "a"), K, best=3, first_phenotype_best=5, kmers_scores=True, pattern_counter=True)
    assert [p.rpartition("/")[2] for p in paths] == ["a.0.phenotype_value", "a.1.other"]
    tops = [spark.read.format("plink_bed").option("path", p).load().collect() for p in paths]
    assert sorted(int(r["name"].split("_")[1]) for r in tops[0]) == [1, 2, 3, 4, 5] and len(tops[1]) == 3
    assert (tmp_path / "a.tested_kmers").read_text() == f"{len(ok)}\n"
    assert (tmp_path / "a.pattern_counter").read_text() == f"{len({tuple(w in at for at in seen[:30]) for w in ok})}\n"
    assert binary.read_raw_kmers(spark, str(tmp_path / "a.0.best_kmers.scores"), True).count() == 5
    (tmp_path / "bad.tsv").write_text("accession_id\ty\nnobody\t1\n")
    with pytest.raises(Exception, match="unknown"):
        programs.bed_files(spark, f"{base}/t", str(tmp_path / "bad.tsv"), str(tmp_path / "c"), K)


def test_study_files(spark, made, tmp_path):
    base, seen, _, held = made
    path, _ = phenotype(tmp_path, held)
    study = programs.kmer_study(spark, f"{base}/t", path, str(tmp_path / "out"), K, kmers_number=8, permutations=20)
    best = spark.read.csv(str(tmp_path / "out/best_kmers"), sep="\t", header=True, inferSchema=True)
    assert best.groupBy("phenotype").count().where("count = 8").count() == 21
    passed = spark.read.csv(str(tmp_path / "out/pass_threshold_5per"), sep="\t", header=True).collect()
    carriers = [6 in h for h in held]
    assert passed and [r["kmer"] in at for r in passed[:1] for at in seen] == carriers
    assert float((tmp_path / "out/threshold_5per").read_text()) == pytest.approx(study.thresholds.where("level = 0.05").first()["threshold"], abs=1e-5)
    assert "herit" in (tmp_path / "out/components.log").read_text() and "k-mers tested" in (tmp_path / "out/log_file").read_text()
    log = study.log().first()
    assert log["h2"] == pytest.approx(log["vg"] / (log["vg"] + log["ve"]))
    study.release()
    with pytest.raises(ValueError, match="exists"):
        programs.kmer_study(spark, f"{base}/t", path, str(tmp_path / "out"), K)
    with pytest.raises(ValueError, match="kmers_number"):
        programs.kmer_study(spark, f"{base}/t", path, str(tmp_path / "none"), K, kmers_number=0)
    few, _ = phenotype(tmp_path, held, 12)
    assert programs.kmer_study(spark, f"{base}/t", few, str(tmp_path / "few"), K) is None and (tmp_path / "few/NOT_ENOUGH_DATA").exists()


def test_phenotype_files(spark, made, tmp_path):
    base, _, _, held = made
    path, values = phenotype(tmp_path, held)
    fit = programs.permuted_files(spark, path, f"{base}/t.kinship", 3, str(tmp_path / "p"), str(tmp_path / "t"), str(tmp_path / "log"), seed=5)
    y, k = np.array([round(v, 6) for v in values]), mixedmodel.mended(text.read_matrix(f"{base}/t.kinship"))
    want = mixedmodel.transform_and_permute(np.float32(y).astype(float), k, 3, 5)
    got = text.read_phenotypes(spark, str(tmp_path / "p")).orderBy("accession_id").toPandas()
    assert list(got.columns) == ["accession_id", *want["names"]] and np.allclose(got.iloc[:, 1:].to_numpy(), want["permuted"], atol=1e-4)
    assert fit.vg == pytest.approx(want["fit"].vg, rel=1e-6) and (tmp_path / "log").read_text().startswith("vg\t")


def test_snp_files(spark, tmp_path):
    rng, n, m = np.random.default_rng(12), 36, 25
    names = [f"s{i:02}" for i in range(n)]
    codes = rng.choice([0, 1, 2, 3], size=(m, n), p=[0.4, 0.05, 0.2, 0.35])
    codes[5, :30] = 1
    dose = np.where(codes == 1, np.nan, np.where(codes == 2, 0.5, (codes == 3).astype(float)))
    base = str(tmp_path / "g")
    geno = spark.createDataFrame([(i, f"snp{i}", list(map(int, c))) for i, c in enumerate(codes)], "snp_idx long, name string, codes array<int>")
    binary.write_genotypes(geno, base, names)
    y = 3 * np.nan_to_num(dose[2], nan=0.5) + 0.3 * rng.normal(size=n)
    (tmp_path / "p.tsv").write_text("accession_id\ty\n" + "".join(f"{a}\t{v:.6f}\n" for a, v in zip(names, y)))
    programs.snp_kinship_file(spark, base)
    assert text.read_matrix(base + ".kinship").shape == (n, n)
    one = programs.snp_study(spark, base, str(tmp_path / "p.tsv"), str(tmp_path / "one"), two_steps=False, permutations=20)
    two = programs.snp_study(spark, base, str(tmp_path / "p.tsv"), str(tmp_path / "two"), snps_number=4, permutations=20)
    counts = {r["phenotype"]: r["count"] for r in one.groupBy("phenotype").count().collect()}
    af = np.nanmean(dose, axis=1)
    kept = [i for i in range(m) if np.minimum(af[i], 1 - af[i]) >= 0.05 and np.isnan(dose[i]).mean() <= 0.5]
    assert 5 not in kept and set(counts.values()) == {len(kept)} and len(counts) == 21
    assert {r["count"] for r in two.where("phenotype <> 'phenotype_value'").groupBy("phenotype").count().collect()} <= {3, 4}
    real = {r["snp_idx"]: r["p"] for r in two.where("phenotype = 'phenotype_value'").collect()}
    k, y32 = mixedmodel.mended(text.read_matrix(base + ".kinship")), np.float32(np.round(y, 6)).astype(float)
    assert min(real, key=real.get) == 2
    for s in kept[:8]:
        assert real[s] == pytest.approx(mixedmodel.lrt(y32 - y32.mean(), k, dose[s]), rel=1e-4, abs=1e-12)
    assert spark.read.csv(str(tmp_path / "two/pass_threshold_5per"), sep="\t", header=True).where("snp_idx = 2").count() == 1
    paths = programs.best_snps_files(spark, str(tmp_path / "p.tsv"), base, str(tmp_path / "best"), best=3)
    top = [r["name"] for r in spark.read.format("plink_bed").option("path", paths[0]).load().collect()]
    assert len(top) == 3 and "snp2" in top


def test_histogram(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACGTACGTACGTA"), ("b", "ACGTACGTACGTT")], "accession string, seq string")
    programs.histogram_file(reads, 10, str(tmp_path / "h"))
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "h"), sep="\t", header=True, inferSchema=True).orderBy("appearance").collect()]
    words = {}
    for s in ("ACGTACGTACGTA", "ACGTACGTACGTT"):
        for i in range(4):
            words[canonical(s[i : i + 10])] = words.get(canonical(s[i : i + 10]), 0) + 1
    assert rows == [(a, sum(c == a for c in words.values())) for a in range(max(words.values()) + 1)]
