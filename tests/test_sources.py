import numpy as np
import pytest

from tessera.operators import presence
from tessera.sources import binary, text


@pytest.mark.parametrize("n", [3, 64, 65, 129])
def test_table_round_trip(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    cells = [(int(k), int(a)) for k in range(5, 25) for a in range(n) if rng.random() < 0.4 or a == 0]
    rows = spark.createDataFrame(cells, "kmer long, accession int")
    index = presence.sample_index(spark.range(n).selectExpr("cast(id as int) AS accession"))
    packed = presence.pack_presence(rows, index, n)
    names = [f"s{i}" for i in range(n)]
    base = str(tmp_path / "t")
    binary.write_kmers_table(packed, base, names, 15)
    binary.register(spark)
    assert binary.table_header(base + ".table", n, 15)[2] == 20
    back = spark.read.format("kmers_table").option("path", base + ".table").option("n", n).load()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, packed.select("kmer", "pa").collect()))
    assert sorted(map(tuple, presence.unpack_presence(back, index).collect())) == sorted(cells)
    assert text.read_names(base + ".names") == names
    with pytest.raises(ValueError):
        binary.table_header(base + ".table", n + 1)
    binary.write_bed(packed.selectExpr("kmer", "pa", "concat(kmer, '_1') AS name"), base, names)
    bed = spark.read.format("plink_bed").option("path", base).load().collect()
    assert {(int(r["name"].split("_")[0]), i) for r in bed for i, c in enumerate(r["codes"]) if c == 3} == set(cells)


def test_sorted_kmers(spark, tmp_path):
    binary.register(spark)
    rows = [(4611686018427387903, 3), (0, 1), (77, 2)]
    path = str(tmp_path / "k")
    binary.write_sorted_kmers(spark.createDataFrame(rows, "kmer long, flag int"), path)
    assert [tuple(r) for r in spark.read.format("sorted_kmers").option("path", path).load().orderBy("kmer").collect()] == sorted(rows)
    binary.write_scores(spark.createDataFrame([(1, 2.5), (2, 0.5)], "kmer long, score double"), path + "s")
    assert {tuple(r) for r in spark.read.format("sorted_kmers").option("path", path + "s").option("scores", "true").load().collect()} == {(1, 2.5), (2, 0.5)}


def test_text_files(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("accession_id\ta\tb\n01\t1.5\t2\n02\t3\t4")
    assert [tuple(r) for r in text.read_phenotypes(spark, str(p)).orderBy("accession_id").collect()] == [("01", 1.5, 2.0), ("02", 3.0, 4.0)]
    p.write_text("accession_id\ta\n01\t1\t2\n")
    with pytest.raises(Exception, match="ragged"):
        text.read_phenotypes(spark, str(p)).collect()
    p.write_text("ACGTACGTAC TTTTTTTTTT\nGTACGTACGT\n")
    assert text.read_kmer_list(spark, str(p)).count() == 2
    p.write_text("ACGTACGTAC ACGT\n")
    with pytest.raises(ValueError):
        text.read_kmer_list(spark, str(p))
    m = np.array([[1, 0.25], [0.25, 1]])
    text.write_matrix(m, str(p))
    assert (text.read_matrix(str(p)) == m).all()
    p.write_text("/a/b s1\n/c s2\n")
    assert [r["accession"] for r in text.read_manifest(spark, str(p)).collect()] == ["s1", "s2"]


def table(spark, base, **options):
    return spark.read.format("kmers_table").options(path=base + ".table", **{k: str(v) for k, v in options.items()}).load()


def test_pushed_filters(spark, tmp_path, monkeypatch):
    """Ranges and filters give the rows that a whole scan gives; what is outside isn't read; samples are squeezed and counted where rows are read."""
    rng, n = np.random.default_rng(4), 70
    cells = [(int(k) * 3, int(a)) for k in range(400) for a in range(n) if rng.random() < 0.3 or a == 0]
    index = presence.sample_index(spark.range(n).selectExpr("cast(id as int) AS accession"))
    packed = presence.pack_presence(spark.createDataFrame(cells, "kmer long, accession int"), index, n)
    base = str(tmp_path / "t")
    binary.write_kmers_table(packed, base, [f"s{i}" for i in range(n)], 15)
    binary.register(spark)
    everything = sorted(map(repr, packed.select("kmer", "pa").collect()))
    kmers = lambda df: sorted(r["kmer"] for r in df.collect())
    for where in ("kmer = 300", "kmer = 301", "kmer < 10", "kmer >= 1190", "kmer > 20 AND kmer <= 60", "kmer IN (3, 4, 900)", "kmer > 5000", "kmer IS NOT NULL"):
        assert sorted(map(repr, table(spark, base).where(where).collect())) == sorted(map(repr, packed.select("kmer", "pa").where(where).collect()))
    assert sorted(map(repr, table(spark, base).collect())) == everything
    assert kmers(table(spark, base, least=10, most=20)) == [12, 15, 18]
    reader = binary.KmersTableReader({"path": base + ".table", "least": "300", "most": "330"})
    assert [(p.first, p.count) for p in reader.partitions()] == [(100, 11)]
    chosen = [5, 2, 69]
    squeezed = {r["kmer"]: (r["pa"], r["n1"]) for r in presence.both_sides(presence.select_samples(packed, chosen, n), 3, 1).collect()}
    assert {r["kmer"]: r["pa"] for r in table(spark, base, columns=chosen, min_count=1).collect()} == {k: v for k, (v, _) in squeezed.items()}
    flags = spark.createDataFrame([(k, 1 + k % 3) for k in range(0, 90, 2)], "kmer long, flag int")
    binary.write_sorted_kmers(flags, base + ".k")
    got = spark.read.format("sorted_kmers").option("path", base + ".k").load().where("kmer <= 7")
    assert sorted(map(tuple, got.collect())) == [(0, 1), (2, 3), (4, 2), (6, 1)]


def test_raw_kmers(spark, tmp_path):
    path = str(tmp_path / "r")
    binary.write_scores(spark.createDataFrame([(7, 2.0), (9, 1.0), (7, 3.0)], "kmer long, score double"), path)
    assert sorted(r["kmer"] for r in binary.read_raw_kmers(spark, path, True).collect()) == [7, 9]
    assert binary.read_raw_kmers(spark, str(tmp_path / "none")).count() == 0


def test_parts_of_repeated_attempts(tmp_path):
    """Each attempt writes a part of its own, and only those that are reported are joined."""
    import pyarrow as pa
    from unittest import mock

    writer = binary.RawRowsWriter({"path": str(tmp_path / "f"), "header": "00"})
    batch = lambda *rows: [pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.binary())})]
    with mock.patch("pyspark.TaskContext.get") as context:
        context.return_value.partitionId.return_value = 1
        second, lost = writer.write(batch(b"c", b"d")), writer.write(batch(b"c", b"x"))
        context.return_value.partitionId.return_value = 0
        first = writer.write(batch(b"a", b"b"))
    assert lost.name != second.name
    writer.commit([second, first, None])
    assert (tmp_path / "f").read_bytes() == b"\0abcd" and not (tmp_path / "f.parts").exists()


def bed_of(spark, base):
    return {r["name"]: r["codes"] for r in spark.read.format("plink_bed").option("path", base).load().collect()}


def test_exports(spark, tmp_path):
    rng, n, k = np.random.default_rng(5), 9, 10
    x = rng.random((30, n)) < 0.5
    x[:, 0], x[7] = True, x[3]
    names = [f"s{i}" for i in range(n)]
    packed = presence.pack_presence(spark.createDataFrame([(v, names[a]) for v in range(30) for a in np.flatnonzero(x[v])], "kmer long, accession string"), presence.sample_index(spark.createDataFrame([(s,) for s in names], "accession string")), n)
    word = lambda v: "".join("ACGT"[v >> 2 * i & 3] for i in reversed(range(k)))
    best = spark.createDataFrame([("P1", 4, 1), ("P1", 2, 2), ("y", 4, 1)], "phenotype string, kmer long, rank int")
    paths = binary.write_bed_top(packed, best, str(tmp_path / "top"), names, k, {"P1": {"s0": 1.5}, "y": {}})
    assert bed_of(spark, paths[0]) == {f"{word(4)}_1": [3 * int(b) for b in x[4]], f"{word(2)}_2": [3 * int(b) for b in x[2]]} and set(bed_of(spark, paths[1])) == {f"{word(4)}_1"}
    assert (tmp_path / "top.P1.fam").read_text().splitlines()[:2] == ["s0 s0 0 0 0 1.5", "s1 s1 0 0 0 -9"]
    paths = binary.write_bed_batches(packed, str(tmp_path / "b"), names, k, 12)
    assert [sorted(bed_of(spark, p)) for p in paths] == [[word(v) for v in range(a, min(a + 12, 30))] for a in (0, 12, 24)]
    unique = binary.write_bed_batches(packed, str(tmp_path / "u"), names, k, 100, unique_patterns=True)
    assert len(unique) == 1 and len(bed_of(spark, unique[0])) == len({tuple(r) for r in x}) < 30
    codes = rng.integers(0, 4, (12, n))
    geno = spark.createDataFrame([(i, f"snp{i}", list(map(int, c))) for i, c in enumerate(codes)], "snp_idx long, name string, codes array<int>")
    binary.write_genotypes(geno, str(tmp_path / "g"), names, {"s2": 3.0})
    assert bed_of(spark, str(tmp_path / "g")) == {f"snp{i}": list(c) for i, c in enumerate(codes)}
    wanted = spark.createDataFrame([("P1", 3), ("P1", 11), ("P2", 0), ("P2", 3), ("P2", 3), ("P2", 99)], "list string, snp_idx int")
    paths = binary.write_snp_subsets(spark, str(tmp_path / "g"), wanted, str(tmp_path / "sub"))
    assert [bed_of(spark, p) for p in paths] == [{f"snp{i}": list(codes[i]) for i in c} for c in ((3, 11), (0, 3))]
    assert (tmp_path / "sub.P2.fam").read_text() == (tmp_path / "g.fam").read_text()


def test_tables_of_text(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("accession_id\ta\nx\t1\naccession_id\ta\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_phenotypes(spark, str(p)).collect()
    p.write_text("accession_id\ta\tb\nx\t1\n")
    with pytest.raises(Exception, match="ragged"):
        text.read_phenotypes(spark, str(p)).collect()
    p.write_text("chr\trs\tp\n1\tv1\t0.5\n1\tv2\t1e-9\n")
    assert [tuple(r) for r in text.read_tests(spark, str(p), 3).orderBy("variant").collect()] == [("v1", 0.5), ("v2", 1e-9)]
    rows = [(5, 9, 1, 8, 0), (6, 7, 7, 0, 0)]
    text.write_no_pass(spark.createDataFrame(rows, "kmer long, count_all long, canonical long, non_canonical long, both long"), str(tmp_path / "np"), 10)
    assert sorted(map(tuple, text.read_no_pass(spark, str(tmp_path / "np")).collect())) == [("AAAAAAAACC", 9, 1, 8, 0), ("AAAAAAAACG", 7, 7, 0, 0)]


@pytest.mark.parametrize("split", [64 << 20, 300, 37])
def test_fastq(spark, tmp_path, split, monkeypatch):
    """Reads are found from any place of a file, whatever their qualities begin with; counts are those of two passes."""
    import gzip
    import random

    from tessera.operators import kmers
    from tessera.sources import fastq

    rng = random.Random(split)
    files, reads = [], []
    for f, who in enumerate(["a", "b", "a", "c"]):
        body = b""
        for i in range(40):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 12, 30, 61])))
            quality = "".join(rng.choice("@+I") for _ in seq)
            reads.append((who, f"r{f}.{i}", seq))
            body += f"@r{f}.{i} x\n{seq}\n+\n{quality}\n".encode().replace(b"\n", b"\r\n" if f == 1 else b"\n")
        path = tmp_path / f"{f}.fastq{'.gz' if f == 2 else ''}"
        path.write_bytes(gzip.compress(body) if f == 2 else body[:-1] if f == 0 else body)
        files.append((str(path), who))
    monkeypatch.setattr(fastq, "SPLIT", split)
    reader = fastq.FastqReader({"files": __import__("json").dumps(files)})
    got = [(p.accession, *r) for p in reader.partitions() for r in fastq.records(p)]
    assert sorted(got) == sorted(reads)
    df = fastq.read_fastq(spark, files)
    assert sorted(map(tuple, df.collect())) == sorted(reads)
    seen = {}
    for who, _, s in reads:
        for i in range(len(s) - 9):
            w = s[i : i + 10]
            r = w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            n, flag = seen.get((who, min(w, r)), (0, 0))
            seen[who, min(w, r)] = (n + 1, flag | (1 if w < r else 2))
    from tessera.functions.sequences import unpack_kmer

    for least in (1, 2):
        counted = kmers.two_pass(df, "accession", "seq", 10, least).withColumn("s", unpack_kmer(spark_col("kmer"), 10))
        assert {(r["accession"], r["s"]): r["flag"] for r in counted.collect()} == {k: f for k, (n, f) in seen.items() if n >= least}


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
