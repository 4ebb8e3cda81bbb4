"""Text files: sample names and manifests, phenotypes, k-mer lists, matrices, and their writers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequences import unpack_kmer
from tessera.operators.presence import kmer_list
from tessera.sources.binary import _save, read_bytes, size_of, write_lines


def read_names(path: str) -> list[str]:
    """One sample name a line, in bit order."""
    return [x.strip() for x in read_bytes(path).decode().splitlines() if x.strip()]


def names_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(read_names(path))), "col_idx int, accession string").select("accession", "col_idx")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, accession): white-space separated pairs, one a line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("path"), parts[1].alias("accession"))


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a tab-separated table with a header as text; a line with more or fewer fields is an error."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = header[0].split("\t")
    # a line is one field here: the reader leaves out the header line, and only that one
    lines = spark.read.schema("line string").csv(path, sep="\0", header=True, enforceSchema=True, quote="", escape="")
    cells = F.split("line", "\t")
    right = F.when(F.size(cells) != len(names), F.raise_error(F.concat(F.lit("ragged line: "), "line")).cast("boolean")).otherwise(True)
    return lines.where(right).select(*(cells[i].alias(c) for i, c in enumerate(names)))


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """Wide table: accession_id as text, each phenotype as a double. Tab-separated with a header; a line with more
    or fewer fields, or a value that is no number, is an error, a missing final newline isn't."""
    df = _tsv(spark, path)
    return df.select(df.columns[0], *(F.col(f"`{c}`").cast("float").cast("double").alias(c) for c in df.columns[1:]))


def write_phenotypes(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, length) of k-mers as text between white space; canonical, equal lengths required."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("kmer")).where(F.col("kmer") != "")
    return kmer_list(words)


def read_matrix(path: str) -> np.ndarray:
    """Square tab-separated matrix without header."""
    rows = [list(map(float, x.split("\t"))) for x in read_bytes(path).decode().splitlines() if x.strip()]
    m = np.array(rows) if len({len(r) for r in rows}) == 1 else np.empty((0, 1))
    if m.shape[0] != m.shape[1]:
        raise ValueError(f"{path} is not square")
    return m


def write_matrix(m: np.ndarray, path: str) -> None:
    """Six significant digits."""
    write_lines(path, ["\t".join(f"{x:.6g}" for x in row) for row in m])


def write_cells(kinship: DataFrame, n: int, path: str) -> None:
    """A symmetric matrix with a diagonal of 1 from its cells (i, j, k), i > j, as one tab-separated file of six significant
    digits: each row is put together from its own cells, and rows are written in order by many tasks."""
    mirrored = kinship.select("i", "j", "k").union(kinship.select("j", "i", "k"))
    ones = kinship.sparkSession.range(n).select("id", "id", F.lit(1.0))
    rows = mirrored.union(ones.toDF("i", "j", "k")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda x: x["k"]).alias("row"))  # n cells a row

    def lines(batches):
        for batch in batches:
            out = ["\t".join(f"{x:.6g}" for x in row).encode() + b"\n" for row in batch.column("row").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["row"])

    _save(rows.orderBy("i").select("row").mapInArrow(lines, "row binary"), path)


def read_cells(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(i, j, k) of all cells of a tab-separated matrix without header. The file is read in pieces: first the lines that begin
    in each are counted, then each piece gives the cells of its lines."""
    size = size_of(path)
    pieces = spark.range(0, max(-(-size // split), 1), 1, max(-(-size // split), 1))

    def own(piece: int) -> list[bytes]:
        """Lines that begin within a piece."""
        start, end = piece * split, min((piece + 1) * split, size)
        begin = max(start - 1, 0)
        data = read_bytes(path, begin, end - begin)
        first = data.find(b"\n") + 1 if start else 0
        if start and not first:
            return []
        while data[-1:] != b"\n" and end < size:  # up to the end of the last line
            more = read_bytes(path, end, min(1 << 20, size - end))
            cut = more.find(b"\n") + 1
            data, end = data + (more[:cut] if cut else more), end + (cut or len(more))
            if cut:
                break
        return [x for x in data[first:].split(b"\n") if x.strip()]

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array([len(own(i)) for i in ids], pa.int64())})

    counted = sorted((r["id"], r["n"]) for r in pieces.mapInArrow(count, "id long, n long").collect())  # one number a piece
    before = dict(zip((i for i, _ in counted), np.cumsum([0, *(n for _, n in counted)]).tolist()))
    total = sum(n for _, n in counted)

    def cells(batches):
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                for at, line in enumerate(own(piece)):
                    row = np.array(line.split(b"\t"), float)
                    if len(row) != total:
                        raise ValueError(f"{path} is not square")
                    yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(total, before[piece] + at)), "j": pa.array(np.arange(total)), "k": pa.array(row)})

    return pieces.mapInArrow(cells, "i long, j long, k double")


def read_tests(spark: SparkSession, path: str, column: int = 9) -> DataFrame:
    """(variant, p) of a tab-separated result table with a header; `column` counts from 1. A p that is no number is an error."""
    df = _tsv(spark, path)
    return df.select(F.col(f"`{df.columns[1]}`").alias("variant"), F.col(f"`{df.columns[column - 1]}`").cast("double").alias("p"))


def write_no_pass(not_passed: DataFrame, path: str, k: int) -> None:
    """Tab-separated kmer (as text), count_all, canonical, non_canonical, both, with a header: a folder of parts."""
    columns = ["count_all", "canonical", "non_canonical", "both"]
    not_passed.select(unpack_kmer(F.col("kmer"), k).alias("kmer"), *columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_no_pass(spark: SparkSession, path: str) -> DataFrame:
    """The same back, k-mers as text."""
    return spark.read.schema("kmer string, count_all long, canonical long, non_canonical long, both long").csv(path, sep="\t", header=True, mode="FAILFAST")


def write_presence_matrix(matrix: DataFrame, path: str) -> None:
    """kmer and a 0/1 column a sample, tab-separated with a header."""
    matrix.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
